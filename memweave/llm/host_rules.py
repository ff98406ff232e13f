"""Quality rules with host verdicts, in DataFrame functions only.

Method: base rules are judged on every text; failures are summed by host; each host's failure
rate is shrunk towards the corpus by an empirical beta prior, whose strength comes
from how much the hosts' rates differ beyond chance (method of moments); the verdict on the host joins
back to its documents.  A host is bad if its shrunk rate is above ``limit``.

Defined results: a null or empty text has no words and fails.  Null hosts are
one host of their own.  Rows that repeat a doc_id are judged one by one.  Repeated windows are
found by a 64-bit hash of their three words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_WORDS, MAX_REPEAT_PERCENT, HOST_LIMIT = 50, 50, 0.5
GAPS, SYMBOLS = "\t\n\x0b\f\r", "#*$%&|<>"
BOUNDS = (1.0, 1_000_000.0)     # of the prior's strength, in documents


def text_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    spaced = F.translate(text, GAPS, " " * len(GAPS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + GAPS, "")) > 0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"),
                    F.array_remove(F.split(spaced, " "), "").alias("words"),
                    F.length(F.translate(text, " " + GAPS, "")).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    lines.alias("lines"))
    n = F.size("words")
    triples = F.arrays_zip(F.slice("words", 1, F.greatest(n - 2, F.lit(0))).alias("a"),
                           F.slice("words", 2, F.greatest(n - 2, F.lit(0))).alias("b"),
                           F.slice("words", 3, F.greatest(n - 2, F.lit(0))).alias("c"))
    d = d.select("doc_id", "host", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform(triples, lambda t: F.xxhash64(t["a"], t["b"], t["c"])).alias("h"))
    n = F.size("h")
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    next_to = F.arrays_zip(F.slice("s", 1, n - 1).alias("l"), F.slice("s", 2, n - 1).alias("r"))
    twice = F.filter(next_to, lambda p: p["l"]["h"] == p["r"]["h"])
    starts = F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["l"]["i"], p["r"]["i"]))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2)))))
    some = F.size(F.array_distinct("h")) < n
    return (d.withColumn("s", F.when(some, placed)).withColumn("starts", F.when(F.col("s").isNotNull(), starts))
            .select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.when(F.col("starts").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words")))


def verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, rate (shrunk), bad; ``counts`` holds host and base_failed."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("all"), F.sum("failed").alias("k"), F.count("*").alias("hosts"),
                      F.sum(F.col("n") * rate * rate).alias("sq"))
    mean = F.col("k") / F.col("all")
    chance = mean * (1 - mean)
    between = F.col("sq") / F.col("all") - mean * mean - chance * (F.col("hosts") - 1) / F.col("all")
    strength = F.when(between > 0, F.least(F.greatest(chance / between - 1, F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))
                      ).otherwise(BOUNDS[1])
    prior = total.select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta"))
    shrunk = (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", shrunk.alias("rate"),   # prior: one row
                                                      (shrunk > limit).alias("bad"))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: the counts, base_failed, the host's shrunk rate, and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = cut(text_counts(docs, host).withColumn("base_failed", failed))
    found = verdicts(counts, limit).select(F.struct("host").alias("of"), "rate", "bad")
    return (counts.withColumn("of", F.struct("host")).join(found, "of")      # a struct of null equals itself
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~F.col("bad")).alias("kept"), F.col("rate").alias("host_rate")))


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return judge(read_table(spark, sf_dir, "documents")).drop("host_rate")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
c AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c),
h AS (
  SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS DOUBLE) AS k FROM b GROUP BY source),
m AS (
  SELECT CAST(sum(n) AS DOUBLE) AS a, sum(k) / sum(n) AS mu, count(*) AS hosts, sum(k * k / n) AS sq FROM h),
s AS (
  SELECT mu, sq / a - mu * mu - mu * (1 - mu) * (hosts - 1) / a AS v FROM m),
p AS (
  SELECT mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 1.0), 1000000.0) ELSE 1000000.0 END AS z FROM s),
r AS (SELECT source, (k + mu * z) / (n + z) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT bad) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
