"""Memory tables: schema, derived test view, store append / migration / export.

The store is a Parquet table of memories (S1).  There is no MERGE on plain
Parquet, so every update operator in ``operators.store`` returns a new
DataFrame that the caller writes as a new table version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.text import confidence_from_source

MEMORY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("project", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("summary", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("related_files", T.ArrayType(T.StringType()), False),
    T.StructField("conflict_flag", T.BooleanType(), False),
    T.StructField("approved", T.BooleanType(), False),
    T.StructField("raw_text", T.StringType(), True),
    T.StructField("commit_sha", T.StringType(), True),
    T.StructField("so_url", T.StringType(), True),
    T.StructField("related_to", T.ArrayType(T.LongType()), False),
])

# defaults for columns added after the first schema version
def _column_defaults() -> dict:
    return {
        "project": F.lit(rules.DEFAULT_PROJECT),
        "type": F.lit("general"),
        "confidence": F.lit(rules.DEFAULT_CONFIDENCE),
        "tags": F.array().cast("array<string>"),
        "related_files": F.array().cast("array<string>"),
        "conflict_flag": F.lit(False),
        "approved": F.lit(False),
        "related_to": F.array().cast("array<bigint>"),
    }


# ---------------------------------------------------------------------------
# Derived view over the driver's `documents` table (same rules in the oracle).
# ---------------------------------------------------------------------------
SEED_TECH = ("flask", "django", "postgres", "mysql", "sqlite", "chroma", "qdrant",
             "react", "vue", "npm", "yarn")
SEED_ORIGINS = ("confirmed", "github_pr", "session", "stack_overflow", "user_session", "manual")
SEED_RULES = ("Do not deploy on fridays. ", "Always run the tests first. ",
              "Avoid global state in handlers. ", "Prefer small pure functions. ")
SEED_KEYWORDS = (
    "We decided to fix the import error because the architecture note was important. ",
    "The bug was fixed after we switched the dependency structure. ",
    "Remember you should never install it twice and must avoid that pattern. ",
)


def _pick(values, idx_col):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col + 1).cast("int"))


def _case(idx_col, values):
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx_col == i, F.lit(v)) if expr is None else expr.when(idx_col == i, F.lit(v))
    return expr.otherwise(F.lit(""))


def memories_from_documents(documents: DataFrame) -> DataFrame:
    """Deterministic memory table derived from ``documents`` (one row per doc)."""
    d = F.col("doc_id")
    tech = F.when(d % 17 < 11, F.concat(F.lit("We use "), _pick(SEED_TECH, d % 17),
                                         F.lit(" for the service. "))).otherwise(F.lit(""))
    summary = F.concat(tech, _case(d % 41, SEED_RULES), _case(d % 23, SEED_KEYWORDS), F.col("text"))
    source = F.when(d % 29 == 0, F.lit(None).cast("string")).otherwise(_pick(SEED_ORIGINS, (d % 13) % 6))
    type_ = _pick(rules.MEMORY_TYPES, d % 11)
    tags = F.concat(F.array(F.concat(F.lit("t"), (d % 37).cast("string"))),
                    F.when(d % 5 == 0, F.array(F.concat(F.lit("lang:"), F.col("lang"))))
                    .otherwise(F.array().cast("array<string>")))
    related_to = F.concat(F.when(d % 9 == 0, F.array(d + 20)).otherwise(F.array().cast("array<bigint>")),
                          F.when(d % 27 == 0, F.array(d + 3)).otherwise(F.array().cast("array<bigint>")))
    out = documents.select(
        d.alias("id"),
        F.col("source").alias("project"),
        type_.alias("type"),
        summary.alias("summary"),
        source.alias("source"),
        F.timestamp_add("MINUTE", d, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_at"),
        tags.alias("tags"),
        F.array(F.concat(F.lit("src/mod"), (d % 5).cast("string"), F.lit(".py"))).alias("related_files"),
        F.lit(False).alias("conflict_flag"),
        (d % 7 != 0).alias("approved"),
        F.lit(None).cast("string").alias("raw_text"),
        F.when(d % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), F.lpad(F.floor(d / 10).cast("string"), 11, "0"))).alias("commit_sha"),
        F.when(type_ == "pattern", F.concat(F.lit("https://stackoverflow.com/a/"), d.cast("string")))
        .alias("so_url"),
        related_to.alias("related_to"),
    )
    return out.withColumn("confidence", confidence_from_source("source")).select(*MEMORY_SCHEMA.names)


def secret_seed(d):
    """Fake secrets assembled at run time (no key-like literal in the repo)."""
    nl = F.lit("\n")
    cases = [
        F.concat(F.lit("key sk-"), F.repeat(F.lit("a"), 40), F.lit(" ")),
        F.concat(F.lit("PASSWORD="), F.repeat(F.lit("x"), 10), nl),
        F.concat(F.lit("token ghp_"), F.repeat(F.lit("b"), 36), F.lit(" ")),
        F.concat(F.lit("id AKIA"), F.repeat(F.lit("Q"), 16), F.lit(" ")),
        F.concat(F.lit("aws secret \""), F.repeat(F.lit("z"), 40), F.lit("\" ")),
        F.concat(F.lit("Authorization: Basic "), F.repeat(F.lit("Q"), 12), F.lit(" ")),
        F.concat(F.lit("Bearer "), F.repeat(F.lit("t"), 24), F.lit(" ")),
        F.concat(F.lit("https://user:"), F.repeat(F.lit("p"), 8), F.lit("@db.local ")),
        F.concat(F.lit("-----BEGIN PRIVATE "), F.lit("KEY-----"), nl),
        F.concat(F.lit("xoxb-"), F.repeat(F.lit("1"), 12), F.lit(" ")),
        F.concat(F.lit("sk-"), F.lit("ant-"), F.repeat(F.lit("c"), 40), F.lit(" ")),
        F.concat(F.lit("github_"), F.lit("pat_"), F.repeat(F.lit("d"), 82), F.lit(" ")),
        F.concat(F.lit("hf_"), F.repeat(F.lit("e"), 34), F.lit(" ")),
        F.concat(F.lit("sk_"), F.lit("live_"), F.repeat(F.lit("f"), 24), F.lit(" ")),
        F.concat(F.lit("AI"), F.lit("za"), F.repeat(F.lit("g"), 35), F.lit(" ")),
    ]
    expr = None
    for i, c in enumerate(cases):
        expr = F.when(d % 19 == i, c) if expr is None else expr.when(d % 19 == i, c)
    return expr.otherwise(F.lit(""))


def incoming_from_memories(mem: DataFrame) -> DataFrame:
    """Records offered to the gate: every memory re-offered with raw text
    (seeded secrets) and a few invalid types."""
    d = F.col("id")
    type_raw = (F.when(d % 31 == 0, F.lit("unknown_type"))
                .when(d % 31 == 1, F.lit("Decision")).otherwise(F.col("type")))
    return mem.select("id", "project", type_raw.alias("type"), "source", "tags", "related_files",
                      F.concat(secret_seed(d), F.col("summary")).alias("text"))


# ---------------------------------------------------------------------------
# Store operations
# ---------------------------------------------------------------------------
def align_schema(df: DataFrame) -> DataFrame:
    """Columns of later schema versions get their defaults, where they are missing or (in the
    rows of an earlier version) null."""
    defaults = _column_defaults()
    cols = []
    for field in MEMORY_SCHEMA.fields:
        default = defaults.get(field.name, F.lit(None)).cast(field.dataType)
        if field.name not in df.columns:
            cols.append(default.alias(field.name))
        elif field.name in defaults:
            cols.append(F.coalesce(F.col(field.name), default).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def new_memories(records: DataFrame, now=None, next_id: int = 0) -> DataFrame:
    """Fill id, creation time, confidence and all defaults.

    Ids count up from ``next_id`` (the table's largest id + 1), so that equal records of one
    batch are told apart and no two ids collide."""
    ts = now if now is not None else F.current_timestamp()
    rows = records if "created_at" in records.columns else records.withColumn("created_at", ts)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.lit(next_id) + F.monotonically_increasing_id())
    if "confidence" not in rows.columns:
        rows = rows.withColumn("confidence", confidence_from_source("source"))
    return align_schema(rows)


def append(mem: DataFrame, path: str) -> None:
    """S1 sink: append to the Parquet store, partitioned by project."""
    mem.write.mode("append").partitionBy("project").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Read every schema version at once (S2 via mergeSchema + defaults)."""
    return align_schema(spark.read.option("mergeSchema", "true").parquet(path))


# A store in folders by id bucket: an update rewrites the buckets of its ids only.
BUCKETS = 64


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def write_buckets(mem: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append memories to a bucketed store (made by the first call); every call on a store names the same ``buckets``.

    Rows may lack columns of later schema versions: ``read_buckets`` fills them."""
    _bucketed(mem, buckets).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a bucketed store, whatever the schema version they were written with."""
    return align_schema(_stored(spark, path).filter(F.col("id").isNotNull()))


def change_buckets(spark: SparkSession, path: str, upserts: DataFrame | None = None, forget: DataFrame | None = None,
                   buckets: int = BUCKETS) -> list[int]:
    """Put ``upserts`` (whole memories, by unique id) in place of stored rows, and drop the ids of ``forget`` (id).

    Only buckets that hold such ids are read and rewritten, in today's schema; the files of the others are
    not touched.  Returns the rewritten buckets (at most ``buckets`` numbers).  An id in both is
    forgotten.  New rows are complete in the checkpoint folder before a file is replaced, so a run that
    breaks off is repeated with the same arguments.  A rewritten bucket holds one row without an id,
    so that a bucket whose rows are all gone is replaced, too."""
    new = align_schema(upserts) if upserts is not None else spark.createDataFrame([], MEMORY_SCHEMA)
    gone = forget.select("id") if forget is not None else spark.createDataFrame([], "id bigint")
    gone = gone.filter(F.col("id").isNotNull()).distinct()
    new = new.join(gone, "id", "left_anti").checkpoint()
    gone = gone.unionByName(new.select("id")).distinct().checkpoint()
    touched = sorted(r[0] for r in _bucketed(gone, buckets).select("bucket").distinct().collect())
    if not touched:
        return touched
    old = _stored(spark, path).filter(F.col("bucket").isin(touched) & F.col("id").isNotNull())
    kept = align_schema(old).join(gone, "id", "left_anti").unionByName(new.select(*MEMORY_SCHEMA.names))
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in MEMORY_SCHEMA.fields), "bucket")
    rows = _bucketed(kept, buckets).unionByName(marks).checkpoint()
    (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))
    return touched


def export_json(mem: DataFrame, path: str, project: str | None = None) -> None:
    """Full export (pending included) as JSON lines."""
    out = mem if not project else mem.filter(F.col("project") == project)
    out.write.mode("overwrite").json(path)
