"""The training-data pipeline: classify, drop near copies, cut repeated passages, mix sources, encode.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memweave.llm import bpe, line_dedup, near_dedup, rff_classifier, source_mix
from memweave.session import ensure_checkpoint_dir, prepare
from memweave.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality label is 1 (all, if there is no label to learn from)."""
    prepare(spark, give_back=True)
    return rff_classifier.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of smallest doc_id."""
    prepare(spark, give_back=True)
    return near_dedup.survivors(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go but for their earliest occurrence; every document stays, n_chars follows its text."""
    prepare(spark, give_back=True)
    spans = "_".join(["spans", *docs.columns])              # a name that no column has
    cleaned = line_dedup.clean(docs, removed=spans)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document stands in it as often as it is taken (0, 1 or 2 times)."""
    prepare(spark, give_back=True)
    return source_mix.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of every text of the mix, and the text that the ids decode to."""
    import public_tokenizers
    prepare(spark, give_back=True)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", line_dedup_stage),
    ("source mixing", mix_stage),
    ("byte-level BPE", bpe_stage),
]

ORACLE_SQL = None  # MinHash banding, random features and byte-pair merges have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs)
    return docs


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/stage-{spark.range(1).select(F.uuid()).first()[0]}"
    docs.write.parquet(path)
    return spark.read.parquet(path)
