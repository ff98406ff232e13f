import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from memweave.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[2]", app="memweave-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield s
    s.stop()


def mem_rows(spark, rows, approved=True):
    """Build a memories DataFrame from dicts (id, summary, type, project, tags, related_to, minute)."""
    from pyspark.sql import functions as F
    from memweave.sources.memories import align_schema
    data = [(r["id"], r.get("project", "p"), r.get("type", "general"), r.get("summary", ""),
             r.get("source", "session"), r.get("minute", i), r.get("tags", []), r.get("related_to", []),
             r.get("approved", approved), r.get("commit_sha"), r.get("so_url"))
            for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id bigint, project string, type string, summary string, source string, "
                                     "minute int, tags array<string>, related_to array<bigint>, approved boolean, "
                                     "commit_sha string, so_url string")
    df = df.withColumn("created_at", F.timestamp_add("MINUTE", F.col("minute"),
                                                     F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return align_schema(df.drop("minute"))
