import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from memweave.llm import near_dedup, rff_classifier
from memweave.sources.tables import read_table

from .helpers import ODD, SF
from .helpers import docs as table


def test_stages_work_on_what_their_predecessor_kept(spark):
    docs = read_table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, cp.written(spark, stage(spark, docs, SF))
        seen.append(docs.count())
        assert docs.columns == (columns if k < len(cp.STAGES) - 1 else ["doc_id", "ids", "text"])
        if k == 0:
            want = rff_classifier.classify(before, read_table(spark, SF, "labels")).where("predicted = 1").count()
            assert docs.count() == want < before.count()
        if k == 1:
            assert near_dedup.near_duplicates(docs).where("not kept").count() == 0
        if k == 3:
            mixed = [(r["doc_id"], r["text"]) for r in docs.collect()]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r["doc_id"], r["ids"], r["text"]) for r in docs.collect()) == sorted((d, enc.encode_ordinary(t), t) for d, t in mixed)
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[4] == seen[5]


def test_run_equals_the_stages(spark):
    assert cp.run(spark, SF).count() > 0 and len(cp.STAGES) == 5


def through(spark, df, sf_dir):
    for k, (_, stage) in enumerate(cp.STAGES):
        columns, df = df.columns, cp.written(spark, stage(spark, df, sf_dir))
        assert df.columns == (columns if k < len(cp.STAGES) - 1 else ["doc_id", "ids", "text"])
    return df


def unlabelled(spark, folder):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_and_clashing_columns_without_labels(spark, tmp_path):
    """Without labels the classifier keeps all; one row of each group of copies goes on; sizes decide what the mix takes."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a null id here"), (None, None), (3, "   "), (50, "copy of a b c d e"),
                                                  (51, "copy of a b c d e"), (51, "copy of a b c d e")]
    df = table(spark, rows).selectExpr("*", "9 as removed", "'z' as spans", "1 as score", "2 as kept", "3 as one")
    sf = unlabelled(spark, tmp_path)
    assert cp.quality_stage(spark, df, sf).count() == len(rows)
    out = through(spark, df, sf).collect()
    kept = {(r["doc_id"], t) for r, t in zip(cp.near_dedup_stage(spark, df, sf).collect(), range(99))}
    assert out and {r["doc_id"] for r in out} <= {d for d, _ in kept} and 51 not in {r["doc_id"] for r in out}


def test_empty_table_and_no_n_chars(spark, tmp_path):
    sf = unlabelled(spark, tmp_path)
    assert through(spark, table(spark, []), sf).collect() == []
    few = table(spark, [(1, "some words of a text"), (2, None)]).drop("n_chars")
    assert {r["doc_id"] for r in through(spark, few, sf).collect()} <= {1, 2}
