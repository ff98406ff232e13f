import base64
import hashlib

import public_tokenizers as P
import tiktoken

from memweave.llm import bpe

from .helpers import ODD, docs

RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_are_the_librarys(spark):
    enc = library()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, "tail  \n"), (101, " \t x"), (102, "z" * 5000)]
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, rows), RANKS, P.PATTERN).collect()}
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest())


def test_several_blocks_repeated_and_null_ids(spark):
    enc = library()
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "c d"), (2, "")] * 5
    got = bpe.encode(docs(spark, rows), RANKS, P.PATTERN, block_bytes=150).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted(
        (str(d), tuple(enc.encode_ordinary(t))) for d, t in rows)


def test_empty_table(spark):
    assert bpe.digests(docs(spark, []), RANKS, P.PATTERN).collect() == []


def test_a_text_of_more_tokens_than_are_placed_at_once(spark):
    enc = library()
    rows = [(1, "ab c"), (2, " ".join(f"w{i % 977}" for i in range(bpe.STEP_TOKENS // 2))), (3, "d e")]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark, rows), RANKS, P.PATTERN).collect()}
    assert len(got[2]) > bpe.STEP_TOKENS and got == {d: enc.encode_ordinary(t) for d, t in rows}
