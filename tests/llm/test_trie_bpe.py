import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from memweave.llm import trie_bpe

from .helpers import ODD, SF, docs

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as f:
        return trie_bpe.Vocabulary(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_words_of_all_kinds(library, vocab):
    rng = random.Random(3)
    tokens = [t for t in vocab.bytes_of.values() if t != b"<|endoftext|>"]
    words = {b"".join(rng.choices(tokens, k=rng.randint(1, 4))) for _ in range(3000)}
    words |= {c * n for c in (b"a", b" ", b"-", b"=", b"aa", b"ab", b"\xc3\xa9") for n in range(1, 70)}
    words |= {bytes(rng.choices(b"abcd", k=rng.randint(1, 12))) for _ in range(2000)}
    shown = {b: chr(c) for c, b in vocab.byte_of.items()}
    got = trie_bpe.encode_words(list(words), vocab)
    for w in words:
        assert got[w] == [t.id for t in library.model.tokenize("".join(shown[b] for b in w))], w


def test_every_token_is_its_own_encoding(vocab):
    words = [t for i, t in vocab.bytes_of.items() if i not in vocab.added.values()]
    assert all(ids == [vocab.id_of[w]] for w, ids in trie_bpe.encode_words(words, vocab).items())


def test_ids_and_texts_are_the_librarys(spark, library):
    more = ["x<|endoftext|>y", "<|endoftext|><|endoftext|> z", " <|endoftext|> ", "a <|endoftext", "tail  \n", " \t x", "z" * 3000,
            "don't 've'll'S 12 345,6\u0085  x", "ª²½ⅷ٣ ͅ á"]
    rows = [(i, t) for i, t in enumerate(ODD + more)]
    got = {r["doc_id"]: tuple(r)[1:] for r in trie_bpe.digests(docs(spark, rows), PATH).collect()}
    for d, t in rows:
        assert got[d] == expected(library, t), t


def test_several_blocks_repeated_and_null_ids(spark, library):
    rows = [(1, "a b a b"), (1, "a b a b"), (None, "c d"), (2, "")] * 5
    got = trie_bpe.encode(docs(spark, rows), PATH, block_bytes=150).collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted(
        (str(d), tuple(library.encode(t).ids)) for d, t in rows)


def test_whole_table(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in trie_bpe.query(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert set(got) == set(texts)
    assert all(got[d] == expected(library, t) for d, t in texts.items())


def test_broken_bytes_decode_as_the_library_does(spark, library):
    ids = [[i] for i in range(0, 50257, 997)] + [[166, 223], [50256, 447, 222, 50256]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in trie_bpe.decode(df, PATH).collect())


def test_empty_table(spark):
    assert trie_bpe.digests(docs(spark, []), PATH).collect() == []


def test_split_below_u0370_is_the_librarys(vocab):
    block = trie_bpe._Block(vocab)
    rng = random.Random(8)
    chars = [chr(c) for c in range(1, 0x370)]
    for text in [f"a{c}b 1{c}2 .{c}. {c}{c}  {c}" for c in chars] + ["".join(rng.choices(chars + [" ", "'", "s"] * 60, k=40)) for _ in range(2000)]:
        assert block.split(text) == [vocab.to_bytes(w).decode() for w, _ in block.pre.pre_tokenize_str(text)], repr(text)
