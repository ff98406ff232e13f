import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memweave.llm import token_files as tf
from memweave.llm.common import byte_strings

from .helpers import ODD, docs

FILE = P.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-2**62, 2**62)),
                          st.lists(st.integers(0, 2**32 - 1), max_size=60)), max_size=12),
       st.sampled_from([1, 8]), st.integers(1, 40))
def test_segments_round_trip(rows, bits, block):
    image = tf.pack_segment([d for d, _ in rows], [np.array(x, np.uint32) for _, x in rows], bits, block)
    ids, sizes, read = tf.open_segment(image)
    assert ids == [d for d, _ in rows] and sizes.tolist() == [len(x) for _, x in rows]
    flat = [i for _, x in rows for i in x]
    assert read(0, len(flat)).tolist() == flat
    assert read(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3: len(flat) // 2]


def test_not_a_segment():
    with pytest.raises(ValueError):
        tf.open_segment(b"\0" * 64)


@pytest.mark.parametrize("bits", [1, 8])
def test_rows_equal_the_library(spark, bits, monkeypatch):
    tok = Tokenizer.from_file(FILE)
    rows = sorted([(i * 7 - 3, t) for i, t in enumerate(ODD)])
    got = sorted(map(tuple, tf.digests(docs(spark, rows), FILE, bits=bits).collect()))
    start, want = 0, []
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_words_one_by_one_equal_whole_texts():
    with open(FILE, encoding="utf-8") as f:
        enc = tf._WordEncoder(f.read(), bound=50)
    tok = Tokenizer.from_file(FILE)
    texts = [t or "" for t in ODD] + ["é cafés", "İ ẞ ǅ ﬁ", "á̧b", "1234 5.6e7", "don't 'S 'RE", "a'll'm"]
    for _ in range(3):
        assert [x.tolist() for x in enc.batch(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_null_repeated_and_empty(spark):
    rows = [(3, "b"), (None, "a"), (3, "a"), (3, "b")]
    got = sorted(map(tuple, tf.digests(docs(spark, rows), FILE).collect()), key=lambda r: r[1])
    assert [(r[0], r[1]) for r in got] == [(None, 0), (3, 2), (3, 4), (3, 6)]
    assert tf.digests(docs(spark, []), FILE).collect() == []


def test_only_words_beyond_ascii_meet_the_normaliser():
    with open(FILE, encoding="utf-8") as f:
        enc = tf._WordEncoder(f.read())
    met = []

    class Tok:
        normalizer = property(lambda self: self)

        def normalize_str(self, text):
            met.extend(text.split(" "))
            return tok.normalizer.normalize_str(text)

    tok, enc.tok = enc.tok, Tok()
    got = enc.batch(pa.array(["The CAFÉ, the 3 Ünits", "PLAIN words"]))
    assert sorted(met) == ["CAFÉ,", "Ünits"]
    assert [x.tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in ("The CAFÉ, the 3 Ünits", "PLAIN words")]


@pytest.mark.parametrize("normalizer, lowers", [
    (None, False), ({"type": "Lowercase"}, True), ({"type": "NFC"}, False),
    ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]}, True),
    ({"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "Strip"}]}, False),
    ({"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": "a"}, "content": ""}]}, False)])
def test_which_normalisers_only_lower_ascii(normalizer, lowers):
    assert tf._only_lowers_ascii(normalizer) is lowers


def test_byte_strings_of_slices():
    words = pa.array(["a", "", "äb", "c\0d", "e" * 40])
    for got in (words, words[1:4], words[5:], words.cast(pa.large_string())[2:], words[:0]):
        assert byte_strings(got) == [w.encode() for w in got.to_pylist()]
