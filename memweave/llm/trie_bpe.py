"""BPE encoding and decoding by traversing a trie of the corpus's distinct words.

Method: the last token of a word's encoding is a state of the word's prefix.  With ``last(p)`` known for all shorter
prefixes, ``last(p)`` is the one token ``t`` that ends ``p`` and fits after ``last(p without t)``; two tokens fit if no merge
across their border comes before the merges that made them.  So the distinct words of the corpus are inserted into a trie, its nodes are
visited depth first, and each node's last token follows from its ancestors': a prefix that many words share is encoded once.  A word's
ids are read by walking up from its node, one token's length at a time.

The words of a text are those of the tokenizer's own split; texts go to *blocks* of some 8 MB, which hold their
distinct words and, for every position, the number of the word there.  A block sends its words, packed, to the shards of
their prefixes (of the greatest power of two bytes below their length, so that words of one subtree meet); a shard builds the trie of
all distinct words that it gets and replies to each block.  A frequent word costs one entry a block, a hot
prefix no more than its distinct words.  Decoding looks up each id in the table of token bytes.

Blocks depend on the order of the input's rows, so the input should be a table.  A reply that does not fit its block raises.

Defined results: as the tokenizers library encodes whole texts without adding special tokens and decodes without skipping them; the
string of an added token in a text is that token.  A null or empty text has no ids and decodes to an empty text.  Every
input row gives one output row, also if its doc_id repeats or is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .bpe import _pack, _planes, _unpack, _unplane, _words_of, _words_packed

BLOCK_BYTES = 8 << 20
SLICE_DOCS = 500                      # texts of a block whose ids are put together at a time
ADDED = b"\xff"                       # marks an added token among the words: no UTF-8 text holds this byte
# fixed value: the split pattern of byte-level tokenizer files
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
ODD_SPACE = re.compile(r" (?=\s|\Z)")  # a space that does not open a word


# ------------------------------------------------------------- vocabulary
class Added:
    """The added tokens of a byte-level file, and the bytes that its characters stand for."""

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    byte_of = {**{b: b for b in shown}, **{256 + k: b for k, b in enumerate(hidden)}}

    def __init__(self, added: dict[str, int]):
        self.added = added

    def to_bytes(self, mapped: str) -> bytes:
        return mapped.translate(self.byte_of).encode("latin-1")


class Vocabulary(Added):
    """The tables of a byte-level BPE file: token bytes, merge ranks, and the two parts of every merged token."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        added = told.get("added_tokens") or []
        if (model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or told.get("normalizer")
                or model.get("ignore_merges") or not pre.get("use_regex", True) or (told.get("decoder") or {}).get("type") != "ByteLevel"
                or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip"))):
            raise ValueError("not a plain byte-level BPE file")
        super().__init__({a["content"]: a["id"] for a in added})
        self.id_of = {self.to_bytes(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.birth: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.id_of[self.to_bytes(x)], self.id_of[self.to_bytes(y)]
            whole = self.id_of[self.to_bytes(x + y)]
            if whole in self.birth:
                raise ValueError("a token that two merges make")
            self.rank[a, b], self.parts[whole], self.birth[whole] = r, (a, b), r
        # what a token may end with, and the token that this is
        self.ends = {t[k:]: -1 for t in self.id_of for k in range(len(t))} | self.id_of
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.fit: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        got = self.fit.get((a, b))
        if got is None:
            if len(self.fit) > 200_000:
                self.fit.clear()
            got = self.fit[a, b] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Whether the text of a and b is encoded as these two: undo their merges from the last one back, and see that
        no merge across the border would have come while both its parts were there (of equal ranks the left one is first)."""
        birth, limit, from_right = self.birth, 1 << 62, False
        while True:
            r = self.rank.get((a, b))
            if r is not None and (r < limit or r == limit and from_right):
                return False
            born_a, born_b = birth.get(a, -1), birth.get(b, -1)
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                limit, from_right, a = born_a, False, self.parts[a][1]
            else:
                limit, from_right, b = born_b, True, self.parts[b][0]


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


@lru_cache(maxsize=2)
def _token_bytes(spec: str) -> dict[int, bytes]:
    """Token id -> its bytes: all that decoding needs of a vocabulary file."""
    told, to_bytes = json.loads(spec), Added({}).to_bytes
    return ({i: to_bytes(t) for t, i in told["model"]["vocab"].items()}
            | {a["id"]: a["content"].encode() for a in told.get("added_tokens") or []})


def encode_words(words: list[bytes], vocab: Vocabulary) -> dict[bytes, list[int]]:
    """Ids of distinct words through their trie.

    Sorted words insert the trie's nodes in depth-first order, so one stack holds the states of the path to the
    node at hand: the last token of every prefix, set when the node is first visited.
    """
    out: dict[bytes, list[int]] = {}
    bytes_of, end, fits = vocab.bytes_of, vocab.ends.get, vocab.fits
    last: list[int] = [-1]                        # last[d]: last token of the path's first d bytes; the root has none
    before = b""
    for word in sorted(words):
        d = len(os.path.commonprefix((before, word)))
        del last[d + 1:]
        for d in range(d + 1, len(word) + 1):
            found, k = [], d - 1
            while k >= 0:                         # every end of the path that a token may have; the longest is tried first
                t = end(word[k:d])
                if t is None:
                    break
                if t >= 0:
                    found.append((k, t))
                k -= 1
            for k, t in reversed(found):
                if k == 0 or fits(last[k], t):
                    last.append(t)
                    break
            else:
                raise ValueError("bytes that no token holds")
        ids, d = [], len(word)
        while d:
            ids.append(last[d])
            d -= len(bytes_of[last[d]])
        out[word] = ids[::-1]
        before = word
    return out


# ------------------------------------------------------------------ blocks
class _Stretches(dict):
    """A stretch of text that begins a word -> the numbers of its words, as uint32 bytes."""

    def __init__(self, split, numbers: dict, opening: str):
        super().__init__()
        self.split, self.numbers, self.opening = split, numbers, opening

    def __missing__(self, stretch: str) -> bytes:
        numbers = self.numbers
        got = self[stretch] = array("I", [numbers.setdefault(w, len(numbers)) for w in self.split(self.opening + stretch)]).tobytes()
        return got


class _Block:
    pre = ByteLevel(add_prefix_space=False, use_regex=True)

    def __init__(self, vocab: Added):
        self.vocab = vocab
        self.numbers: dict = {}
        self.heads, self.tails = _Stretches(self.split, self.numbers, ""), _Stretches(self.split, self.numbers, " ")
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True))) + ")") if vocab.added else None
        self.ids, self.parts, self.held = [], [], 0

    def split(self, text: str) -> list[str]:
        """The library's own split.  Below U+0370 its character classes are those of all Unicode versions since 5.0, and
        its pattern can be matched here; other texts go through the library."""
        if text.isascii() or max(text) < "\u0370":
            return WORDS(text)
        return [self.vocab.to_bytes(w).decode() for w, _ in self.pre.pre_tokenize_str(text)]

    def plain(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            numbers = self.numbers
            return array("I", [numbers.setdefault(w, len(numbers)) for w in self.split(text)]).tobytes()
        head, *rest = text.split(" ")
        return self.heads[head] + b"".join(map(self.tails.__getitem__, rest))

    def add(self, doc_id, text: str) -> None:
        self.ids.append(doc_id)
        self.held += len(text) + 64
        pieces = self.added.split(text) if self.added else [text]
        got = [self.plain(pieces[0])]
        for token, piece in zip(pieces[1::2], pieces[2::2]):
            number = self.numbers.setdefault((token,), len(self.numbers))
            got += [np.array([number], np.uint32).tobytes(), self.plain(piece)]
        self.parts.append(b"".join(got))

    def row(self, block: int) -> pa.RecordBatch:
        self.heads.clear()                                            # a finished block needs its words' numbers only
        self.tails.clear()
        at = np.frombuffer(b"".join(self.parts), np.uint32)
        order = np.argsort(-np.bincount(at, minlength=len(self.numbers)), kind="stable")
        new = np.empty(len(order), np.uint32)
        new[order] = np.arange(len(order), dtype=np.uint32)           # frequent words get small numbers, which pack well
        words = [ADDED + w[0].encode() if isinstance(w, tuple) else w.encode() for w in self.numbers]
        sizes = np.fromiter((len(p) // 4 for p in self.parts), np.uint32, len(self.parts))
        known = np.array([d is not None for d in self.ids], np.uint8).tobytes()
        ids = np.array([d or 0 for d in self.ids], "<i8").tobytes()
        payload = _pack(zstandard.compress(known + ids, 3), _planes(sizes), _planes(new[at]), _words_packed([words[i] for i in order]))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())],
                                          names=["block", "payload"])


def _shard_of(words: list[bytes], shards: int) -> np.ndarray:
    hashes: dict[bytes, int] = {}
    out = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        prefix = w[:1 << max(0, (len(w) - 1).bit_length() - 1)]
        h = hashes.get(prefix)
        if h is None:
            h = hashes[prefix] = xxhash.xxh32_intdigest(prefix) % shards
        out[i] = h
    return out


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([r[1] for r in rows], pa.int32()),
                     "packed": pa.array([r[2] for r in rows], pa.binary())})


MESSAGE = "block long, shard int, packed binary"


def encode(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())               # the vocabulary: a file of fixed size
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocab = Added(Vocabulary(spec.value).added)            # splitting needs no tables

    def make(batches):
        number, held = TaskContext.get().partitionId() << 32, _Block(vocab)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                held.add(doc_id, text.as_py() or "")
                if held.held >= block_bytes:
                    yield held.row(number)
                    number, held = number + 1, _Block(vocab)
        if held.ids:
            yield held.row(number)
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "block long, payload binary").repartition("block")

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                words = _words_of(_unpack(payload.as_py(), 4)[3])
                of = _shard_of(words, shards)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shards + 1)).tolist()
                for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        yield from _messages([(block, s, _words_packed([words[i] for i in order[lo:hi]]))]).to_batches()

    def traverse(key, sent):
        vocab = _vocabulary(spec.value)
        asked = [_words_of(p.as_py()) for p in sent.column("packed")]
        distinct = set().union(*asked)
        plain = [w for w in distinct if not w.startswith(ADDED)]
        ids = {w: np.array(x, np.uint32).tobytes() for w, x in encode_words(plain, vocab).items()}
        ids |= {w: np.array([vocab.added[w[1:].decode()]], np.uint32).tobytes() for w in distinct.difference(plain)}
        out = []
        for block, words in zip(sent.column("block").to_pylist(), asked):
            got = [ids[w] for w in words]
            sizes = np.fromiter((len(x) // 4 for x in got), np.uint32, len(got))
            out.append((block, key[0].as_py(), _pack(_planes(sizes), _planes(np.frombuffer(b"".join(got), np.uint32)))))
        return _messages(out)
    coded = blocks.mapInArrow(send, MESSAGE).repartition(shards, "shard").groupBy("shard").applyInArrow(traverse, MESSAGE)

    def put_together(block, replies):
        if block.num_rows != 1:
            raise ValueError("a block was lost: the input's rows came in another order when it was made again")
        keys, sizes, at, words = _unpack(block.column("payload")[0].as_py(), 4)
        sizes, at, keys = _unplane(sizes).astype(np.int64), _unplane(at).astype(np.int64), zstandard.decompress(keys)
        known = np.frombuffer(keys, np.uint8, len(sizes)).astype(bool)
        of = _shard_of(_words_of(words), shards)
        width, start, flat, held = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), [], 0
        for shard, packed in zip(replies.column("shard").to_pylist(), replies.column("packed")):
            n, ids = map(_unplane, _unpack(packed.as_py(), 2))
            mine = np.flatnonzero(of == shard)
            width[mine] = n                        # raises if the lengths differ
            start[mine] = held + np.append(0, np.cumsum(n.astype(np.int64)))[:-1]
            held += len(ids)
            flat.append(ids)
        if len(flat) != len(np.unique(of)):
            raise ValueError("a reply is missing")
        flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        cuts, out = np.append(0, np.cumsum(sizes)), []
        for lo in range(0, len(sizes), SLICE_DOCS):            # what stands beside the ids grows with a slice, not with the block
            hi = min(lo + SLICE_DOCS, len(sizes))
            word = at[cuts[lo]: cuts[hi]]
            here = width[word]
            stop = np.append(0, np.cumsum(here))
            take = np.repeat(start[word] - stop[:-1], here) + np.arange(stop[-1])
            ends = stop[cuts[lo: hi + 1] - cuts[lo]]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(keys, "<i8", hi - lo, len(sizes) + 8 * lo), mask=~known[lo:hi]),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[take]))], names=["doc_id", "ids"]))
        return pa.Table.from_batches(out)
    coded = coded.select(F.col("block").alias("of"), "shard", "packed")
    return blocks.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(put_together, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, decoded (string): the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        token = _token_bytes(spec.value).__getitem__
        for batch in batches:
            got = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace")
                   for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = [hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) for x in b.column("ids")], pa.int64()), pa.array(ids, pa.string()),
                 b.column("decoded_sha256")], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    both = decode(encode(docs, tokenizer_path, block_bytes), tokenizer_path)
    return both.select("doc_id", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ..sources.tables import read_table
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
