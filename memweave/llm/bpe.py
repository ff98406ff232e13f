"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Method: pre-tokens are exploded with their positions, each distinct word of the
corpus is encoded once, its ids go back to where the word stands, and the text's
ids are put together by position.  Positions are kept per *block* (some 8 MB of
texts): a block holds its distinct words and, for every position, the number
of the word there.  A block sends its distinct words to the shards of their hashes, packed; a
shard encodes each word that it gets once, whatever the number of blocks that sent it, and
replies to each block in the order of its words.  The most frequent word so costs one
entry per block and not one per occurrence.  Decoding looks up each id in the table of
token bytes, which has the fixed size of the vocabulary.

Blocks are shuffled once and read from that shuffle by both sides.  They depend on the
order of the input's rows, so the input should be a table (a written one does): a lost
executor's blocks are then made again as they were.  A reply that does not fit its block raises.

Defined results: a null or empty text has no ids and decodes to no bytes.  Every
input row gives one output row, also if its doc_id repeats or is null.  Text that
looks like a special token is ordinary text.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BLOCK_BYTES = 8 << 20
STEP_TOKENS = 1 << 18
MISSED = re.compile(r" (?=\s|\Z)")   # a space that does not open a token: such texts are matched whole


@lru_cache(maxsize=4)
def _ranks(table: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines()) if a}


@lru_cache(maxsize=4)
def _piece_encoder(table: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(table), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(table: bytes) -> list[bytes]:
    ranks = _ranks(table)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


class _Numbered(dict):
    """A stretch of text -> the numbers of its pre-tokens, as uint32 bytes."""

    def __init__(self, find, numbers: dict, prefix: str):
        super().__init__()
        self.find, self.numbers, self.prefix = find, numbers, prefix

    def __missing__(self, part: str) -> bytes:
        numbers = self.numbers
        got = self[part] = np.array([numbers.setdefault(w, len(numbers)) for w in self.find(self.prefix + part)],
                                    np.uint32).tobytes()
        return got


def _planes(a: np.ndarray) -> bytes:
    flat = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(flat).tobytes(), 3)


def _unplane(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(flat.T).view("<u4").ravel()


def _pack(*parts: bytes) -> bytes:
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def _unpack(b: bytes, n: int) -> list[bytes]:
    ends = 8 * n + np.append(0, np.cumsum(np.frombuffer(b, "<i8", n)))
    return [b[i:j] for i, j in zip(ends, ends[1:])]


def _words_packed(words: list[bytes]) -> bytes:
    return _pack(_planes(np.fromiter(map(len, words), np.uint32, len(words))), zstandard.compress(b"".join(words), 3))


def _words_of(b: bytes) -> list[bytes]:
    sizes, data = _unpack(b, 2)
    data = zstandard.decompress(data)
    ends = np.append(0, np.cumsum(_unplane(sizes).astype(np.int64))).tolist()
    return [data[i:j] for i, j in zip(ends, ends[1:])]


def _shards(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) % n for w in words), np.int32, len(words))


def _block_row(block: int, doc_ids: list, parts: list[bytes], numbers: dict) -> pa.RecordBatch:
    at = np.frombuffer(b"".join(parts), np.uint32)
    counts = np.bincount(at, minlength=len(numbers))
    order = np.argsort(-counts, kind="stable")         # frequent words get small numbers, which pack well
    new = np.empty(len(order), np.uint32)
    new[order] = np.arange(len(order), dtype=np.uint32)
    words = [w.encode() for w in numbers]
    n = np.fromiter((len(p) // 4 for p in parts), np.uint32, len(parts))
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    payload = _pack(zstandard.compress(known + ids, 3), _planes(n), _planes(new[at]), _words_packed([words[i] for i in order]))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())],
                                      names=["block", "payload"])


def _blocks(docs: DataFrame, pattern: str, block_bytes: int) -> DataFrame:
    def run(batches):
        find = regex.compile(pattern).findall
        base, seq = TaskContext.get().partitionId() << 32, 0

        def fresh():
            numbers: dict[str, int] = {}
            return numbers, _Numbered(find, numbers, ""), _Numbered(find, numbers, " "), [], []
        numbers, heads, tails, ids, parts = fresh()
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                if MISSED.search(text):
                    got = np.array([numbers.setdefault(w, len(numbers)) for w in find(text)], np.uint32).tobytes()
                else:
                    head, *rest = text.split(" ")
                    got = heads[head] + b"".join(map(tails.__getitem__, rest))
                ids.append(doc_id)
                parts.append(got)
                held += len(text) + 64
                if held >= block_bytes:
                    yield _block_row(base + seq, ids, parts, numbers)
                    numbers, heads, tails, ids, parts = fresh()
                    held, seq = 0, seq + 1
        if ids:
            yield _block_row(base + seq, ids, parts, numbers)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "block long, payload binary")


ROW = "block long, shard int, packed binary"


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([r[1] for r in rows], pa.int32()),
                     "packed": pa.array([r[2] for r in rows], pa.binary())})


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids array<int>: byte-level BPE ids of every whole text."""
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())      # the vocabulary: a file of fixed size
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, pattern, block_bytes).repartition("block")

    def send(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                words = _words_of(_unpack(payload.as_py(), 4)[3])
                of = _shards(words, shards)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shards + 1)).tolist()
                for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        yield from _rows([(block, s, _words_packed([words[i] for i in order[lo:hi]]))]).to_batches()

    def encode_words(key, sent):
        enc = _piece_encoder(table.value)
        known: dict[bytes, bytes] = {}
        out = []
        for block, packed in zip(sent.column("block").to_pylist(), sent.column("packed")):
            got = []
            for w in _words_of(packed.as_py()):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(enc.encode_ordinary(w.decode()), np.uint32).tobytes()
                got.append(ids)
            sizes = np.fromiter((len(x) // 4 for x in got), np.uint32, len(got))
            out.append((block, key[0].as_py(), _pack(_planes(sizes), _planes(np.frombuffer(b"".join(got), np.uint32)))))
        return _rows(out)

    coded = blocks.mapInArrow(send, ROW).repartition(shards, "shard").groupBy("shard").applyInArrow(encode_words, ROW)

    def assemble(block, replies):
        if block.num_rows != 1:
            raise ValueError("a block was lost: the input's rows came in another order when it was made again")
        doc_ids, n, at, words = _unpack(block.column("payload")[0].as_py(), 4)
        doc_ids = zstandard.decompress(doc_ids)
        n, at = _unplane(n).astype(np.int64), _unplane(at)
        valid = np.frombuffer(doc_ids, np.uint8, len(n)).astype(bool)
        doc_ids = pa.array(np.frombuffer(doc_ids, "<i8", offset=len(n)), mask=~valid)
        of = _shards(_words_of(words), shards)
        sizes, flat = np.zeros(len(of), np.int64), []
        place = np.zeros(len(of), np.int64)
        held = 0
        for shard, packed in zip(replies.column("shard").to_pylist(), replies.column("packed")):
            width, ids = map(_unplane, _unpack(packed.as_py(), 2))
            mine = np.flatnonzero(of == shard)
            sizes[mine] = width                        # of another length, were the block another one
            place[mine] = held + np.append(0, np.cumsum(width.astype(np.int64)))[:-1]
            held += len(ids)
            flat.append(ids)
        if len(of) and len(flat) != len(np.unique(of)):
            raise ValueError("a reply is missing")
        flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        stop, ids = np.cumsum(sizes[at]), [flat[:0]]
        for k in range(0, len(at), STEP_TOKENS):           # a step's places are held at a time
            some = at[k:k + STEP_TOKENS]
            width = sizes[some]
            first = np.cumsum(width) - width
            ids.append(flat[np.repeat(place[some] - first, width) + np.arange(width.sum())])
        ends = np.append(0, stop)[np.append(0, np.cumsum(n))]
        return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids)))})

    coded = coded.select(F.col("block").alias("of"), "shard", "packed")
    return blocks.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(assemble, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that ``ids`` stand for."""
    with open(ranks_path, "rb") as f:
        table = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        token = _token_bytes(table.value).__getitem__
        for batch in batches:
            got = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None
                   for x in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(got, pa.binary()))
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    both = decode(encode(docs, ranks_path, pattern), ranks_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ..sources.tables import read_table
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                   public_tokenizers.PATTERN)
