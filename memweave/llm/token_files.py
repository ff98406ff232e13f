"""Token-id files with shuffled planes.

Method: ids are cut into blocks of a fixed size, each block is transposed into
byte planes (or bit planes), every plane is compressed with zstandard, and a
chunk index holds where each block's planes lie.  A *segment* is one file image:

    header | doc ids | doc lengths | chunk index | planes

Documents are dealt by ranges of doc_id, sorted within each range, encoded and
written as segments of whole documents through Spark's own committing writer (one row of
``part, seq, n_ids, n_docs, segment`` each), so that a repeated task replaces its
output.  Readers open segments independently; ``start`` comes from sums over
the segments' counts.

Defined results: a null or empty text has only the end id.  Rows of null doc_id
come first; rows that repeat a doc_id follow each other in the order of their texts.  An
empty table gives an empty file set.  Other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import ensure_checkpoint_dir
from .common import byte_strings

BLOCK_IDS = 16_384
SEGMENT_IDS = 1 << 19
HEADER = struct.Struct("<4sBBHIQQQ")     # magic, planes of 1 or 8 bits, validity, 0, block, ids, docs, blocks
MAGIC = b"TPLN"
NO_ID = 0xFFFFFFFF
NO_ID_BYTES = b"\xff\xff\xff\xff"


# ------------------------------------------------------------- file format
def _to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 1:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        return [zstandard.compress(row.tobytes(), 3) for row in raw]
    return [zstandard.compress(np.ascontiguousarray(raw[:, k]).tobytes(), 3) for k in range(4)]


def _from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes])
    if bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def pack_segment(doc_ids: list, ids: list[np.ndarray], bits: int = 8, block: int = BLOCK_IDS) -> bytes:
    """The file image of some documents; ``bits``: 8 for byte planes, 1 for bit planes."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    keys = zstandard.compress(valid.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes(), 3)
    sizes = zstandard.compress(np.array([len(x) for x in ids], "<u8").tobytes(), 3)
    index, payload, at = [], [], 0
    for lo in range(0, len(flat), block):
        planes = _to_planes(flat[lo: lo + block], bits)
        index.append(struct.pack(f"<QI{len(planes)}I", at, len(flat[lo: lo + block]), *map(len, planes)))
        payload += planes
        at += sum(map(len, planes))
    head = HEADER.pack(MAGIC, bits, 0, 0, block, len(flat), len(ids), len(index))
    return b"".join([head, struct.pack("<II", len(keys), len(sizes)), keys, sizes, *index, *payload])


def open_segment(image: bytes):
    """(doc ids, doc lengths, read) of a file image; ``read(lo, hi)`` gives the ids in that range."""
    magic, bits, _, _, block, n_ids, n_docs, n_blocks = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    k, s = struct.unpack_from("<II", image, at)
    at += 8
    keys = zstandard.decompress(image[at: at + k])
    doc_ids = np.frombuffer(keys, "<i8", offset=n_docs).tolist()
    doc_ids = [d if v else None for d, v in zip(doc_ids, keys[:n_docs])]
    sizes = np.frombuffer(zstandard.decompress(image[at + k: at + k + s]), "<u8").astype(np.int64)
    at += k + s
    entry = struct.Struct(f"<QI{4 if bits == 8 else 32}I")
    base = at + entry.size * n_blocks

    def read(lo: int, hi: int) -> np.ndarray:
        out = []
        for b in range(lo // block, -(-hi // block)):
            offset, n, *lengths = entry.unpack_from(image, at + b * entry.size)
            ends = base + offset + np.concatenate([[0], np.cumsum(lengths)])
            got = _from_planes([image[i:j] for i, j in zip(ends, ends[1:])], n, bits)
            out.append(got[max(0, lo - b * block): hi - b * block])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)
    return doc_ids, sizes, read


# ------------------------------------------------------------------ encoder
@lru_cache(maxsize=2)
def _encoder(spec: str) -> "_WordEncoder":
    return _WordEncoder(spec)


class _Pieces(dict):
    """A piece of a normalised word -> its ids as bytes; a space -> the mark NO_ID."""

    def __init__(self, tok: Tokenizer, byte_chars: dict):
        super().__init__()
        self.model, self.byte_chars = tok.model, byte_chars

    def __missing__(self, piece: str) -> bytes:
        if piece == " ":
            self[piece] = NO_ID_BYTES
            return NO_ID_BYTES
        mapped = piece                                     # printable ASCII stands for its own bytes
        if not (piece.isascii() and piece.isprintable()):
            mapped = piece.encode().decode("latin-1").translate(self.byte_chars)
        got = self[piece] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got


def _only_lowers_ascii(step: dict | None) -> bool:
    """Whether a normaliser makes ASCII words with single spaces between them lower-case, and nothing else."""
    steps = [x for x in (step or {}).get("normalizers", [step]) if x]
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    return ({"type": "Lowercase"} in steps
            and all(x in ({"type": "Lowercase"}, {"type": "NFC"}, {"type": "NFKC"}, blanks) for x in steps))


class _WordEncoder:
    """Encodes texts with a ``tokenizers`` file, each distinct word once while it is remembered.

    White space ends every match of such a tokenizer's split pattern, so a
    text's ids are those of its words one after another.  A tokenizer that
    normalises, splits by a pattern and then maps bytes is run step by step on many words
    at a time; any other step, and any word that holds white space beyond ASCII or a special
    token, goes through ``encode`` as it is.
    """

    def __init__(self, spec: str, bound: int = 500_000):
        self.tok = Tokenizer.from_str(spec)
        self.bound, self.words = bound, {}
        told = json.loads(spec)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.split = None
        if ([s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed"
                and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
                and self.tok.normalizer and "Regex" in steps[0]["pattern"]):
            self.split = regex.compile(steps[0]["pattern"]["Regex"] + "| ")
        self.lowers = _only_lowers_ascii(told.get("normalizer"))
        added = [regex.escape(a["content"]) for a in told.get("added_tokens") or []]
        self.odd = regex.compile("|".join([r"\s", *added]))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.pieces = _Pieces(self.tok, {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> None:
        if len(self.pieces) > self.bound:
            self.pieces.clear()
        plain = b" ".join(new).decode()                    # distinct words without blanks
        if self.split is None or self.odd.search(plain.replace(" ", "")):
            odd = [w for w in new if self.split is None or self.odd.search(w.decode())]
            self.words.update((w, self._whole(w.decode())) for w in odd)
            new = list(set(new).difference(odd))
        if not new:
            return
        lowered = [w for w in new if w.isascii()] if self.lowers else []
        rest = [w for w in new if not w.isascii()] if self.lowers else new
        new = lowered + rest
        normal = " ".join([b" ".join(lowered).decode().lower()] * bool(lowered)
                          + [self.tok.normalizer.normalize_str(b" ".join(rest).decode())] * bool(rest))
        if normal.count(" ") != len(new) - 1:          # a normaliser that makes or drops spaces
            normal = " ".join(self.tok.normalizer.normalize_str(w.decode()) for w in new)
        # all pieces of all words at once; a space stands between two words and becomes the mark NO_ID
        ids = b"".join(map(self.pieces.__getitem__, self.split.findall(normal)))
        ends = [*(4 * np.flatnonzero(np.frombuffer(ids, "<u4") == NO_ID)).tolist(), len(ids)]
        if len(ends) != len(new):
            raise ValueError("the tokenizer's words can't be told apart")
        lo = 0
        for w, hi in zip(new, ends):
            self.words[w] = ids[lo:hi]
            lo = hi + 4

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text.  Arrow splits and numbers the words; Python sees each distinct one."""
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        distinct = byte_strings(numbered.dictionary)
        self.words[b""] = b""                              # what stands before a leading blank
        got = list(map(self.words.get, distinct))
        new = [k for k, ids in enumerate(got) if ids is None]
        if new:
            if len(self.words) + len(new) > self.bound:
                self.words.clear()
            self._learn([distinct[k] for k in new])
            for k in new:
                got[k] = self.words[distinct[k]]
        flat = np.frombuffer(b"".join(got), "<u4")
        width = np.fromiter(map(len, got), np.int64, len(got)) // 4
        start = np.cumsum(width) - width
        at = numbered.indices.to_numpy()
        here = width[at]
        stop = np.cumsum(here)
        ids = flat[np.repeat(start[at] - (stop - here), here) + np.arange(stop[-1] if len(stop) else 0)]
        words = split.value_lengths().to_numpy()
        return np.split(ids, np.append(0, stop)[np.cumsum(words)][:-1])


# ----------------------------------------------------------------- write, read
def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, bits: int = 8) -> None:
    """Encode all documents in ascending doc_id order and write their ids as segments under ``path``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())       # the vocabulary: a file of fixed size

    def run(batches):
        enc, part, seq = _encoder(spec.value), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0
        end = np.array([end_id], np.uint32)

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([pack_segment(doc_ids, ids, bits)], pa.binary())],
                names=["part", "seq", "n_ids", "n_docs", "segment"])
        for batch in batches:
            keys, col = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            lengths, lo = pc.binary_length(col).to_numpy(), 0
            while lo < len(keys):
                hi, size = lo, 0
                while hi < len(keys) and size < 1 << 22:
                    size += lengths[hi] + 64
                    hi += 1
                for key, got in zip(keys[lo:hi], enc.batch(col[lo:hi])):
                    doc_ids.append(key)
                    ids.append(np.concatenate([got, end]))
                    held += len(got) + 1
                    if held >= SEGMENT_IDS:
                        yield row()
                        doc_ids, ids, held, seq = [], [], 0, seq + 1
                lo = hi
        if ids:
            yield row()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "part int, seq int, n_ids long, n_docs long, segment binary")
     .write.option("compression", "none").parquet(path))


def _documents(batches):
    """Of each segment read back: columns part, seq, doc_id and offset, where its documents end, and all of its ids."""
    for batch in batches:
        for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "segment"))):
            doc_ids, sizes, get = open_segment(image.as_py())
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield [pa.array(np.full(len(sizes), part.as_py(), np.int32)),
                   pa.array(np.full(len(sizes), seq.as_py(), np.int32)), pa.array(doc_ids, pa.int64()),
                   pa.array(ends[:-1])], ends, get(0, int(ends[-1]))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("part", "seq", "segment")


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, offset (within its segment), ids array<int> of every document."""
    def run(batches):
        for columns, ends, flat in _documents(batches):
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))],
                names=["part", "seq", "doc_id", "offset", "ids"])
    return _segments(spark, path).mapInArrow(run, "part int, seq int, doc_id long, offset long, ids array<int>")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: ids before each segment, from the counts alone (part sums first, then within a part)."""
    counts = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = counts.select("part", "seq", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    return inner.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inner")).alias("base"))


def digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, bits: int = 8) -> DataFrame:
    """Write the ids, read the files back, and derive one row per document where its ids are read."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/token-files-{spark.range(1).select(F.uuid()).first()[0]}"
    write(docs, path, tokenizer_path, end_id, bits)

    def crc(batches):
        for columns, ends, flat in _documents(batches):
            raw = memoryview(np.ascontiguousarray(flat, "<u4").view(np.uint8))
            at = (4 * ends).tolist()
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(ends)), pa.array([zlib.crc32(raw[lo:hi]) for lo, hi in zip(at, at[1:])], pa.int64())],
                names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])
    rows = _segments(spark, path).mapInArrow(
        crc, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, path), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ..sources.tables import read_table
    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
