"""Helpers shared by the operators of this subpackage.

Words are maximal runs of characters other than space and the control
characters 0x09-0x0D.  In UTF-8 that is exactly ``bytes.split()``, and
``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

GAP_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser), vectorised."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered; emptied when it holds ``bound`` words."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_strings(words: pa.Array) -> list[bytes]:
    """The values of a string array without nulls, cut from its buffer: several times faster than one Arrow scalar for each."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset).tolist() if len(words) else [0]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[lo:hi] for lo, hi in zip(at, at[1:])]


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def with_block(docs: DataFrame, block_bytes: int, *key: str) -> DataFrame:
    """Deal rows to blocks of about ``block_bytes`` of text by a hash of id and text.

    One pass over the text lengths sets the number of blocks.  The rows are
    repartitioned by ``block``, so that every later step by block shares that
    one shuffle.
    """
    total = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, math.ceil(((total[0] or 0) + 64 * total[1]) / block_bytes))
    return (docs.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
            .repartition(n, "block"))


def n_words(text: Column) -> Column:
    """Number of words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")
