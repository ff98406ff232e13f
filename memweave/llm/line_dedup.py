"""Substring dedup by hashing units of lines.

Method: every line is cut into units, units are normalised (words, A-Z in lower case,
one space) and hashed, digests are grouped over all documents, the earliest
occurrence (by doc_id, then position) stays, and all others are removed; the removed
stretches are reported with their offsets in the original text.

A unit is a whole line, if it is short.  Long lines are cut where the hash of a word and the two after it
is the largest among its neighbours (the first of equals), so that a passage that stands inside a line is cut
at the same words wherever it stands; a unit then is a piece of at least ``MIN_UNIT``
words from such a cut, and units overlap.  A repeated passage of 50 words holds several.
Lines of fewer than ``MIN_LINE`` words are no units.

A stretch of repeated units is then extended word by word to both sides, as far as the words (and line
breaks) are those around the earliest occurrence of its first or last unit.  Further units would have
matched beyond ``AROUND`` units, so that the words up to there are enough.

Documents are dealt to blocks by a hash.  A block sends each distinct digest once, with
its own earliest occurrence, so that a line that stands in every document costs one row per block;
it asks once for the words around a digest.

Defined results: every row stays, with the text that is left (a null text stays null).
Null doc_ids rank last; rows that repeat a doc_id rank by block and text, and of identical rows one is
the earliest.  Other columns are carried along, whatever their names.  Digests have 64 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD_CLASS, WordHashes, cut, mix64, with_block

BLOCK_BYTES = 8 << 20
NEIGHBOURS, MIN_UNIT, MIN_LINE = 3, 10, 4
STEP_WORDS = 1 << 17
AROUND, MARGIN = 3, 8          # units, and words beyond them, that are sent around an earliest occurrence
BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(WORD_CLASS)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LAST = (1 << 63) - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Block:
    """The words of a block's texts, their lines, and (if asked for) the units of all lines.

    Lines do not need each other, so that words and their intermediate values are held for ``STEP_WORDS`` words (and the rest of the
    last one's line) at a time; numbers of words count through the block."""

    def __init__(self, texts: list[str | None], hashes: WordHashes, units: bool = True):
        words, line_sizes, doc_start = [], [], [0]
        self.n, parts = 0, []
        for text in texts:
            for x in (text or "").encode().lower().split(b"\n"):
                if len(words) >= STEP_WORDS:
                    parts.append(self._step(hashes.of(words), line_sizes, units))
                    words, line_sizes = [], []
                x = x.split()
                if x:
                    words += x
                    line_sizes.append(len(x))
            doc_start.append(self.n + len(words))
        parts.append(self._step(hashes.of(words), line_sizes, units))
        del words
        self.doc_start = np.array(doc_start, np.int64)        # words before each text
        self.line_start, self.word, *found = (np.concatenate(x) for x in zip(*parts))
        if units:
            self.begin, self.end, self.digest = found
            self.row = np.searchsorted(self.doc_start, self.begin, side="right") - 1

    def _step(self, h, line_sizes, units):
        at, n = self.n, len(h)
        self.n += n
        sizes = np.array(line_sizes, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word = h & ~np.uint64(1)                              # the last bit says whether a word opens its line
        word[starts] |= np.uint64(1)
        if not units:
            return starts + at, word
        line = np.repeat(np.arange(len(sizes)), sizes)
        following = np.append(line[1:] == line[:-1], False) if n else np.zeros(0, bool)
        after = np.where(following, np.roll(h, -1), np.uint64(0))
        key = mix64(h ^ mix64(after ^ mix64(np.where(following, np.roll(after, -1), np.uint64(0)))))
        peak = np.ones(n, bool)
        for d in range(1, NEIGHBOURS + 1):
            same = line[d:] == line[:-d]
            peak[d:] &= ~same | (key[d:] > key[:-d])
            peak[:-d] &= ~same | (key[:-d] >= key[d:])
        peak[starts] = True                                  # a line's first word opens a piece
        cuts = np.flatnonzero(peak)
        first, last = starts[line[cuts]], ends[line[cuts]]
        begin = cuts.copy()
        short = last - begin < MIN_UNIT                       # too near to the line's end: begin earlier
        back = cuts[np.maximum(np.searchsorted(cuts, last - MIN_UNIT, side="right") - 1, 0)] if n else cuts
        begin[short] = np.maximum(back, first)[short]
        bounds = np.append(cuts, n)
        end = np.minimum(bounds[np.minimum(np.searchsorted(bounds, begin + MIN_UNIT), len(bounds) - 1)], last)
        keep = end - begin >= MIN_LINE
        keep &= np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])) if n else keep
        begin, end = begin[keep], end[keep]
        total = np.append(np.uint64(0), np.cumsum(h * _powers(BASE, n)[:n], dtype=np.uint64))
        part = (total[end] - total[begin]) * _powers(_INVERSE, n)[begin]
        digest = mix64(part ^ mix64((end - begin).astype(np.uint64))).view(np.int64)
        return starts + at, word, begin + at, end + at, digest


def _ordered(table: pa.Table) -> pa.Table:
    """A block's rows in the order of doc_id and text, the same on every pass."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i], texts[i] or "", texts[i] is None))
    return table.take(pa.array(order, pa.int64()))


def clean(docs: DataFrame, block_bytes: int = BLOCK_BYTES, removed: str = "removed") -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and a column ``removed``: (begin, end) offsets in the original text.

    ``docs`` must not have a column of that column's name (give another one)."""
    other = [c for c in docs.columns if c != "text"]
    dealt = with_block(docs.select(F.struct(*other).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"),
                       block_bytes, "doc_id", "text")

    def units(key, table):
        table = _ordered(table)
        b = Block(table.column("text").to_pylist(), WordHashes())
        ids = table.column("doc_id").to_pylist()
        digest, at, n = np.unique(b.digest, return_index=True, return_counts=True)      # units lie in rank order
        row = b.row[at]
        ranks = np.array([LAST if x is None else x for x in ids], np.int64)
        return pa.table({"digest": digest, "block": np.full(len(digest), key[0].as_py(), np.int32),
                         "doc_id": ranks[row] if len(row) else np.zeros(0, np.int64), "row": row.astype(np.int32),
                         "word": (b.begin[at] - b.doc_start[row]).astype(np.int32), "n": n.astype(np.int64)})

    found = dealt.groupBy("block").applyInArrow(      # all columns, so that both passes share one shuffle
        units, "digest long, block int, doc_id long, row int, word int, n long")
    every = Window.partitionBy("digest")
    repeated = (found.withColumn("all", F.sum("n").over(every))
                .withColumn("kept", F.min(F.struct("doc_id", "block", "row", "word")).over(every)).where("all > 1")
                .select("block", "digest", F.col("kept.block").alias("from"), F.col("kept.row").alias("row"),
                        F.col("kept.word").alias("word")))

    def stretches(key, table, again):
        """The stretches of repeated units, to the own block, and what is asked of the blocks of earliest occurrences."""
        b = Block(_ordered(table).column("text").to_pylist(), WordHashes())
        own = (key[0].as_py() if len(key) else None)
        order = np.argsort(again.column("digest").to_numpy())
        digests, kept, rows, words = (again.column(c).to_numpy()[order] for c in ("digest", "from", "row", "word"))
        if not len(digests) or not len(b.digest):
            return _messages()
        at = np.minimum(np.searchsorted(digests, b.digest), len(digests) - 1)
        hit = (digests[at] == b.digest) & ~(
            (kept[at] == own) & (rows[at] == b.row) & (words[at] == b.begin - b.doc_start[b.row]))
        begin, end, at, row = b.begin[hit], b.end[hit], at[hit], b.row[hit]
        if not len(begin):
            return _messages()
        reach = np.maximum.accumulate(end)                    # begin and end rise with the unit
        opens = np.append(True, (begin[1:] > reach[:-1]) | (row[1:] != row[:-1]))
        first, last = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], len(begin)) - 1
        base = b.doc_start[row[first]]
        asked, unit = np.unique(np.append(at[first], at[last]), return_index=True)
        unit = np.append(first, last)[unit]
        return _messages(
            to=np.append(np.full(len(first), own), kept[asked]), src=np.append(np.full(len(first), -1), np.full(len(asked), own)),
            row=np.append(row[first], rows[asked]), lo=np.append(begin[first] - base, words[asked]),
            hi=np.append(end[last] - base, words[asked] + (end - begin)[unit]),
            left=np.append(digests[at[first]], digests[asked]), right=np.append(digests[at[last]], digests[asked]))

    def around(key, table, asked):
        """Stretches pass; requests are answered with the words before (and the first) and after the occurrence."""
        to, src, row, lo, hi, left, right = (asked.column(c).to_numpy() for c in _MESSAGE)
        ask = np.flatnonzero(src >= 0)
        before, after = [None] * len(to), [None] * len(to)
        if len(ask):
            need, nth = np.unique(row[ask], return_inverse=True)
            b = Block(_ordered(table).column("text").take(pa.array(need)).to_pylist(), WordHashes())
            word = b.word.view(np.int64)
            first, last = b.doc_start[nth], b.doc_start[nth + 1]
            begin, end = first + lo[ask], first + hi[ask]
            u = np.searchsorted(b.begin, begin) - AROUND
            v = np.searchsorted(b.end, end, side="right") + AROUND - 1
            low = np.maximum(np.where(u >= 0, b.begin[np.maximum(u, 0)] - MARGIN, 0), first)
            high = np.minimum(np.where(v < len(b.end), b.end[np.minimum(v, len(b.end) - 1)] + MARGIN, len(word)), last)
            for i, x, y, z, t in zip(ask.tolist(), low.tolist(), begin.tolist(), end.tolist(), high.tolist()):
                before[i], after[i] = word[x:y + 1], word[z:t]
        many = pa.list_(pa.int64())
        return pa.table({"block": np.where(src >= 0, src, to).astype(np.int32), "row": np.where(src >= 0, -1, row).astype(np.int32),
                         "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "left": left, "right": right,
                         "before": pa.array(before, many), "after": pa.array(after, many)})

    def remove(table, found_):
        table = _ordered(table)
        texts = table.column("text").to_pylist()
        spans = [[] for _ in texts]
        row, lo, hi, left, right = (found_.column(c).to_numpy() for c in ("row", "lo", "hi", "left", "right"))
        told = np.flatnonzero(row < 0)
        near = {d: i for d, i in zip(left[told].tolist(), told.tolist())}
        before, after = found_.column("before").combine_chunks(), found_.column("after").combine_chunks()
        own = np.flatnonzero(row >= 0)
        if len(own):
            need, nth = np.unique(row[own], return_inverse=True)
            b = Block([texts[i] for i in need.tolist()], WordHashes(), units=False)
            word, gone = b.word, np.zeros(len(b.word), bool)
            line_start = np.zeros(len(gone) + 1, bool)
            line_start[b.line_start] = True
            for i, k in zip(own.tolist(), nth.tolist()):
                first, last = int(b.doc_start[k]), int(b.doc_start[k + 1])
                begin, end = first + int(lo[i]), first + int(hi[i])
                x, y = (_words(column, near[d]) for column, d in ((before, int(left[i])), (after, int(right[i]))))
                gone[begin - _before(x, word[first:begin + 1]):end + _after(y, word[end:last])] = True
            for k, i in enumerate(need.tolist()):
                x, y = b.doc_start[k], b.doc_start[k + 1]
                texts[i], spans[i] = _cut(texts[i], gone[x:y], line_start[x:y])
        return pa.table({"row": table.column("row"), "text": pa.array(texts, pa.string()),
                         "removed": pa.array([[{"begin": x, "end": y} for x, y in s] for s in spans],
                                             pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})

    kind = StructType([dealt.schema["row"], StructField("text", StringType()), StructField("removed", ArrayType(StructType(
        [StructField("begin", LongType()), StructField("end", LongType())])))])
    blocks = dealt.groupBy("block")
    messages = blocks.cogroup(repeated.groupBy("block")).applyInArrow(
        lambda key, left, right: stretches(key, left, right), ", ".join(f"{c} {t}" for c, t in _MESSAGE.items()))
    known = blocks.cogroup(messages.groupBy("to")).applyInArrow(
        lambda key, left, right: around(key, left, right),
        "block int, row int, lo int, hi int, left long, right long, before array<long>, after array<long>")
    out = blocks.cogroup(known.groupBy("block")).applyInArrow(lambda left, right: remove(left, right), kind)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns],
                      F.col("removed").alias(removed))


_MESSAGE = {"to": "int", "src": "int", "row": "int", "lo": "int", "hi": "int", "left": "long", "right": "long"}


def _messages(**columns) -> pa.Table:
    kinds = {c: np.int32 if t == "int" else np.int64 for c, t in _MESSAGE.items()}
    return pa.table({c: np.asarray(columns.get(c, []), k) for c, k in kinds.items()})


def _words(column, i: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column[i].values.to_numpy().view(np.uint64)


def _run(same: np.ndarray) -> int:
    return len(same) if same.all() else int(np.argmin(same))


def _before(kept: np.ndarray, own: np.ndarray) -> int:
    """How many words agree before the last one of both; a line break counts with the word after it."""
    n = min(len(kept), len(own))
    x = kept[len(kept) - n:] ^ own[len(own) - n:]
    return _run(((x[:-1] >> np.uint64(1)) == 0)[::-1] & ((x[1:] & np.uint64(1)) == 0)[::-1])


def _after(kept: np.ndarray, own: np.ndarray) -> int:
    n = min(len(kept), len(own))
    return _run(kept[:n] == own[:n])


def _cut(text: str, gone: np.ndarray, line_start: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """The text without the marked words; a stretch that opens its line goes with the gap after it."""
    places = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    spans, out, at = [], [], 0
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        begin = places[lo][0]
        end = places[hi - 1][1]
        if line_start[lo]:
            end = places[hi][0] if hi < len(places) else len(text)
        out.append(text[at:begin])
        spans.append((begin, end))
        at = end
    return "".join([*out, text[at:]]), spans


def query(spark, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean(docs).select("doc_id", F.size("removed").alias("n_removed"), F.coalesce(F.aggregate(
        "removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"]), F.lit(0)).alias("removed_chars"),
        "removed", "text")
