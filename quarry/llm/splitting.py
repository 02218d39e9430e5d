"""Problem 3: cut oversized texts at natural boundaries, consecutive pieces overlapping.

Per text: character and word prefix sums, and sorted arrays of boundaries (paragraph, line,
sentence, clause, word).  Each piece ends at the last boundary of the strongest kind that
lies in the second half of the largest allowed piece, found by binary search; the next
piece starts the overlap further back.  A text without any boundary is cut hard.  A narrow
map: one text is one task's work, nothing is shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LIMIT, OVERLAP = 1500, 120
WORD_WEIGHT, CHARS_PER_TOKEN = 1.35, 3.7

_BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])")),
    ("clause", re.compile(r"(?<=[;:,])\s+|(?<=[、，；：])")),
    ("word", re.compile(r"\s+")),
)


def size_of(words: int, chars: int) -> int:
    """Token estimate of a text; 0 for the empty text."""
    return math.floor(max(WORD_WEIGHT * words, chars / CHARS_PER_TOKEN) + 1) if chars else 0


def size_column(text: Column) -> Column:
    """The same estimate as a column expression; null for null."""
    words = F.size(F.filter(F.split(text, r"[\s  -  　]+"), lambda w: w != ""))
    est = F.floor(F.greatest(words * WORD_WEIGHT, F.length(text) / CHARS_PER_TOKEN) + 1)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(est)


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """``(start, end, size, boundary)`` of each piece; one piece if the text is within the limit."""
    n = len(text)
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    whole = size_of(len(spans), n)
    if whole <= limit:
        return [(0, n, whole, "end")]
    starts = np.array([a for a, _ in spans], np.int64)
    ends = np.array([b for _, b in spans], np.int64)
    kinds = [(k, np.array([m.end() for m in p.finditer(text) if 0 < m.end() < n], np.int64)) for k, p in _BOUNDARIES]

    def words(a: int, b: int) -> int:
        return int(np.searchsorted(starts, b, "left") - np.searchsorted(ends, a, "right"))

    def size(a: int, b: int) -> int:
        return size_of(words(a, b), b - a)

    def furthest(a: int) -> int:
        """Largest end whose piece from ``a`` is within the limit (at least one character)."""
        lo, hi = a + 1, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if size(a, mid) <= limit else (lo, mid - 1)
        return lo

    out, a = [], 0
    while True:
        top = furthest(a)
        if top >= n:
            out.append((a, n, size(a, n), "end"))
            return out
        cut, kind = top, "hard"
        half = a + (top - a) // 2
        for k, at in kinds:
            i = int(np.searchsorted(at, top, "right")) - 1
            if i >= 0 and at[i] > half:
                cut, kind = int(at[i]), k
                break
        out.append((a, cut, size(a, cut), kind))
        # the last word start whose rest up to the cut holds the overlap; hard texts step in characters
        i = int(np.searchsorted(starts, cut, "left")) - 1
        while i > 0 and size(int(starts[i]), cut) < overlap:
            i -= 1
        back = int(starts[i]) if i >= 0 else cut
        if back <= a or size(back, cut) > 2 * overlap:
            back = max(a + 1, cut - int(overlap * CHARS_PER_TOKEN))
        a = back


def split_texts(rows: DataFrame, key: str = "chunk_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece_no, start_char, end_char, size, boundary, piece)``, one row per piece.

    Rows repeated with equal key and text count once.  A null text gives nothing, an empty
    one an empty piece of size 0.  ``limit`` must exceed twice the ``overlap``.
    """
    if limit <= 2 * overlap:
        raise ValueError("limit must exceed twice the overlap")

    def run(it):
        for b in it:
            rowsets: list[list] = [[] for _ in range(7)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (s, e, z, kind) in enumerate(pieces_of(t, limit, overlap)):
                    for col, v in zip(rowsets, (k, i, s, e, z, kind, t[s:e])):
                        col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rowsets, kinds)], ["k", "piece_no", "start_char", "end_char", "size", "boundary", "piece"])

    x = rows.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    x = x.dropDuplicates(["k", "h"]).select("k", "t")
    return x.mapInArrow(run, "k string, piece_no int, start_char long, end_char long, size int, boundary string, piece string").withColumnRenamed("k", key)
