"""Exact similarity join of shingle sets by rare prefixes, for whatever signatures leave open.

All shingles have one global order: by how often their bucket of a fixed table occurs, then
by value.  Two sets of Jaccard similarity ``t`` or more share a shingle among the first
``n - ceil(t n) + 1`` of each, and the places of the first one they share bound what they can
have in common.  The table only orders: a full one costs time, never a pair.

Postings travel as column blocks.  A shingle that stands in more sets than ``SPLIT`` is
spread over a triangle of reduce cells, so that no task holds all sets of a common phrase
while any two of them still meet in one cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.core.runtime import cut
from quarry.llm.tokens import mix

#: Buckets of the table that orders shingles, and the pieces in which it is added up.
ORDER_BITS, PIECES = 20, 16
SPLIT = 50_000
#: Pairs looked at together.
CHUNK = 200_000
#: Shingles of all sets for each reduce partition.
SHINGLES_PER_PART = 16_000_000
BATCH = 4096
BINS = 64
#: Standard deviations that a sketch may be off: a pair at the threshold fails about once in a billion.
SIGMAS = 6.2
POSTINGS = "r int, s binary, d binary, i binary, cls binary, n binary, sk binary"
COUNTS = "piece int, counts binary"


def flat_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, set sizes and all hashes of a batch of sets, one set per class."""
    cls = batch.column("cls").to_numpy(zero_copy_only=False)
    _, once = np.unique(cls, return_index=True)
    hs = batch.column("hs").take(pa.array(np.sort(once)))
    off = hs.offsets.to_numpy()
    return cls[np.sort(once)], np.diff(off).astype(np.int64), hs.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint32)


def sketches(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Four bits for each of ``BINS`` bins of the domain: 1 to 15 by the least mixed hash in it, 0 if empty."""
    at = doc * BINS + ((h.astype(np.uint64) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    nib = np.zeros(docs * BINS, np.uint8)
    nib[at[first]] = (mix(h[first].astype(np.uint64)) % np.uint64(15)).astype(np.uint8) + 1
    return ((nib[0::2] << 4) | nib[1::2]).reshape(docs, BINS // 2).view(np.uint64)


def sketch_agrees(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether so few bins differ that the similarity may reach the threshold."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    used = BINS * (1 - np.exp(-(n + m) / (1 + threshold) / BINS))
    return differ <= used * (1 - threshold) + SIGMAS * np.sqrt(used * threshold * (1 - threshold)) + 1


def bucket_counts(h: np.ndarray) -> np.ndarray:
    return np.bincount(h >> np.uint32(32 - ORDER_BITS), minlength=1 << ORDER_BITS)


def count_pieces(counts: np.ndarray) -> list[tuple[int, bytes]]:
    """The counts of a task on a scale of a quarter of a power of two, in pieces."""
    coarse = np.minimum(np.ceil(np.log2(counts + 1.0) * 4), 255).astype(np.uint8)
    return [(i, x.tobytes()) for i, x in enumerate(np.split(coarse, PIECES))]


def shingle_counts(sets: DataFrame) -> DataFrame:
    """Rows of ``COUNTS`` that ``order_table`` adds up; one table of fixed size for each task."""

    def run(it):
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for b in it:
            for a in range(0, b.num_rows, BATCH):
                counts += bucket_counts(flat_sets(b.slice(a, BATCH))[2])
        rows = count_pieces(counts) if counts.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["piece", "counts"])

    return sets.select("cls", "hs").mapInArrow(run, COUNTS)


def order_table(pieces: DataFrame) -> np.ndarray:
    """About how often each bucket occurs, on the scale of ``count_pieces``: one byte a bucket, of fixed size."""

    def add(it):
        have: dict[int, np.ndarray] = {}
        for b in it:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have[i] = have.get(i, 0) + np.exp2(np.frombuffer(raw, np.uint8) / 4.0) - 1
        out = [(i, np.minimum(np.rint(np.log2(c + 1) * 4), 255).astype(np.uint8).tobytes()) for i, c in have.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["piece", "counts"])

    table = np.zeros((PIECES, (1 << ORDER_BITS) // PIECES), np.uint8)
    for i, raw in pieces.repartition(PIECES, "piece").mapInArrow(add, COUNTS).collect():
        table[i] = np.frombuffer(raw, np.uint8)
    return table.reshape(-1)


def _cells(h: np.ndarray, cls: np.ndarray, level: np.ndarray, usual: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(posting, partition)``: each posting once, but ``s`` times where its shingle is split over ``s`` shards."""
    shards = np.ceil((np.exp2(level / 4.0) - 4 * usual) / SPLIT).astype(np.int64)
    at, where = [np.flatnonzero(shards <= 1)], []
    where.append((mix(h[at[0]].astype(np.uint64)) % np.uint64(parts)).astype(np.int32))
    for s in np.unique(shards[shards > 1]):
        mine = np.flatnonzero(shards == s)
        x = (mix(cls[mine].view(np.uint64)) % np.uint64(s)).astype(np.int64)
        for j in range(int(s)):
            cell = np.minimum(x, j) * s + np.maximum(x, j)
            at.append(mine)
            where.append((mix(h[mine].astype(np.uint64) + (cell.astype(np.uint64) << np.uint64(32))) % np.uint64(parts)).astype(np.int32))
    return np.concatenate(at), np.concatenate(where)


def _posted(threshold: float, parts: int, table: np.ndarray):
    usual = float(np.mean(np.exp2(table / 4.0) - 1)) if len(table) else 0.0

    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, BATCH):
                cls, size, h = flat_sets(batch.slice(a, BATCH))
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(cls)), size)
                sk = sketches(h, doc, len(cls))
                level = table[h >> np.uint32(32 - ORDER_BITS)]
                # one sortable number: set, level, then the place of the value, which is sorted within a set
                order = np.argsort((doc.astype(np.int64) << 8) | level, kind="stable")
                rank = np.arange(len(h)) - np.repeat(np.concatenate([[0], size.cumsum()[:-1]]), size)
                keep = rank < np.repeat(size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1, size)
                order, rank = order[keep], rank[keep]
                h, doc, level = h[order], doc[order], level[order]
                at, r = _cells(h, cls[doc], level, usual, parts)
                by = np.argsort(r, kind="stable")
                at, r = at[by], r[by]
                cuts = np.searchsorted(r, np.arange(parts + 1))
                rows = []
                for i in np.flatnonzero(np.diff(cuts)):
                    x = at[cuts[i] : cuts[i + 1]]
                    here, ix = np.unique(doc[x], return_inverse=True)
                    rows.append((i, h[x].tobytes(), ix.astype(np.uint16).tobytes(), np.minimum(rank[x], 65535).astype(np.uint16).tobytes(), cls[here].tobytes(), size[here].astype(np.uint32).tobytes(), sk[here].tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["r", "s", "d", "i", "cls", "n", "sk"])

    return run


def candidate_ranges(key: np.ndarray, late: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings sorted by key (and side) with the range ``[low, high)`` of those that each is paired with."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.concatenate([edge, [len(key)]]))
    high = np.repeat(edge + n, n)
    if late is None:
        low = np.arange(len(key)) + 1
        left = np.flatnonzero(low < high)
    else:
        low = high - np.repeat(np.add.reduceat(late.astype(np.int64), edge), n)
        left = np.flatnonzero(~late & (low < high))
    return left, low[left], high[left]


def in_chunks(left: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Pairs ``(i, j)`` of the ranges, about ``CHUNK`` at a time."""
    reps = high - low
    ends = np.cumsum(reps)
    a = 0
    while a < len(left):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")), a + 1)
        n = reps[a:b]
        i = np.repeat(left[a:b], n)
        yield i, np.arange(len(i)) - np.repeat(np.concatenate([[0], n.cumsum()[:-1]]), n) + np.repeat(low[a:b], n)
        a = b


def cells_of(it, columns: tuple[str, ...]):
    """The blocks of each reduce cell ``r`` of a task: lists of rows of ``columns``.

    A task holds the packed blocks of its cells (their number is sized for that) and unpacks one cell at a time.
    """
    cells: dict[int, list] = {}
    for b in it:
        for r, *row in zip(*[b.column(x).to_pylist() for x in ("r", *columns)]):
            cells.setdefault(r, []).append(row)
    for r in sorted(cells):
        yield cells.pop(r)


def documents_of(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, sizes and sketches of the blocks ``(cls, n, sk)`` once each; each block's first place and where its places went."""
    cls = np.concatenate([np.frombuffer(c, np.int64) for c, _, _ in blocks])
    size = np.concatenate([np.frombuffer(n, np.uint32) for _, n, _ in blocks]).astype(np.int64)
    sk = np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, BINS // 16) for _, _, k in blocks])
    known, first, back = np.unique(cls, return_index=True, return_inverse=True)
    base = np.concatenate([[0], np.cumsum([len(c) // 8 for c, _, _ in blocks])])
    return known, size[first], sk[first], base, back.astype(np.int32)


def _joined(threshold: float, cross: bool):
    def cell(rows):
        known, size, sk, base, back = documents_of([x[3:] for x in rows])
        key = np.concatenate([np.frombuffer(x[0], np.uint32) for x in rows])
        doc = np.concatenate([back[np.frombuffer(x[1], np.uint16).astype(np.int32) + np.int32(o)] for x, o in zip(rows, base)])
        pos = np.concatenate([np.frombuffer(x[2], np.uint16) for x in rows])
        late = (known[doc] & 1).astype(bool) if cross else np.zeros(len(doc), bool)
        order = np.lexsort((doc, late, key))
        key, doc, pos, late = key[order], doc[order], pos[order].astype(np.int64), late[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc, pos, late = key[new], doc[new], pos[new], late[new]
        # what may still be common from here on, and how much of it a set's own half of the overlap needs
        here = size[doc]
        rest, need = (here - pos).astype(np.float32), (here * (threshold / (1 + threshold))).astype(np.float32)
        found = []
        for i, j in in_chunks(*candidate_ranges(key, late if cross else None)):
            ok = np.flatnonzero(np.minimum(rest[i], rest[j]) >= (need[i] + need[j]) * np.float32(0.999999))
            a, b = doc[i[ok]], doc[j[ok]]
            n, m = size[a], size[b]
            ok = (np.minimum(n, m) >= threshold * np.maximum(n, m)) & sketch_agrees(sk[a], sk[b], n, m, threshold)
            found.append(np.unique(np.minimum(a[ok], b[ok]).astype(np.int64) * len(known) + np.maximum(a[ok], b[ok])))
        p = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(known[p // max(len(known), 1)]), pa.array(known[p % max(len(known), 1)])], ["a", "b"])

    def run(it):
        for rows in cells_of(it, ("s", "d", "i", "cls", "n", "sk")):
            yield cell(rows)

    return run


def candidates(sets: DataFrame, threshold: float, cross: bool = False, table: np.ndarray | None = None, total: int | None = None) -> DataFrame:
    """``(a, b)``: classes, ``a < b``, that may have Jaccard similarity ``threshold`` or more; materialised.

    ``sets`` holds ``cls`` and the sorted ``hs``; equal classes of a batch count once.  With
    ``cross`` only classes with different lowest bits are paired.  ``table`` is that of
    ``order_table`` over these or more sets, made here where it is not given.
    """
    if table is None:
        table = order_table(shingle_counts(sets))
    total = int(np.sum(np.exp2(table / 4.0) - 1)) if total is None else total
    parts = max(8, int(total // SHINGLES_PER_PART))
    posted = sets.select("cls", "hs").mapInArrow(_posted(threshold, parts, table), POSTINGS)
    return cut(posted.repartition(parts, "r").mapInArrow(_joined(threshold, cross), "a long, b long")).distinct()
