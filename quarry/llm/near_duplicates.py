"""Problem 5: groups of records that share most of their word shingles (PartEnum).

Sets whose sizes fall in one band (a power of two; a set also signs in the band below if a
partner may lie there) split the 32-bit shingle domain into ``n1`` partitions of ``N2``
cells.  Each subset of ``N2 - K2`` cells of a partition gives one signature: the hash of
all shingles in it.  Two sets that differ in at most ``n1 * (K2 + 1) - 1`` shingles
provably share a signature; ``n1`` is sized for the largest sets of a band, so that pairs at
the similarity threshold miss each other once in a thousand (measured recall: README).

Signatures travel as column blocks, one row per map batch and reduce partition, six bytes a
signature.  A reduce task sorts its signatures and pairs equal ones.  Copies collapse to
one class beforehand, so a set repeated a million times signs once per batch.  A signature
shared by more than ``HOT`` classes (common phrases) pairs nothing; classes that have one
are joined again by exact prefix filtering (``prefix_join``), so nothing is lost.  Where a
signature is hot within one map batch only a mark of it travels, and the mark makes it hot
everywhere: no task ever holds more than ``LOCAL_HOT`` of 4,096 sets for one signature.
Candidates pass a 256-bit sketch and then the exact Jaccard similarity.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry.core.runtime import cut
from quarry.llm.prefix_join import BATCH, candidate_ranges, candidates, cells_of, documents_of, flat_sets, in_chunks, sketch_agrees, sketches
from quarry.llm.tokens import mix, shingle_sets

N2, K2 = 4, 2
HOT = 2000
#: A signature of so many sets of one map batch is hot there: a mark travels instead of them.
LOCAL_HOT, MARK = 128, 65535
#: Bands up to this size have signatures without any chance of a miss.
EXACT_BAND = 16
#: Largest share of pairs at the threshold that the signatures of a larger band may miss.
MISS = 0.001
BROADCAST_KEYS = 200_000
SUBSETS = tuple(combinations(range(N2), N2 - K2))
SETS = "key long, cls long, hs array<int>"


def sets_from_tokens(key, strings: pa.Array, page: np.ndarray, pages: int, width: int, side: pa.Array | None = None) -> pa.RecordBatch:
    """Rows ``(key, cls, hs)`` for the pages of a batch that have at least one shingle."""
    p, h = shingle_sets(strings, page, width)
    n = np.bincount(p, minlength=pages)
    some = np.flatnonzero(n)
    start = np.concatenate([[0], n.cumsum()])
    cls = np.add.reduceat(mix(h.astype(np.uint64) + np.uint64(77)), start[some]) if len(some) else np.zeros(0, np.uint64)
    if side is not None:
        cls = (cls & ~np.uint64(1)) | side.to_numpy(zero_copy_only=False).astype(np.uint64)[some]
    hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n[some].cumsum()]).astype(np.int32)), pa.array(h.view(np.int32)))
    return pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(cls.view(np.int64)), hs], ["key", "cls", "hs"])


def text_sets(rows: DataFrame, key: str, text: str, width: int, side: str | None = None) -> DataFrame:
    """``(key, cls, hs)``: sorted distinct shingle hashes and their class (equal sets share it).

    With ``side``, a boolean column, the lowest bit of a class tells the side of its rows.
    Null texts and sides give no set.
    """
    cols = [F.col(key).cast("long").alias("key"), F.col(text).alias("t"), (F.col(side) if side else F.lit(False)).cast("long").alias("side")]

    def run(it):
        for b in it:
            out = sets_from_tokens(b.column(0), pc.cast(b.column(1), pa.large_string()), np.arange(b.num_rows), b.num_rows, width, b.column(2) if side else None)
            yield out

    return rows.select(cols).where("t is not null and side is not null").mapInArrow(run, SETS)


def partition_size(threshold: float) -> float:
    """Mean shingles in a partition: about five of them differ in pairs at the threshold."""
    return 4.94 * (1 + threshold) / (2 * (1 - threshold)) if threshold < 1 else 64.0


def partitions(level: int, group: float, threshold: float) -> int:
    """Partitions of the band from ``level``: enough that its largest and least similar pairs fail to share a
    signature at most ``MISS`` of the time; small sets get so many that every pair provably shares one."""
    n1 = max(int(level * 1.4 / group), 1)
    if threshold <= 0:
        return n1
    apart = (1 - threshold) / (1 + threshold) * 2 * level * (1 + 1 / threshold)
    sure = -(-(int(apart) + 1) // (K2 + 1))
    if level <= EXACT_BAND:
        return max(n1, sure)
    while n1 < sure and missed(n1, apart) > MISS:
        n1 += 1
    return n1


def missed(n1: int, apart: float) -> float:
    """Chance that sets ``apart`` shingles from each other share none of the signatures of ``n1`` partitions."""
    clean = (1 - 1 / (n1 * N2)) ** apart
    return sum(comb(N2, i) * clean**i * (1 - clean) ** (N2 - i) for i in range(N2 - K2)) ** n1


def signatures(h: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``(signature, doc)`` of all sets of a batch; ``h`` sorted within each set."""
    docs = len(size)
    start = np.concatenate([[0], size.cumsum()])
    out_s, out_d = [], []
    group = partition_size(threshold)
    band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    for below in (0, 1):
        lo = 1 << np.maximum(band - below, 0)
        use = np.flatnonzero((band >= 1) & (threshold * size < (1 << band))) if below else np.arange(docs)
        for level in np.unique(lo[use]):
            mine = use[lo[use] == level]
            n1 = partitions(int(level), group, threshold)
            width = n1 * N2
            reps = size[mine]
            doc = np.repeat(np.arange(len(mine)), reps)
            at = np.repeat(start[mine] - np.concatenate([[0], reps.cumsum()[:-1]]), reps) + np.arange(reps.sum())
            hh = h[at].astype(np.uint64)
            slot = doc * width + ((hh * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
            cell = np.zeros(len(mine) * width, np.uint64)
            if len(slot):
                edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                cell[slot[edge]] = np.add.reduceat(mix(hh), edge)
            cell = cell.reshape(len(mine), n1, N2)
            place = (np.arange(n1, dtype=np.uint64) + np.uint64(int(level)) * np.uint64(1 << 20)) * np.uint64(8)
            for i, sub in enumerate(SUBSETS):
                s = mix(place + np.uint64(i))[None, :].repeat(len(mine), 0)
                some = np.zeros(s.shape, bool)
                for c in sub:
                    s = mix(s + cell[:, :, c])
                    some |= cell[:, :, c] != 0
                out_s.append(s[some])
                out_d.append(mine[np.nonzero(some)[0]])
    return np.concatenate(out_s), np.concatenate(out_d)


def _hot_here(s: np.ndarray) -> np.ndarray:
    """Which signatures of a map batch are those of ``LOCAL_HOT`` or more of its sets."""
    bucket = (s >> np.uint64(44)).astype(np.int64)
    hot = np.bincount(bucket, minlength=1 << 20)[bucket] >= LOCAL_HOT
    if hot.any():
        _, back, n = np.unique(s[hot], return_inverse=True, return_counts=True)
        hot[hot] = n[back] >= LOCAL_HOT
    return hot


def _signed_blocks(threshold: float, parts: int):
    def run(it):
        for batch in it:
            for a in range(0, batch.num_rows, BATCH):
                cls, size, h = flat_sets(batch.slice(a, BATCH))
                if not len(cls):
                    continue
                sk = sketches(h, np.repeat(np.arange(len(cls)), size), len(cls))
                s, d = signatures(h, size, threshold)
                hot = _hot_here(s)
                marks = np.unique(s[hot])
                told = cls[np.unique(d[hot])].tobytes()
                s, d = np.concatenate([s[~hot], marks]), np.concatenate([d[~hot], np.full(len(marks), len(cls))])
                r = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(r, kind="stable")
                s, d, r = s[order], d[order], r[order]
                cuts = np.searchsorted(r, np.arange(parts + 1))
                rows = []
                for i in np.flatnonzero(np.diff(cuts)):
                    lo, hi = cuts[i], cuts[i + 1]
                    here, ix = np.unique(d[lo:hi], return_inverse=True)
                    ix = np.where(here[ix] == len(cls), MARK, ix)
                    here = here[here < len(cls)]
                    rows.append((i, s[lo:hi].astype(np.uint32).tobytes(), ix.astype(np.uint16).tobytes(), cls[here].tobytes(), size[here].astype(np.uint32).tobytes(), sk[here].tobytes(), b"" if rows else told))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["r", "s", "d", "cls", "n", "sk", "hot"])

    return run


def _paired(threshold: float, cross: bool):
    def share(key, doc, known, size, sk):
        """Pairs and hot classes of some signatures: ``key`` with ``doc``, -1 for a mark."""
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run_len = np.diff(np.concatenate([edge, [len(key)]]))
        # a mark sorts before the sets of its signature
        hot = np.repeat((run_len > HOT) | (doc[edge] < 0), run_len)
        told = np.unique(doc[hot & (doc >= 0)])
        key, doc = key[~hot], doc[~hot]
        late = (known[doc] & 1).astype(bool) if cross else None
        if cross:
            order = np.lexsort((late, key))
            key, doc, late = key[order], doc[order], late[order]
        found = [np.zeros(0, np.int64)]
        for i, j in in_chunks(*candidate_ranges(key, late)):
            a, b = doc[i], doc[j]
            ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            a, b = a[ok], b[ok]
            ok = sketch_agrees(sk[a], sk[b], size[a], size[b], threshold)
            found.append(np.unique(np.minimum(a[ok], b[ok]).astype(np.int64) * len(known) + np.maximum(a[ok], b[ok])))
        return np.unique(np.concatenate(found)), told

    def run(it):
        for rows in cells_of(it, ("s", "d", "cls", "n", "sk", "hot")):
            known, size, sk, base, back = documents_of([x[2:5] for x in rows])
            pairs, hot = [], [np.frombuffer(x[5], np.int64) for x in rows if x[5]]
            # a quarter of the signatures at a time
            for quarter in range(4):
                key, doc = [], []
                for x, o in zip(rows, base):
                    s = np.frombuffer(x[0], np.uint32)
                    mine = np.flatnonzero((s >> np.uint32(30)) == quarter)
                    at = np.frombuffer(x[1], np.uint16)[mine].astype(np.int32)
                    key.append(s[mine])
                    doc.append(np.where(at == MARK, np.int32(-1), np.append(back, np.int32(0))[np.where(at == MARK, 0, at + np.int32(o))]))
                key, doc = np.concatenate(key), np.concatenate(doc)
                if len(key):
                    p, told = share(key, doc, known, size, sk)
                    pairs.append(p)
                    hot.append(known[told])
            p = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            a, b, who = known[p // max(len(known), 1)], known[p % max(len(known), 1)], np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.int64)
            yield _pairs(np.minimum(a, b), np.maximum(a, b), np.zeros(len(p), np.int64))
            yield _pairs(who, who, np.full(len(who), -1))

    return run


def _pairs(a, b, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int64())], ["a", "b", "kind"])


def similar_classes(sets: DataFrame, threshold: float, cross: bool = False, total: int | None = None) -> DataFrame:
    """``(a, b, jaccard)`` for classes ``a < b`` whose sets have Jaccard similarity >= ``threshold``.

    ``sets`` (``SETS``) is read two to four times: materialise it where that is cheaper
    than making it again.  ``total``: shingles of all sets, counted if not given.  With
    ``cross`` only pairs of classes with different lowest bits (``text_sets``) count.
    """
    if total is None:
        total = sets.agg(F.sum(F.size("hs"))).first()[0]
    total = total or 0
    parts = max(8, int(total // 6_000_000))
    blocks = sets.select("cls", "hs").mapInArrow(_signed_blocks(threshold, parts), "r int, s binary, d binary, cls binary, n binary, sk binary, hot binary")
    found = cut(blocks.repartition(parts, "r").mapInArrow(_paired(threshold, cross), "a long, b long, kind long"))
    pairs = found.where("kind = 0").select("a", "b")
    hot = found.where("kind < 0")
    if hot.limit(1).count():
        pairs = pairs.unionByName(candidates(cut(_in_hot(sets, hot)), threshold, cross))
    return verified(sets, pairs.distinct(), threshold)


def _in_hot(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """Sets with a hot signature: a pair that shares no other signature has both its sets here."""
    return sets.join(hot.select(F.col("a").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "hs")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity reaches ``threshold``, with it."""
    pairs = cut(pairs)
    keys = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    few = keys.count() <= BROADCAST_KEYS
    wanted = cut(sets.select("cls", "hs").join(F.broadcast(keys) if few else keys, "cls", "left_semi").dropDuplicates(["cls"]))
    x = pairs.join(wanted.select(F.col("cls").alias("a"), F.col("hs").alias("ha")), "a").join(wanted.select(F.col("cls").alias("b"), F.col("hs").alias("hb")), "b")
    x = x.withColumn("common", F.size(F.array_intersect("ha", "hb")))
    x = x.withColumn("jaccard", F.col("common") / (F.size("ha") + F.size("hb") - F.col("common")))
    return x.where(F.col("jaccard") >= threshold - 1e-12).select("a", "b", "jaccard")


def class_members(sets: DataFrame) -> DataFrame:
    """``(cls, key)`` for every set."""
    return sets.select("cls", "key")


def expand_pairs(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """All linked pairs of keys, smaller first: members of linked classes, and copies of one class.

    The output holds every pair by definition; nothing larger than it is made.
    """
    m = class_members(sets)
    many = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    same = m.join(many, "cls", "left_semi")
    own = same.alias("x").join(same.alias("y"), "cls").where("x.key < y.key").select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    xs = linked.join(m.select(F.col("cls").alias("a"), F.col("key").alias("ka")), "a").join(m.select(F.col("cls").alias("b"), F.col("key").alias("kb")), "b")
    return own.unionByName(xs.where("ka <> kb").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")))
