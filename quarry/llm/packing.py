"""Problem 8: fill containers of fixed capacity, hierarchically.

Items are hashed to partitions of bounded size and packed there by best fit, largest
first.  Bins filled to ``FULL`` are done, and so is a bin that the smallest item left
cannot join; the others go on as single items, hashed anew to fewer partitions, and are
packed again by best fit.  It ends when one partition has seen all that is left, or when a
round merges next to nothing: then no partition of a random ``PER_PARTITION`` items has two
bins that fit together, nor have all partitions.  So no task packs more than its bound,
however many items (say, all a little over half a container) cannot be combined.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.core.runtime import cut

CAPACITY = 1024
FULL = 0.985
#: Items of a partition, on average, and the share of items that a round must merge for another.
PER_PARTITION, GAIN = 50_000, 0.002


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as ``(item keys, filled)``; largest items first, each into the fullest bin that takes it.

    Items are ``(size, key)`` with 0 <= size <= capacity.  A bit set over free capacities
    finds the tightest bin in constant time.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    bins: list[tuple[list[int], int]] = []
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = open_bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_bits &= ~(1 << room)
            bins[b][0].append(key)
            left = room - size
            bins[b] = (bins[b][0], capacity - left)
        else:
            b = len(bins)
            bins.append(([key], size))
            left = capacity - size
        free[left].append(b)
        open_bits |= 1 << left
    return bins


def _round(items: DataFrame, parts: int, level: int, capacity: int) -> DataFrame:
    """``(key, bin, filled)``: every item with its bin of this round; equal keys never meet."""

    def run(it):
        import hashlib

        todo = []
        for b in it:
            todo.extend(zip(b.column("size").to_pylist(), b.column("key").to_pylist()))
        if not todo:
            return
        keys, names, fills = [], [], []
        for members, filled in best_fit(todo, capacity):
            # a bin is named after its first item and the round: stable over recomputation
            name = int.from_bytes(hashlib.blake2b(f"{level}:{members[0]}".encode(), digest_size=8).digest(), "big", signed=True)
            keys.extend(members)
            names.extend([name] * len(members))
            fills.extend([filled] * len(members))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(fills, pa.int64())], ["key", "bin", "filled"])

    salted = F.xxhash64("key", F.lit(level))
    return items.select("key", "size").repartition(parts, salted).mapInArrow(run, "key long, bin long, filled long")


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL, per_partition: int | None = None) -> DataFrame:
    """``(key, container, filled)`` for items ``(key, size)`` with unique keys and size <= capacity."""
    todo = cut(items.select(F.col("key").cast("long"), F.col("size").cast("long")))
    n, per_partition = todo.count(), per_partition or PER_PARTITION
    home, done, level = None, None, 0
    while True:
        parts = max(1, -(-n // per_partition))
        bins = cut(_round(todo, parts, level, capacity))
        x = bins if home is None else home.join(bins.withColumnRenamed("key", "at"), "at")
        home = x.select("key", F.col("bin").alias("at"), "filled")
        each = bins.select("bin", "filled").distinct()
        least = each.where(F.col("filled") < full * capacity).agg(F.min("filled"), F.count("*")).first()
        left = least[1]
        last = parts == 1 or left > (1 - GAIN) * n
        shut = (F.col("filled") >= full * capacity) | (F.col("filled") + F.lit(least[0] or 0) > capacity)
        over = home if last else home.where(shut)
        done = over if done is None else done.unionByName(over)
        if last:
            return done.select("key", F.col("at").alias("container"), "filled")
        home = cut(home.where(~shut).select("key", "at"))
        todo = cut(each.where(~shut).select(F.col("bin").alias("key"), F.col("filled").alias("size")))
        n, level = todo.count(), level + 1
        if n == 0:
            return done.select("key", F.col("at").alias("container"), "filled")


def pack_documents(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``(key, piece, size, container, filled)``: every document or piece with its container.

    Documents within the capacity stay whole (piece 0); others are cut into pieces of the
    capacity and a rest.  Null sizes count 0; a document of size 0 takes a place without
    using any.  Keys must be unique.
    """
    s = F.coalesce(F.col("size"), F.lit(0))
    x = sizes.select(key, s.alias("size"), F.greatest(F.ceil(s / capacity), F.lit(1)).cast("int").alias("n"))
    x = x.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.least(F.lit(capacity), F.col("size") - (i - 1) * capacity))).alias("piece", "size"))
    x = cut(x.withColumn("item", F.xxhash64(key, "piece")))
    packed = pack(x.select(F.col("item").alias("key"), "size"), capacity)
    return x.join(packed.withColumnRenamed("key", "item"), "item").select(key, "piece", "size", "container", "filled")
