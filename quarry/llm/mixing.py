"""Problem 9: mix sources to target shares of the total size.

Every document gets a hash-random key.  Keys are cut into ranges, so a source is sorted in
bounded pieces; range totals give each range its offset, and a running sum within the range
the distributed prefix sum.  A source whose share exceeds its size repeats whole epochs, up
to its cap, and takes the rest from the prefix of one more epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quarry.core.runtime import cut

#: Documents in one sorted range, on average.
RANGE_ROWS = 100_000
#: Plans are a row per source; up to so many they are broadcast.
BROADCAST_ROWS = 10_000


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, docs, own, budget, epochs, rest)`` per target.

    ``own`` is the source's size, ``budget`` its share of ``total`` (default: the size of all
    documents), ``epochs`` how often all of it is used, ``rest`` what a partial epoch adds.
    Repeated target rows count once; sources without documents have size 0; without target,
    a source gets nothing; a missing cap is one use.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("own"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    whole = F.lit(float(total)) if total is not None else F.lit(float(sizes.agg(F.sum("size")).first()[0] or 0))
    x = t.join(per, "source", "left").fillna({"docs": 0, "own": 0})
    x = x.withColumn("budget", F.coalesce("target_share", F.lit(0.0)) * whole)
    cap = F.coalesce("max_repeats", F.lit(1)).cast("long")
    whole_epochs = F.floor(F.col("budget") / F.col("own"))
    epochs = F.when(F.col("own") == 0, F.lit(0)).otherwise(F.least(whole_epochs, cap)).cast("long")
    rest = F.when((F.col("own") == 0) | (whole_epochs >= cap), F.lit(0.0)).otherwise(F.col("budget") - whole_epochs * F.col("own"))
    return x.select("source", "target_share", cap.alias("max_repeats"), "docs", "own", "budget", epochs.alias("epochs"), rest.alias("rest"))


def select(sizes: DataFrame, plans: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """``(key, source, size, times)`` of the documents in the mix; ``times`` >= 1.

    The partial epoch takes documents in key order while their middle lies within the rest,
    so a source misses its budget by at most half a document.
    """
    p = plans.select("source", "docs", "epochs", "rest")
    x = sizes.join(F.broadcast(p) if p.count() <= BROADCAST_ROWS else p, "source")
    x = x.withColumn("k", F.xxhash64(F.lit(seed), F.col(key)))
    ranges = F.greatest(F.ceil(F.col("docs") / RANGE_ROWS), F.lit(1))
    # unsigned upper half of the key, spread over the source's ranges
    x = x.withColumn("range", (F.shiftrightunsigned("k", 33) * ranges / F.lit(2**31)).cast("long"))
    totals = x.groupBy("source", "range").agg(F.sum("size").alias("inside"))
    offsets = totals.withColumn("before", F.sum("inside").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    x = x.join(offsets.select("source", "range", F.coalesce("before", F.lit(0)).alias("before")), ["source", "range"])
    order = W.partitionBy("source", "range").orderBy(F.shiftrightunsigned("k", 33), "k", key).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("middle", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    times = F.col("epochs") + (F.col("middle") < F.col("rest")).cast("long")
    return x.withColumn("times", times).where("times > 0").select(key, "source", "size", "times")


def mix_sources(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection, and per source its target and reached share of the mix.

    ``short``: every document of the source is in the selection as often as the cap allows
    and their size still lies below the budget.
    """
    sizes = cut(sizes)
    plans = cut(plan(sizes, targets, total))
    chosen = select(sizes, plans, key)
    caps = plans.select("source", F.col("max_repeats").alias("cap"))
    got = chosen.groupBy("source", "times").agg(F.sum("size").alias("size"), F.count("*").alias("n")).join(caps, "source")
    got = got.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times")).alias("used"), F.max("times").alias("repeats"), F.sum(F.when(F.col("times") >= F.col("cap"), F.col("n")).otherwise(0)).alias("at_cap")
    )
    x = plans.join(got, "source", "left").fillna({"used": 0, "repeats": 0, "at_cap": 0})
    x = x.withColumn("reached_share", F.col("used") / F.sum("used").over(W.partitionBy()))
    short = (F.col("at_cap") == F.col("docs")) & (F.col("used") < F.col("budget"))
    return chosen, x.select("source", "target_share", "reached_share", "own", "used", "repeats", "max_repeats", short.alias("short"))
