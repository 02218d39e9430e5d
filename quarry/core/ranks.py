"""Ranks within few large groups, without a group ever being sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.core.runtime import cut, small_side


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 0, in ``order`` within ``keys``) and ``_size`` of the group.

    Rows are cut into ranges of ``keys`` and ``order`` together, so a group with a third of
    all rows is spread over a third of the ranges; a range counts its own and adds what lies
    before it.  ``order`` must tell rows of a group apart for the ranks to be reproducible.
    """
    named = [F.col(o) if isinstance(o, str) else o for o in order]
    x = rows.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(named)])
    cols = [f"_o{i}" for i in range(len(named))]
    by = [*keys, *cols]
    x = x.repartitionByRange(parts, *by) if parts else x.repartitionByRange(*by)
    x = cut(x.withColumn("_range", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("_range", *keys).orderBy(*cols)) - 1
    # one row a range and group: as many as there are ranges and groups
    counts = x.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    before = cut(counts.select("_range", *keys, (F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_size")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("_range", *keys)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = x.withColumn("_inside", inside).alias("l").join(small_side(before).alias("r"), on)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("l._inside") + F.col("r._before")).cast("long").alias("_rank"), F.col("r._size").alias("_size"))
