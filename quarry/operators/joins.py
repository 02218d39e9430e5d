"""Lookups and joins: defaults, ordered tiers, fuzzy names, ranges in time, as-of, symmetric pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import text as T


def lookup(rows: DataFrame, dim: DataFrame, on: str, key: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """Left lookup of one value by unique key; missing keys get ``default``.  Repeated keys: smallest value."""
    d = dim.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v"))
    x = rows.join(d, F.col(on) == F.col("_k"), "left")
    return x.withColumn(out, F.col("_v") if default is None else F.coalesce("_v", default)).drop("_k", "_v")


def rewire(edges: DataFrame, mapping: DataFrame, src: str = "source", dst: str = "target") -> DataFrame:
    """Both ends replaced by ``mapping(node, canonical)``; unmapped nodes stay; self-loops go."""
    for end in (src, dst):
        edges = lookup(edges, mapping, end, "node", "canonical", "_new", F.col(end)).withColumn(end, F.col("_new")).drop("_new")
    return edges.where(F.col(src) != F.col(dst))


def tiered(rows: DataFrame, key: str, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """First tier that knows the row: ``tiers`` holds (name, (key, match, score)); ties take the best score, then the smallest match."""
    ranked = reduce(DataFrame.unionByName, [t.select(key, "match", F.col("score").cast("double").alias("score"), F.lit(i).alias("_tier"), F.lit(n).alias("tier")) for i, (n, t) in enumerate(tiers)])
    best = ranked.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_tier", F.desc("score"), "match"))).where("_r = 1").drop("_r", "_tier")
    return rows.join(best, key, "left")


def fuzzy_names(left: DataFrame, right: DataFrame, key: str, name: str, threshold: float = 0.4) -> DataFrame:
    """``(key, match, score)``: best name of ``right(match)`` by trigram Jaccard, threshold or more.

    Candidates share one of the rarest trigrams of the left name: a pair at the threshold
    shares at least ceil(threshold * n) of its n trigrams, so n - that + 1 rarest suffice.
    """
    r = right.where("match is not null").select("match").distinct().withColumn("_rg", T.trigrams(F.col("match")))
    l = left.where(F.col(name).isNotNull()).select(key, F.col(name).alias("_n"), T.trigrams(F.col(name)).alias("_lg"))
    rx = r.select("match", "_rg", F.explode("_rg").alias("g"))
    df = rx.groupBy("g").agg(F.count("*").alias("df"))
    lx = l.select(key, "_lg", F.explode("_lg").alias("g")).join(df, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    lx = lx.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy("df", "g"))).where(F.col("_i") <= F.size("_lg") - F.ceil(F.size("_lg") * threshold - 1e-9) + 1)
    c = lx.select(key, "_lg", "g").join(rx, "g").select(key, "_lg", "match", "_rg").dropDuplicates([key, "match"])
    c = c.withColumn("score", F.round(T.set_similarity(F.col("_lg"), F.col("_rg")), 6)).where(F.col("score") >= threshold)
    return c.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "match"))).where("_r = 1").select(key, "match", "score")


def members_at(members: DataFrame, day: Column, start: str = "date_added", end: str = "date_removed", first: str = "1957-03-04") -> Column:
    """Half-open membership at a date: added on or before it, not removed by it; no start means ``first``."""
    return (F.coalesce(members[start], F.lit(first)) <= day) & (members[end].isNull() | (members[end] > day))


def as_of(events: DataFrame, series: DataFrame, key: str, at: str, day: str, value: str, out: str) -> DataFrame:
    """``value`` at the last day up to the event, at the first day where none is; null without series.

    One equi-join on ``key``; series of one key are compact (one row a day).
    """
    s = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(day, value))).alias("_s"))
    x = events.join(s, key, "left")
    before = F.filter("_s", lambda p: p[day] <= F.col(at))
    pick = F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.element_at("_s", 1))
    return x.withColumn(f"{out}_day", pick[day]).withColumn(out, pick[value]).drop("_s")


def pair_key(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")]


def without_pairs(rows: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose pair is known in neither direction."""
    k = known.select(*pair_key(a, b)).distinct()
    x = rows.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return x.join(k, ["_a", "_b"], "left_anti").drop("_a", "_b")
