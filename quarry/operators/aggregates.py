"""Aggregations: training dynamics, merged edges, graded counts, votes and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.core.ranks import ranked


def transitions(rows: DataFrame, key: str, order: list, correct: str) -> DataFrame:
    """``(key, learned, forgotten)``: whether ever correct, and falls from correct to incorrect in order."""
    w = W.partitionBy(key).orderBy(*order)
    x = rows.withColumn("_p", F.lag(F.col(correct)).over(w))
    return x.groupBy(key).agg(F.max(F.col(correct).cast("int")).alias("learned"), F.sum((F.col("_p") & ~F.col(correct)).cast("int")).alias("forgotten"))


def coordinates(rows: DataFrame, key: str, order: list, prob: str, correct: str, sure: float = 0.70, spread: float = 0.15) -> DataFrame:
    """Cartography of training dynamics: mean, population deviation, share correct, falls (999: never learned), region."""
    stats = rows.groupBy(key).agg(F.avg(prob).alias("_m"), F.stddev_pop(prob).alias("_s"), F.avg(F.col(correct).cast("double")).alias("_c"))
    x = stats.join(transitions(rows, key, order, correct), key)
    region = F.when(F.round("_s", 12) >= spread, "ambiguous").when(F.round("_m", 12) >= sure, "easy").otherwise("hard")
    falls = F.when(F.col("learned") == 0, 999).otherwise(F.coalesce("forgotten", F.lit(0)))
    return x.select(key, F.round("_m", 4).alias("confidence"), F.round("_s", 4).alias("variability"), F.round("_c", 4).alias("correctness"), falls.alias("forgetfulness"), region.alias("region"))


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def merged_edges(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parallel edges as one: distinct hashes, first provenance in order, greatest confidence, count."""
    return edges.groupBy(*keys).agg(
        F.count("*").alias("evidence"), F.count_distinct("source_hash").alias("sources"), F.min_by("provenance", order).alias("provenance"), F.max("confidence").alias("base"),
    )


# Confidence by origin where an edge states none.
# Confidence by origin.
ORIGIN_CONFIDENCE = {
    "SEC_EXHIBIT_21": 1.00, "SEC_FORM_4": 1.00, "SEC_10K_ITEM1": 0.98, "SEC_10Q": 0.95, "SEC_8K": 0.95, "MULTI_TEACHER_CONSENSUS": 0.85,
    "FINANCIAL_NEWS_VERIFIED": 0.75, "NEWS_EXTRACTION": 0.60, "UNVERIFIED_RUMOR": 0.40,
}


def calibrated(base: Column, provenance: Column, evidence: Column) -> Column:
    """Base or origin confidence (0.60 for an unknown origin), 0.05 more for each of up to four further pieces of evidence, at most 1."""
    origin = F.lit(0.60)
    for k, v in ORIGIN_CONFIDENCE.items():
        origin = F.when(F.upper(F.trim(provenance)) == k, v).otherwise(origin)
    bonus = F.when(evidence > 1, 0.05 * F.least(F.lit(4), evidence - 1)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.coalesce(base, origin) + bonus), 3)


def over_full_groups(edges: DataFrame, target: str, group: str, share: str, slack: float = 1e-6) -> DataFrame:
    """Input groups whose shares sum to more than one."""
    return edges.groupBy(target, group).agg(F.sum(share).alias("total")).where(F.col("total") > 1 + slack)


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(facet, value, n)`` of several columns in one pass, by grouping sets."""
    g = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return g.select("x.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def signatures(rows: DataFrame, keys: list[str], doc: str, examples: int = 5) -> DataFrame:
    """Rejections by signature: rows, distinct documents, the smallest example documents."""
    docs = rows.groupBy(*keys, doc).agg(F.count("*").alias("_n"))
    r = docs.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(doc)))
    return r.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("docs"), F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col(doc)))).alias("examples"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, 0 and 0 without trials."""
    p, nn = hits / n, n.cast("double")
    mid, half = p + z * z / (2 * nn), z * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    norm = 1 + z * z / nn
    some = lambda x: F.when(n > 0, F.round(x, 6)).otherwise(0.0)
    return some(F.greatest(F.lit(0.0), (mid - half) / norm)), some(F.least(F.lit(1.0), (mid + half) / norm))


def consensus(votes: list[Column]) -> tuple[Column, Column]:
    """Strict majority of two or more votes (null on a tie), and whether all agree."""
    yes, n = sum(F.coalesce(v.cast("int"), F.lit(0)) for v in votes), sum(v.isNotNull().cast("int") for v in votes)
    majority = F.when(n < 2, F.lit(None)).when(yes * 2 > n, True).when(yes * 2 < n, False)
    return majority, (n >= 2) & ((yes == 0) | (yes == n))


def fleiss_kappa(rows: DataFrame, yes: str, n: str) -> DataFrame:
    """Agreement of equally many binary votes per row; 1 where chance agreement is certain."""
    x = rows.where(F.col(n) >= 2)
    a = x.agg(F.avg((F.col(yes) * (F.col(yes) - 1) + (F.col(n) - F.col(yes)) * (F.col(n) - F.col(yes) - 1)) / (F.col(n) * (F.col(n) - 1))).alias("p"), (F.sum(yes) / F.sum(n)).alias("q"))
    pe = F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q"))
    return a.select(F.when(pe >= 1, 1.0).otherwise(F.round((F.col("p") - pe) / (1 - pe), 6)).alias("kappa"))


def ranked_percentiles(rows: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """Element ``int(n * q)`` of the sorted values of each group, not interpolated."""
    x = ranked(rows.select(key, value), [key], [value]).withColumns({"_i": F.col("_rank"), "_n": F.col("_size")})
    return x.groupBy(key).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value))).alias(n) for n, q in qs.items()])
