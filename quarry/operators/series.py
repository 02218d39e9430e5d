"""Time series: event windows by trading days, returns, volatility, abnormal returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def daily_returns(bars: DataFrame, key: str = "ticker", day: str = "day", close: str = "close") -> DataFrame:
    """Adds ``ret``, the change against the day before; null on the first day and after a close of zero or less."""
    p = F.lag(close).over(W.partitionBy(key).orderBy(day))
    return bars.withColumn("ret", F.when(p > 0, F.col(close) / p - 1))


def volatility(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """``(key, sigma)``: sample deviation of all daily returns, variance at least 1e-8; 0.02 with fewer than two."""
    r = daily_returns(bars, key)
    return r.groupBy(key).agg(F.count("ret").alias("_n"), F.var_samp("ret").alias("_v")).select(key, F.when(F.col("_n") < 2, 0.02).otherwise(F.sqrt(F.greatest(F.lit(1e-8), F.col("_v")))).alias("sigma"))


def event_window(events: DataFrame, bars: DataFrame, k: int, key: str = "ticker", at: str = "at", day: str = "day", close: str = "close") -> DataFrame:
    """Close ``k`` trading days before and after the anchor, clamped to the series.

    The anchor is the last day up to the event, the first day where none is.  Adds
    ``pre_day, pre, post_day, post, truncated``; events without series have nulls.
    """
    s = bars.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(day, close))).alias("_s"))
    x = events.join(s, key, "left")
    anchor = F.greatest(F.lit(1), F.size(F.filter("_s", lambda p: p[day] <= F.col(at))))
    n = F.size("_s")
    x = x.withColumn("_i", anchor).withColumn("_n", n)
    lo, hi = F.greatest(F.lit(1), F.col("_i") - k), F.least(F.col("_n"), F.col("_i") + k)
    x = x.withColumn("_p", F.when(F.col("_n") > 0, F.element_at("_s", lo))).withColumn("_q", F.when(F.col("_n") > 0, F.element_at("_s", hi)))
    x = x.withColumn("truncated", (F.col("_i") - k < 1) | (F.col("_i") + k > F.col("_n")))
    return x.select(*events.columns, F.col(f"_p.{day}").alias("pre_day"), F.col(f"_p.{close}").alias("pre"), F.col(f"_q.{day}").alias("post_day"), F.col(f"_q.{close}").alias("post"), "truncated")


def event_metrics(events: DataFrame, bars: DataFrame, bench: DataFrame, k: int, key: str = "ticker", at: str = "at") -> DataFrame:
    """Event return, abnormal return against the benchmark on the same days (0 where it has none), z-score, polarity."""
    x = event_window(events, bars, k, key, at).join(volatility(bars, key), key, "left")
    for side in ("pre", "post"):
        b = bench.select(F.col("day").alias(f"{side}_day"), F.col("close").alias(f"_b{side}"))
        x = x.join(b, f"{side}_day", "left")
    ret = F.when(F.col("pre") > 0, (F.col("post") / F.col("pre") - 1) * 100)
    market = F.when(F.col("_bpre") > 0, (F.col("_bpost") / F.col("_bpre") - 1) * 100)
    x = x.withColumn("event_return_pct", ret).withColumn("car_pct", ret - F.coalesce(market, F.lit(0.0)))
    z = F.col("car_pct") / 100 / (F.col("sigma") * F.sqrt(F.lit(float(k))))
    c = F.col("car_pct")
    polarity = F.when(c <= -3, "DISRUPTIVE_SHOCK").when(c <= -1.5, "CONTRACTING_BEARISH").when(c >= 2, "EXPANDING_BULLISH").otherwise("NEUTRAL_STABLE")
    return x.select(*events.columns, F.round("event_return_pct", 4).alias("event_return_pct"), F.round("car_pct", 4).alias("car_pct"), F.round(z, 4).alias("z"), "truncated", polarity.alias("polarity"))
