"""Time series over daily means of orders."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.core.runtime import table
from quarry.operators import series as S
from quarry.plans.joins import _EVENT, _PRICE, first_orders, prices
from quarry.plans.registry import query

_P = f"p AS ({_PRICE}), e AS ({_EVENT}), q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM p)"
_W = _P + ''', a AS (SELECT c_custkey, e."at", e.ticker, greatest(1, max(CASE WHEN q.day <= e."at" THEN i ELSE 0 END)) AS i, max(n) AS n FROM e JOIN q USING (ticker) GROUP BY 1, 2, 3), w AS (SELECT a.*, greatest(1, a.i - 3) AS lo, least(a.n, a.i + 3) AS hi, a.i - 3 < 1 OR a.i + 3 > a.n AS truncated FROM a)'''


@query("WIN_02", f"WITH {_W} SELECT c_custkey, l.day AS pre_day, h.day AS post_day, truncated FROM w JOIN q l ON l.ticker = w.ticker AND l.i = lo JOIN q h ON h.ticker = w.ticker AND h.i = hi")
def windows(spark, d):
    return S.event_window(first_orders(spark, d), prices(spark, d), 3).select("c_custkey", "pre_day", "post_day", "truncated")


@query("WIN_03", f"WITH p AS ({_PRICE}) SELECT ticker, day, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1, 6) AS ret FROM p")
def returns(spark, d):
    return S.daily_returns(prices(spark, d)).select("ticker", "day", F.round("ret", 6).alias("ret"))


@query("AGG_16", f"WITH p AS ({_PRICE}), r AS (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS ret FROM p) SELECT ticker, round(sqrt(greatest(1e-8, var_samp(ret))), 6) AS sigma FROM r GROUP BY 1")
def sigma(spark, d):
    return S.volatility(prices(spark, d)).select("ticker", F.round("sigma", 6).alias("sigma"))


@query("SCA_30", f"""WITH {_W}, b AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS c FROM orders GROUP BY 1), x AS (SELECT c_custkey, (h.close / l.close - 1) * 100 AS r, coalesce((bh.c / bl.c - 1) * 100, 0) AS m FROM w JOIN q l ON l.ticker = w.ticker AND l.i = lo JOIN q h ON h.ticker = w.ticker AND h.i = hi LEFT JOIN b bl ON bl.day = l.day LEFT JOIN b bh ON bh.day = h.day)
SELECT c_custkey, round(r, 4) AS event_return_pct, round(r - m, 4) AS car_pct, CASE WHEN r - m <= -3 THEN 'DISRUPTIVE_SHOCK' WHEN r - m <= -1.5 THEN 'CONTRACTING_BEARISH' WHEN r - m >= 2 THEN 'EXPANDING_BULLISH' ELSE 'NEUTRAL_STABLE' END AS polarity FROM x""")
def metrics(spark, d):
    bench = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))
    return S.event_metrics(first_orders(spark, d), prices(spark, d), bench, 3).select("c_custkey", "event_return_pct", "car_pct", "polarity")


@query("EXT_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b, event_id FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT user_id, s::BIGINT AS session, count(*) AS n FROM s GROUP BY 1, 2")
def sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp") - F.lag(F.col("ts").cast("timestamp")).over(w) <= F.expr("interval 6 hours")
    x = table(spark, d, "events").withColumn("b", F.when(gap, 0).otherwise(1)).withColumn("session", F.sum("b").over(w))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("n"))
