"""Aggregations, windows and ordered results over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.core.ranks import ranked
from quarry.core.runtime import table
from quarry.operators import aggregates as A
from quarry.plans.registry import query

_TREND = """t AS (SELECT user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m') AS guid, ts, event_id, value / (value + 20) AS prob, value >= 35 AS correct FROM events),
e AS (SELECT guid, prob, correct, row_number() OVER (PARTITION BY guid ORDER BY ts, event_id) AS epoch FROM t)"""


def trends(spark, d):
    e = table(spark, d, "events")
    guid = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM"))
    x = e.select(guid.alias("guid"), "ts", "event_id", (F.col("value") / (F.col("value") + 20)).alias("prob"), (F.col("value") >= 35).alias("correct"))
    return x.withColumn("epoch", F.row_number().over(W.partitionBy("guid").orderBy("ts", "event_id"))).drop("ts", "event_id")


@query("AGG_01", f"""WITH {_TREND} SELECT guid, round(avg(prob), 4) AS confidence, round(stddev_pop(prob), 4) AS variability, round(avg(correct::INT), 4) AS correctness FROM e GROUP BY guid""")
def cartography(spark, d):
    return trends(spark, d).groupBy("guid").agg(F.round(F.avg("prob"), 4).alias("confidence"), F.round(F.stddev_pop("prob"), 4).alias("variability"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("correctness"))


@query("AGG_02", f"""WITH {_TREND}, l AS (SELECT guid, correct, lag(correct) OVER (PARTITION BY guid ORDER BY epoch) AS p FROM e)
SELECT guid, CASE WHEN NOT bool_or(correct) THEN 999 ELSE coalesce(sum((p AND NOT correct)::INT), 0) END AS forgetfulness FROM l GROUP BY guid""")
def forgetting(spark, d):
    return A.coordinates(trends(spark, d), "guid", ["epoch"], "prob", "correct").select("guid", "forgetfulness")


@query("AGG_03", "SELECT node, count(*) AS degree FROM (SELECT source_name AS node FROM annotated_triples UNION ALL SELECT target_name FROM annotated_triples) GROUP BY node")
def degree(spark, d):
    return A.degrees(table(spark, d, "annotated_triples"), "source_name", "target_name")


_MERGED = "SELECT source_name, target_name, rel_type, count(*) AS evidence, count(DISTINCT extracted_at) AS sources, min_by(provenance, triple_id) AS provenance, max(confidence) AS base FROM annotated_triples GROUP BY 1, 2, 3"


def _merged(spark, d):
    e = table(spark, d, "annotated_triples").withColumnRenamed("extracted_at", "source_hash")
    return A.merged_edges(e, ["source_name", "target_name", "rel_type"], "triple_id")


@query("AGG_04", _MERGED)
def parallel(spark, d):
    return _merged(spark, d)


@query("AGG_05", f"""SELECT source_name, target_name, rel_type, round(least(1.0, coalesce(CASE WHEN evidence % 2 = 0 THEN base END, CASE upper(trim(provenance)) WHEN 'SEC_EXHIBIT_21' THEN 1.0 WHEN 'SEC_FORM_4' THEN 1.0 WHEN 'SEC_10K_ITEM1' THEN 0.98
WHEN 'SEC_10Q' THEN 0.95 WHEN 'SEC_8K' THEN 0.95 WHEN 'MULTI_TEACHER_CONSENSUS' THEN 0.85 WHEN 'FINANCIAL_NEWS_VERIFIED' THEN 0.75 WHEN 'NEWS_EXTRACTION' THEN 0.6 WHEN 'UNVERIFIED_RUMOR' THEN 0.4 ELSE 0.6 END)::DOUBLE
+ CASE WHEN evidence > 1 THEN 0.05 * least(4, evidence - 1) ELSE 0 END), 3) AS confidence FROM ({_MERGED})""")
def confidence(spark, d):
    # a stated base for every second amount of evidence, the origin's for the others
    base = F.when(F.col("evidence") % 2 == 0, F.col("base"))
    return _merged(spark, d).select("source_name", "target_name", "rel_type", A.calibrated(base, F.col("provenance"), F.col("evidence")).alias("confidence"))


@query("AGG_06", "SELECT ticker, min_by(company_name, date_added || company_name) FILTER (company_name IS NOT NULL AND date_added IS NOT NULL) AS company_name, min_by(gics_sector, coalesce(date_added, '9') || cik) AS sector FROM sp500_constituents GROUP BY ticker")
def first_known(spark, d):
    s = table(spark, d, "sp500_constituents")
    return s.groupBy("ticker").agg(F.min_by("company_name", F.when(F.col("date_added").isNotNull(), F.concat("date_added", "company_name"))).alias("company_name"), F.min_by("gics_sector", F.concat(F.coalesce("date_added", F.lit("9")), "cik")).alias("sector"))


@query("AGG_07", "SELECT l_partkey AS target, l_returnflag AS grp, round(sum(l_discount), 6) AS total FROM lineitem GROUP BY 1, 2 HAVING sum(l_discount) > 1 + 1e-6")
def overfull(spark, d):
    x = A.over_full_groups(table(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("grp"), "l_discount"), "target", "grp", "l_discount")
    return x.select("target", "grp", F.round("total", 6).alias("total"))


@query("AGG_10", "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def facets(spark, d):
    return A.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("AGG_11", "SELECT gics_sector AS sector, count(*) AS n FROM sp500_constituents WHERE is_current GROUP BY 1 ORDER BY n DESC, sector")
def sectors(spark, d):
    return table(spark, d, "sp500_constituents").where("is_current").groupBy(F.col("gics_sector").alias("sector")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sector")


@query("AGG_12", """WITH c AS (SELECT event_type, user_id % 3 AS grp, user_id, count(*) AS k FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, grp ORDER BY user_id) AS i FROM c)
SELECT event_type, grp, sum(k)::BIGINT AS n, count(*) AS docs, list(user_id ORDER BY user_id) FILTER (i <= 5) AS examples FROM r GROUP BY 1, 2""")
def rejections(spark, d):
    return A.signatures(table(spark, d, "events").withColumn("grp", F.col("user_id") % 3), ["event_type", "grp"], "user_id")


@query("AGG_14", "SELECT count(*) AS total, sum((event_type = 'purchase')::INT)::BIGINT AS gaps, round(avg((event_type = 'purchase')::INT), 6) AS rate, avg((event_type = 'purchase')::INT) <= 0.05 AS converged FROM events")
def convergence(spark, d):
    hit = (F.col("event_type") == "purchase").cast("int")
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.sum(hit).alias("gaps"), F.round(F.avg(hit), 6).alias("rate"), (F.avg(hit) <= 0.05).alias("converged"))


@query("AGG_15", "SELECT event_type, user_id % 5 AS task, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5))")
def summaries(spark, d):
    table(spark, d, "events").withColumn("task", F.col("user_id") % 5).createOrReplaceTempView("quarry_events")
    return spark.sql("SELECT event_type, task, count(*) AS n FROM quarry_events GROUP BY GROUPING SETS ((event_type), (task))")


@query("AGG_17", "SELECT count(*) AS total, round(avg((o_orderstatus <> 'P')::INT), 6) AS success, round(avg((o_totalprice > 100000)::INT), 6) AS nonempty, round(avg(o_totalprice), 4) AS mean FROM orders")
def evaluation(spark, d):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, d, "orders").agg(F.count("*").alias("total"), rate(F.col("o_orderstatus") != "P").alias("success"), rate(F.col("o_totalprice") > 100000).alias("nonempty"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("AGG_18", """WITH s AS (SELECT o_orderstatus = 'F' AS side, count(*) AS n, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
SELECT round((b.n - a.n) * 100.0 / a.n, 4) AS gain_pct, round((1 - b.v / a.v) * 100, 4) AS compression_pct FROM s a, s b WHERE NOT a.side AND b.side""")
def ab_diff(spark, d):
    f = F.col("o_orderstatus") == "F"
    x = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").agg(*[F.sum(F.when(c, v)).alias(n) for n, c, v in (("an", ~f, F.lit(1)), ("bn", f, F.lit(1)), ("av", ~f, F.col("o_totalprice")), ("bv", f, F.col("o_totalprice")))])
    return x.select(F.round((F.col("bn") - F.col("an")) * 100.0 / F.col("an"), 4).alias("gain_pct"), F.round((1 - F.col("bv") / F.col("av")) * 100, 4).alias("compression_pct"))


@query("AGG_19", "SELECT event_type AS axis, CASE WHEN value < 20 THEN 'short' WHEN value < 60 THEN 'middle' ELSE 'long' END AS bucket, round(avg((user_id % 4 > 0)::INT), 6) AS pass_rate FROM events GROUP BY 1, 2")
def pass_rates(spark, d):
    b = F.when(F.col("value") < 20, "short").when(F.col("value") < 60, "middle").otherwise("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("axis"), b.alias("bucket")).agg(F.round(F.avg((F.col("user_id") % 4 > 0).cast("int")), 6).alias("pass_rate"))


@query("AGG_20", "SELECT metadata.task_type AS task, count(*) AS n, round(avg(metadata.difficulty_score), 6) AS difficulty FROM sft_records GROUP BY 1")
def scorecard(spark, d):
    return table(spark, d, "sft_records").groupBy(F.col("metadata.task_type").alias("task")).agg(F.count("*").alias("n"), F.round(F.avg("metadata.difficulty_score"), 6).alias("difficulty"))


_VOTES = "SELECT event_id, event_type, CASE WHEN event_id % 7 > 0 THEN value > 50 END AS a, CASE WHEN event_id % 5 > 0 THEN user_id % 2 = 0 END AS b, value > 30 AS c FROM events"


def votes(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.when(F.col("event_id") % 7 > 0, F.col("value") > 50).alias("a"), F.when(F.col("event_id") % 5 > 0, F.col("user_id") % 2 == 0).alias("b"), (F.col("value") > 30).alias("c"))


_YN = f"v AS (SELECT *, coalesce(a::INT, 0) + coalesce(b::INT, 0) + c::INT AS yes, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 AS n FROM ({_VOTES}))"


@query("AGG_21", f"WITH {_YN} SELECT event_id, CASE WHEN n >= 2 THEN CASE WHEN yes * 2 > n THEN true WHEN yes * 2 < n THEN false END END AS verdict, n >= 2 AND (yes = 0 OR yes = n) AS unanimous FROM v")
def judged(spark, d):
    v, u = A.consensus([F.col("a"), F.col("b"), F.col("c")])
    return votes(spark, d).select("event_id", v.alias("verdict"), u.alias("unanimous"))


@query("AGG_22", f"""WITH {_YN}, j AS (SELECT event_type, c AS truth, CASE WHEN n >= 2 THEN CASE WHEN yes * 2 > n THEN true WHEN yes * 2 < n THEN false END END AS p FROM v)
SELECT event_type, count(*) FILTER (truth AND p) AS tp, count(*) FILTER (NOT truth AND p) AS fp, count(*) FILTER (truth AND NOT p) AS fn, count(*) FILTER (NOT truth AND NOT p) AS tn, count(*) FILTER (p IS NULL) AS open FROM j GROUP BY 1""")
def confusion(spark, d):
    p, _ = A.consensus([F.col("a"), F.col("b"), F.col("c")])
    x = votes(spark, d).withColumn("p", p)
    t = F.col("c")
    return x.groupBy("event_type").agg(F.count_if(t & F.col("p")).alias("tp"), F.count_if(~t & F.col("p")).alias("fp"), F.count_if(t & ~F.col("p")).alias("fn"), F.count_if(~t & ~F.col("p")).alias("tn"), F.count_if(F.col("p").isNull()).alias("open"))


@query("AGG_23", """WITH c AS (SELECT event_type, sum((value > 50)::INT) AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1)
SELECT event_type, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c""")
def interval(spark, d):
    lo, hi = A.wilson(F.col("k"), F.col("n"))
    return table(spark, d, "events").groupBy("event_type").agg(F.sum((F.col("value") > 50).cast("int")).alias("k"), F.count("*").alias("n")).select("event_type", lo.alias("low"), hi.alias("high"))


@query("AGG_24", f"""WITH {_YN}, x AS (SELECT yes, n FROM v WHERE n = 3), s AS (SELECT avg((yes * (yes - 1) + (n - yes) * (n - yes - 1)) / (n * (n - 1))) AS p, sum(yes) / sum(n) AS q FROM x)
SELECT round((p - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) AS kappa FROM s""")
def kappa(spark, d):
    cols = [F.col(c) for c in "abc"]
    x = votes(spark, d).select(sum(F.coalesce(c.cast("int"), F.lit(0)) for c in cols).alias("yes"), sum(c.isNotNull().cast("int") for c in cols).alias("n"))
    return A.fleiss_kappa(x.where("n = 3"), "yes", "n")


@query("AGG_25", "SELECT metadata.task_type AS task, metadata.provenance AS provenance, count(*) AS n FROM dpo_records GROUP BY 1, 2")
def cohorts(spark, d):
    return table(spark, d, "dpo_records").groupBy(F.col("metadata.task_type").alias("task"), F.col("metadata.provenance").alias("provenance")).agg(F.count("*").alias("n"))


@query("AGG_26", f"WITH {_TREND} SELECT guid, round(coalesce(sum(prob) FILTER (epoch IN (1, 2, 3, 5, 8)), 0) / 5, 6) AS aulc FROM e GROUP BY guid")
def early_area(spark, d):
    return trends(spark, d).groupBy("guid").agg(F.round(F.coalesce(F.sum(F.when(F.col("epoch").isin(1, 2, 3, 5, 8), F.col("prob"))), F.lit(0.0)) / 5, 6).alias("aulc"))


@query("AGG_27", "SELECT sample_id, min_by(record_no, (coalesce(metadata.difficulty_score, 9), record_no)) AS record_no FROM sft_records GROUP BY 1")
def easiest(spark, d):
    return table(spark, d, "sft_records").groupBy("sample_id").agg(F.min_by("record_no", F.struct(F.coalesce("metadata.difficulty_score", F.lit(9.0)), "record_no")).alias("record_no"))


@query("AGG_28", "SELECT count(*) AS leaked FROM (SELECT md5(prompt || '|' || coalesce(target_completion, '')) AS h FROM sft_records WHERE split = 'train' INTERSECT SELECT md5(prompt || '|' || coalesce(target_completion, '')) FROM sft_records WHERE split = 'validation')")
def leaks(spark, d):
    s = table(spark, d, "sft_records").select("split", F.md5(F.concat_ws("|", "prompt", F.coalesce("target_completion", F.lit("")))).alias("h"))
    return s.where("split = 'train'").select("h").intersect(s.where("split = 'validation'").select("h")).agg(F.count("*").alias("leaked"))


@query("AGG_29", """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM x GROUP BY 1""")
def percentiles(spark, d):
    return A.ranked_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("AGG_30", f"WITH {_TREND} SELECT split_part(guid, '|', 2) AS task, round(avg(prob) FILTER (epoch = 1), 6) AS s1, round(avg(prob) FILTER (epoch = 2), 6) AS s2 FROM e GROUP BY 1")
def task_steps(spark, d):
    x = trends(spark, d).withColumn("task", F.split_part("guid", F.lit("|"), F.lit(2))).groupBy("task").pivot("epoch", [1, 2]).agg(F.avg("prob"))
    return x.select("task", F.round("1", 6).alias("s1"), F.round("2", 6).alias("s2"))


@query("AGG_31", "SELECT count(*) AS candidates, count(*) FILTER (status = 'ACTIVE_CURRENT') AS accepted, round(count(*) FILTER (status = 'ACTIVE_CURRENT') / count(*), 6) AS rate FROM annotated_triples")
def calibration(spark, d):
    ok = F.count_if(F.col("status") == "ACTIVE_CURRENT")
    return table(spark, d, "annotated_triples").agg(F.count("*").alias("candidates"), ok.alias("accepted"), F.round(ok / F.count("*"), 6).alias("rate"))


@query("AGG_32", "SELECT count(*) AS docs, count(DISTINCT md5(text)) AS kept, round(count(DISTINCT md5(text)) * 100.0 / count(*), 2) AS retention_pct FROM documents")
def stage_stats(spark, d):
    k = F.count_distinct(F.md5("text"))
    return table(spark, d, "documents").agg(F.count("*").alias("docs"), k.alias("kept"), F.round(k * 100.0 / F.count("*"), 2).alias("retention_pct"))


@query("WIN_01", f"WITH {_TREND} SELECT guid, epoch, coalesce(lag(correct) OVER (PARTITION BY guid ORDER BY epoch) AND NOT correct, false) AS fell FROM e")
def falls(spark, d):
    return trends(spark, d).select("guid", "epoch", F.coalesce(F.lag("correct").over(W.partitionBy("guid").orderBy("epoch")) & ~F.col("correct"), F.lit(False)).alias("fell"))


@query("WIN_04", "SELECT source_hash, id FROM financial_news_queue QUALIFY row_number() OVER (PARTITION BY source_hash ORDER BY id) = 1")
def first_seen(spark, d):
    return table(spark, d, "financial_news_queue").groupBy("source_hash").agg(F.min("id").alias("id"))


@query("WIN_05", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def longest(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"))


@query("WIN_07", "SELECT ticker, company_name FROM sp500_constituents QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY is_current DESC, length(company_name) DESC, company_name, cik) = 1")
def canonical(spark, d):
    return table(spark, d, "sp500_constituents").groupBy("ticker").agg(F.min_by("company_name", F.struct((~F.col("is_current")), -F.length("company_name"), "company_name", "cik")).alias("company_name"))


@query("WIN_09", "SELECT split, record_no FROM sft_records QUALIFY row_number() OVER (PARTITION BY split ORDER BY record_no) <= 7")
def first_n(spark, d):
    return table(spark, d, "sft_records").withColumn("r", F.row_number().over(W.partitionBy("split").orderBy("record_no"))).where("r <= 7").select("split", "record_no")


@query("WIN_11", "SELECT record_no, (row_number() OVER (PARTITION BY metadata.task_type ORDER BY record_no) - 1) % 3 AS style FROM dpo_records")
def round_robin(spark, d):
    x = table(spark, d, "dpo_records").select("record_no", F.col("metadata.task_type").alias("task"))
    return ranked(x, ["task"], ["record_no"]).select("record_no", (F.col("_rank") % 3).alias("style"))


@query("WIN_12", "SELECT chunk_id, lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS ordinal, p AS part FROM (SELECT chunk_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM (SELECT DISTINCT chunk_id, text FROM filing_chunks))")
def ordinals(spark, d):
    c = table(spark, d, "filing_chunks").select("chunk_id", "text").distinct()
    return c.select("chunk_id", F.posexplode(F.split("text", "\n\n")).alias("i", "part")).select("chunk_id", F.lpad(F.col("i").cast("string"), 3, "0").alias("ordinal"), "part")


@query("TOP_02", "SELECT triple_id, source_name, target_name FROM annotated_triples ORDER BY rel_type, source_name, target_name, triple_id LIMIT 25")
def top_edges(spark, d):
    return table(spark, d, "annotated_triples").orderBy("rel_type", "source_name", "target_name", "triple_id").limit(25).select("triple_id", "source_name", "target_name")


@query("TOP_05", "SELECT id, title FROM financial_news_queue ORDER BY id LIMIT 20 OFFSET 40")
def page(spark, d):
    return table(spark, d, "financial_news_queue").select("id", "title").orderBy("id").offset(40).limit(20)


@query("TOP_09", "SELECT event_type, user_id % 3 AS grp, count(DISTINCT user_id) AS docs, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY docs DESC, n DESC, 1, 2")
def sorted_signatures(spark, d):
    x = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 3).alias("grp")).agg(F.count_distinct("user_id").alias("docs"), F.count("*").alias("n"))
    return x.orderBy(F.desc("docs"), F.desc("n"), "event_type", "grp")
