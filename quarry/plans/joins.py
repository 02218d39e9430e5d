"""Joins and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.core.runtime import table
from quarry.functions import text as T
from quarry.operators import joins as J
from quarry.plans.registry import query

TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("JOI_01", """WITH n AS (SELECT company_name AS nm, min(ticker) AS t FROM sp500_constituents GROUP BY 1)
SELECT triple_id, coalesce(a.t, upper(source_name)) AS source, coalesce(b.t, upper(target_name)) AS target FROM annotated_triples LEFT JOIN n a ON a.nm = source_name LEFT JOIN n b ON b.nm = target_name""")
def endpoints(spark, d):
    e, c = table(spark, d, "annotated_triples"), table(spark, d, "sp500_constituents")
    e = J.lookup(e, c, "source_name", "company_name", "ticker", "source", F.upper("source_name"))
    return J.lookup(e, c, "target_name", "company_name", "ticker", "target", F.upper("target_name")).select("triple_id", "source", "target")


@query("JOI_02", """WITH m AS (SELECT source_name AS node, min(source_cik) AS c FROM annotated_triples WHERE source_cik IS NOT NULL GROUP BY 1)
SELECT triple_id, coalesce(a.c, source_name) AS source, coalesce(b.c, target_name) AS target FROM annotated_triples LEFT JOIN m a ON a.node = source_name LEFT JOIN m b ON b.node = target_name WHERE coalesce(a.c, source_name) <> coalesce(b.c, target_name)""")
def rewired(spark, d):
    e = table(spark, d, "annotated_triples")
    m = e.where("source_cik is not null").groupBy(F.col("source_name").alias("node")).agg(F.min("source_cik").alias("canonical"))
    return J.rewire(e.select("triple_id", F.col("source_name").alias("source"), F.col("target_name").alias("target")), m)


@query("JOI_03", "SELECT n_name, r_name, s_name FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def registry(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "s_name")


@query("JOI_04", "SELECT a.ticker AS ticker, a.cik AS cik, b.cik AS other FROM sp500_constituents a JOIN sp500_constituents b ON a.ticker = b.ticker AND a.cik <> b.cik")
def residual(spark, d):
    c = table(spark, d, "sp500_constituents").select("ticker", "cik")
    b = c.select(F.col("ticker").alias("t"), F.col("cik").alias("other"))
    return c.join(b, (F.col("ticker") == F.col("t")) & (F.col("cik") != F.col("other"))).select("ticker", "cik", "other")


_NAMES = "SELECT DISTINCT source_name AS name, source_ticker AS tick FROM annotated_triples WHERE source_type = 'Company'"
_CK = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '" + T.COMPANY_SUFFIXES + "', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("JOI_05", f"""WITH n AS (SELECT name, min(tick) AS tick FROM ({_NAMES}) GROUP BY name), c AS (SELECT DISTINCT ticker, cik, company_name FROM sp500_constituents),
t1 AS (SELECT name, min(cik) AS m FROM n JOIN c ON tick = ticker GROUP BY 1), t2 AS (SELECT name, min(cik) AS m FROM n JOIN c ON {_CK.format('name')} = {_CK.format('company_name')} GROUP BY 1)
SELECT n.name, coalesce(t1.m, t2.m) AS match, CASE WHEN t1.m IS NOT NULL THEN 'ticker' WHEN t2.m IS NOT NULL THEN 'name' END AS tier FROM n LEFT JOIN t1 USING (name) LEFT JOIN t2 USING (name)""")
def tiers(spark, d):
    e, c = table(spark, d, "annotated_triples"), table(spark, d, "sp500_constituents")
    n = e.where("source_type = 'Company'").groupBy(F.col("source_name").alias("name")).agg(F.min("source_ticker").alias("tick"))
    by_ticker = n.join(c, F.col("tick") == F.col("ticker")).select("name", F.col("cik").alias("match"), F.lit(1.0).alias("score"))
    keyed = c.select(T.company_key(F.col("company_name")).alias("k"), "cik")
    by_name = n.withColumn("k", T.company_key(F.col("name"))).join(keyed, "k").select("name", F.col("cik").alias("match"), F.lit(1.0).alias("score"))
    return J.tiered(n.select("name"), "name", [("ticker", by_ticker), ("name", by_name)]).select("name", "match", "tier")


@query("JOI_06", f"""WITH l AS (SELECT DISTINCT source_name AS name, {TRI.format('source_name')} AS g FROM annotated_triples WHERE source_type = 'Subsidiary'), r AS (SELECT DISTINCT company_name AS match, {TRI.format('company_name')} AS g FROM sp500_constituents),
x AS (SELECT name, match, round(len(list_intersect(l.g, r.g)) / (len(l.g) + len(r.g) - len(list_intersect(l.g, r.g))), 6) AS score FROM l, r)
SELECT name, match, score FROM x WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, match) = 1""")
def trigram(spark, d):
    l = table(spark, d, "annotated_triples").where("source_type = 'Subsidiary'").select(F.col("source_name").alias("name")).distinct()
    return J.fuzzy_names(l, table(spark, d, "sp500_constituents").select(F.col("company_name").alias("match")), "name", "name")


@query("JOI_08", """SELECT id FROM financial_news_queue n WHERE EXISTS (SELECT 1 FROM sp500_constituents s WHERE s.ticker = n.ticker_symbols[1] AND coalesce(s.date_added, '1957-03-04') <= strftime(n.fetched_at, '%Y-%m-%d') AND (s.date_removed IS NULL OR s.date_removed > strftime(n.fetched_at, '%Y-%m-%d')))""")
def membership(spark, d):
    n = table(spark, d, "financial_news_queue").select("id", F.get("ticker_symbols", 0).alias("tick"), F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))
    s = table(spark, d, "sp500_constituents")
    return n.join(s, (F.col("tick") == s["ticker"]) & J.members_at(s, n["day"]), "left_semi").select("id")


_PRICE = "SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2"
_EVENT = "SELECT c_custkey, min(CAST(o_orderdate AS DATE)) AS at, min_by(o_orderstatus, o_orderkey) AS ticker FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"


def prices(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("ticker"), F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("close"))


def first_orders(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_custkey").agg(F.min(F.to_date("o_orderdate")).alias("at"), F.min_by("o_orderstatus", "o_orderkey").alias("ticker"))


@query("JOI_09", f"""WITH p AS ({_PRICE}), e AS ({_EVENT}), w AS (SELECT e.*, p.day FROM e ASOF LEFT JOIN p ON p.ticker = e.ticker AND p.day <= e.at), f AS (SELECT ticker, min(day) AS f FROM p GROUP BY 1)
SELECT c_custkey, coalesce(w.day, f.f) AS anchor_day FROM w LEFT JOIN f USING (ticker)""")
def anchor(spark, d):
    return J.as_of(first_orders(spark, d), prices(spark, d), "ticker", "at", "day", "close", "anchor").select("c_custkey", "anchor_day")


@query("JOI_10", f"""WITH p AS ({_PRICE}), b AS (SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS bench FROM orders GROUP BY 1)
SELECT ticker, p.day, close, coalesce(bench, 0) AS bench FROM p LEFT JOIN b USING (day)""")
def benchmark(spark, d):
    b = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("bench"))
    return prices(spark, d).join(b, "day", "left").select("ticker", "day", "close", F.coalesce("bench", F.lit(0.0)).alias("bench"))


@query("JOI_13", "SELECT record_no FROM sft_records WHERE split = 'train' AND sample_id NOT IN (SELECT sample_id FROM sft_records WHERE split = 'test')")
def held_out(spark, d):
    s = table(spark, d, "sft_records")
    return s.where("split = 'train'").join(s.where("split = 'test'").select("sample_id"), "sample_id", "left_anti").select("record_no")


@query("JOI_14", """WITH k AS (SELECT least(source_name, target_name) AS a, greatest(source_name, target_name) AS b FROM annotated_triples WHERE rel_type = 'SUPPLIES_TO')
SELECT triple_id FROM annotated_triples t WHERE rel_type <> 'SUPPLIES_TO' AND NOT EXISTS (SELECT 1 FROM k WHERE a = least(source_name, target_name) AND b = greatest(source_name, target_name))""")
def unknown_pairs(spark, d):
    e = table(spark, d, "annotated_triples")
    return J.without_pairs(e.where("rel_type <> 'SUPPLIES_TO'"), e.where("rel_type = 'SUPPLIES_TO'"), "source_name", "target_name").select("triple_id")


@query("JOI_16", """SELECT a.triple_id AS event, b.triple_id AS edge FROM annotated_triples a JOIN annotated_triples b ON least(a.source_name, a.target_name) = least(b.source_name, b.target_name) AND greatest(a.source_name, a.target_name) = greatest(b.source_name, b.target_name) AND a.triple_id <> b.triple_id WHERE a.status <> 'ACTIVE_CURRENT'""")
def undirected(spark, d):
    e = table(spark, d, "annotated_triples")
    k = [F.least("source_name", "target_name").alias("a"), F.greatest("source_name", "target_name").alias("b")]
    x, y = e.where("status <> 'ACTIVE_CURRENT'").select(F.col("triple_id").alias("event"), *k), e.select(F.col("triple_id").alias("edge"), *k)
    return x.join(y, ["a", "b"]).where("event <> edge").select("event", "edge")


@query("JOI_18", "SELECT record_no, s.split, c.headcount FROM sft_records s LEFT JOIN (SELECT metadata.provenance AS p, count(*) AS headcount FROM dpo_records GROUP BY 1) c ON c.p = s.metadata.provenance")
def enrich(spark, d):
    c = table(spark, d, "dpo_records").groupBy(F.col("metadata.provenance").alias("p")).agg(F.count("*").alias("headcount"))
    s = table(spark, d, "sft_records").withColumn("p", F.col("metadata.provenance"))
    return s.join(F.broadcast(c), "p", "left").select("record_no", "split", "headcount")


@query("JOI_19", "SELECT id, source_hash FROM financial_news_queue WHERE source_hash IN (SELECT source_hash FROM financial_news_queue WHERE status = 'failed') ORDER BY id LIMIT 5")
def in_list(spark, d):
    n = table(spark, d, "financial_news_queue")
    return n.join(n.where("status = 'failed'").select("source_hash"), "source_hash", "left_semi").select("id", "source_hash").orderBy("id").limit(5)


@query("JOI_20", """WITH t AS (SELECT ticker, min(listing_exchange) AS x FROM sp500_constituents WHERE is_current AND upper(listing_exchange) <> 'UNKNOWN' GROUP BY 1), c AS (SELECT cik, min(listing_exchange) AS x FROM sp500_constituents WHERE upper(listing_exchange) <> 'UNKNOWN' GROUP BY 1)
SELECT DISTINCT s.ticker, s.cik, coalesce(t.x, c.x, 'UNKNOWN') AS exchange FROM sp500_constituents s LEFT JOIN t USING (ticker) LEFT JOIN c ON c.cik = s.cik""")
def exchanges(spark, d):
    s = table(spark, d, "sp500_constituents")
    known = s.where("upper(listing_exchange) <> 'UNKNOWN'")
    x = J.lookup(s.select("ticker", "cik"), known.where("is_current"), "ticker", "ticker", "listing_exchange", "a")
    x = J.lookup(x, known, "cik", "cik", "listing_exchange", "b")
    return x.select("ticker", "cik", F.coalesce("a", "b", F.lit("UNKNOWN")).alias("exchange")).distinct()


@query("JOI_21", """WITH a AS (SELECT * FROM (VALUES ('2015-01-01'), ('2015-06-30'), ('2015-12-31')) t(day))
SELECT ticker, max(day) AS last_day, count(DISTINCT day) AS anchors FROM sp500_constituents, a WHERE coalesce(date_added, '1957-03-04') <= day AND (date_removed IS NULL OR date_removed > day) GROUP BY 1""")
def anchors(spark, d):
    s = table(spark, d, "sp500_constituents")
    x = s.withColumn("day", F.explode(F.array(*[F.lit(v) for v in ("2015-01-01", "2015-06-30", "2015-12-31")])))
    return x.where(J.members_at(x, x["day"])).groupBy("ticker").agg(F.max("day").alias("last_day"), F.count_distinct("day").alias("anchors"))


@query("SET_01", "SELECT ticker, cik FROM (SELECT ticker, cik, row_number() OVER (PARTITION BY ticker ORDER BY p, cik) AS r FROM (SELECT ticker, cik, CASE WHEN is_current THEN 1 ELSE 0 END AS p FROM sp500_constituents)) WHERE r = 1")
def union_first(spark, d):
    s = table(spark, d, "sp500_constituents")
    u = s.where("not is_current").withColumn("p", F.lit(0)).unionByName(s.where("is_current").withColumn("p", F.lit(1)))
    return u.withColumn("r", F.row_number().over(W.partitionBy("ticker").orderBy("p", "cik"))).where("r = 1").select("ticker", "cik")


@query("SET_02", "SELECT prompt, target_completion FROM sft_records WHERE split = 'train' INTERSECT SELECT prompt, target_completion FROM sft_records WHERE split = 'test'")
def leakage(spark, d):
    s = table(spark, d, "sft_records").select("split", "prompt", "target_completion")
    return s.where("split = 'train'").drop("split").intersect(s.where("split = 'test'").drop("split"))


@query("SET_03", "SELECT source_name AS name FROM annotated_triples EXCEPT SELECT company_name FROM sp500_constituents")
def difference(spark, d):
    return table(spark, d, "annotated_triples").select(F.col("source_name").alias("name")).exceptAll(table(spark, d, "sp500_constituents").select("company_name")).distinct().join(table(spark, d, "sp500_constituents").select(F.col("company_name").alias("name")), "name", "left_anti")


@query("SET_04", "SELECT source_ticker AS ticker FROM annotated_triples WHERE source_ticker IS NOT NULL UNION SELECT target_ticker FROM annotated_triples WHERE target_ticker IS NOT NULL")
def tickers(spark, d):
    e = table(spark, d, "annotated_triples")
    return e.select(F.col("source_ticker").alias("ticker")).union(e.select("target_ticker")).where("ticker is not null").distinct()


@query("SET_06", "SELECT a.ticker AS ticker, b.ticker AS other FROM sp500_constituents a JOIN sp500_constituents b ON a.gics_sub_industry = b.gics_sub_industry AND a.ticker < b.ticker AND list_has_all(string_split(lower(b.company_name), ' '), string_split(lower(a.company_name), ' '))")
def contained(spark, d):
    c = table(spark, d, "sp500_constituents").select("ticker", "gics_sub_industry", F.split(F.lower("company_name"), " ").alias("w"))
    b = c.select(F.col("ticker").alias("other"), "gics_sub_industry", F.col("w").alias("v"))
    return c.join(b, "gics_sub_industry").where("ticker < other and size(array_except(w, v)) = 0").select("ticker", "other")


@query("SET_07", "SELECT source_name AS a, target_name AS b FROM annotated_triples UNION SELECT target_name, source_name FROM annotated_triples")
def closure(spark, d):
    e = table(spark, d, "annotated_triples")
    return e.select(F.col("source_name").alias("a"), F.col("target_name").alias("b")).union(e.select("target_name", "source_name")).distinct()
