"""Filters and projections over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import table
from quarry.functions import text as T
from quarry.operators import predicates as P
from quarry.plans.registry import query

ND = "CASE WHEN lower(trim({0})) NOT IN ('', 'none', 'null', 'nan') THEN substr(trim({0}), 1, 10) END"
LIST = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
LISTED = lambda n, xs: (
    f"coalesce(trim(regexp_replace(trim(lower({n})), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) IN {LIST(xs)} OR trim(lower({n})) IN {LIST(xs)} OR "
    + " OR ".join(f"contains(trim(regexp_replace(trim(lower({n})), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '{x}')" for x in xs if len(x) >= 6) + ", false)"
)


@query("FLT_01", f"""SELECT triple_id, source_name, target_name, rel_type FROM annotated_triples
WHERE rel_type IN ('SUPPLIES_TO', 'SUBSIDIARY_OF') AND status = 'ACTIVE_CURRENT' AND ({ND.format('valid_from')} IS NULL OR {ND.format('valid_from')} <= '2023-06-30') AND ({ND.format('valid_to')} IS NULL OR {ND.format('valid_to')} >= '2023-06-30')""")
def edge_predicate(spark, d):
    e = P.edges_at(table(spark, d, "annotated_triples"), "2023-06-30", "ACTIVE_CURRENT", ("SUPPLIES_TO", "SUBSIDIARY_OF"))
    return e.select("triple_id", "source_name", "target_name", "rel_type")


@query("FLT_02", f"""SELECT triple_id, upper(trim(source_name)) AS source, upper(trim(target_name)) AS target, coalesce(nullif(rel_type, ''), 'SUPPLIES_TO') AS rel,
coalesce(nullif(status, ''), 'ACTIVE_CURRENT') AS state, {ND.format('valid_from')} AS since, round(confidence * 100, 4) AS exposure_pct, confidence AS share FROM annotated_triples""")
def edge_projection(spark, d):
    e = table(spark, d, "annotated_triples")
    return e.select(
        "triple_id", F.upper(F.trim("source_name")).alias("source"), F.upper(F.trim("target_name")).alias("target"), F.coalesce(F.nullif("rel_type", F.lit("")), F.lit("SUPPLIES_TO")).alias("rel"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("ACTIVE_CURRENT")).alias("state"), T.normal_date(F.col("valid_from")).alias("since"),
        F.round(F.col("confidence") * 100, 4).alias("exposure_pct"), F.col("confidence").alias("share"),
    )


@query("FLT_03", f"SELECT id, {ND.format('published_at')} AS day FROM financial_news_queue")
def date_strings(spark, d):
    return table(spark, d, "financial_news_queue").select("id", T.normal_date(F.col("published_at")).alias("day"))


@query("FLT_04", f"""SELECT triple_id FROM annotated_triples WHERE coalesce(try_cast(CASE WHEN regexp_matches({ND.format('valid_from')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {ND.format('valid_from')} END AS DATE)
 <= try_cast(CASE WHEN regexp_matches({ND.format('valid_to')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {ND.format('valid_to')} END AS DATE), true)""")
def bounds(spark, d):
    return table(spark, d, "annotated_triples").where(P.bounds_in_order(F.col("valid_from"), F.col("valid_to"))).select("triple_id")


@query("FLT_05", """SELECT triple_id, source_ticker, target_ticker FROM annotated_triples WHERE upper(polarity) = 'NEUTRAL_STABLE' AND upper(status) = 'ACTIVE_CURRENT'
AND contains(lower(provenance), 'sec') AND (upper(source_ticker) = 'JNTQ' OR upper(target_ticker) = 'JNTQ')""")
def cohort(spark, d):
    e = P.cohort_filter(table(spark, d, "annotated_triples"), {"polarity": "neutral_stable", "status": "active_current"}, {"provenance": "SEC"}, ("source_ticker", "target_ticker", "jntq"))
    return e.select("triple_id", "source_ticker", "target_ticker")


_PL = "('the company'), ('it'), ('IT'), ('Customer A'), ('our largest supplier'), ('a supplier of Acme Corp'), ('Unnamed partner'), ('Supplier #2'), ('Certain vendors'), ('')"
_CL = "trim(regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("FLT_06", f"""WITH n AS (SELECT DISTINCT source_name AS name FROM annotated_triples UNION SELECT * FROM (VALUES {_PL}) t(name))
SELECT name, coalesce({_CL} <> '' AND ({_CL} IN {LIST(P.PLACEHOLDERS)} OR lower(trim(name)) IN {LIST(P.PLACEHOLDERS)} OR ({_CL} IN {LIST(P.PRONOUNS)} AND NOT (length(trim(name)) <= 3 AND trim(name) = upper(trim(name))))
OR regexp_matches({_CL}, '^(certain|various|unnamed) ') OR regexp_matches({_CL}, '{P.COUNTERPARTY}') OR regexp_matches(trim(name), '{P.COUNTERPARTY}')
OR (regexp_matches({_CL}, '{P.ROLE}') AND NOT regexp_matches({_CL}, '{P.ROLE_FIRM}') AND NOT regexp_matches(trim(name), '{P.IDENTIFIED}'))), false) AS placeholder FROM n""")
def placeholders(spark, d):
    extra = spark.sql(f"SELECT name FROM VALUES {_PL} AS t(name)")
    n = table(spark, d, "annotated_triples").select(F.col("source_name").alias("name")).union(extra).distinct()
    return n.select("name", P.is_placeholder(F.col("name")).alias("placeholder"))


@query("FLT_07", f"SELECT id, {LISTED('provider', P.PUBLISHERS)} AS listed FROM financial_news_queue")
def publishers(spark, d):
    return table(spark, d, "financial_news_queue").select("id", P.is_listed(F.col("provider"), P.PUBLISHERS).alias("listed"))


@query("FLT_08", f"SELECT name, {LISTED('name', P.CLICKBAIT)} AS listed FROM (SELECT DISTINCT provider AS name FROM financial_news_queue UNION SELECT * FROM (VALUES ('The Motley Fool'), ('Zacks'), ('My Benzinga Pro'), ('fool')) t(x))")
def clickbait(spark, d):
    extra = spark.sql("SELECT * FROM VALUES ('The Motley Fool'), ('Zacks'), ('My Benzinga Pro'), ('fool') AS t(name)")
    n = table(spark, d, "financial_news_queue").select(F.col("provider").alias("name")).union(extra).distinct()
    return n.select("name", P.is_listed(F.col("name"), P.CLICKBAIT).alias("listed"))


_STUB = "(coalesce(len(regexp_extract_all(raw_text, '\\S+')) < {n} OR " + " OR ".join(f"contains(lower(raw_text), '{p}')" for p in T.PAYWALL_PHRASES) + ", true))"


@query("FLT_09", f"SELECT id FROM financial_news_queue WHERE {_STUB.format(n=150)}")
def stubs(spark, d):
    return table(spark, d, "financial_news_queue").where(T.is_stub(F.col("raw_text"), 150)).select("id")


@query("FLT_10", f"""SELECT n.id, substr(sha256(coalesce(nullif(trim(source_url), ''), raw_text)), 1, 32) AS h FROM financial_news_queue n
WHERE NOT {LISTED('provider', P.CLICKBAIT)} AND {ND.format('published_at')} IS NOT NULL AND len(ticker_symbols) > 0 AND NOT {_STUB.format(n=40)}
AND EXISTS (SELECT 1 FROM sp500_constituents s WHERE list_contains(n.ticker_symbols, s.ticker) AND coalesce(s.date_added, '1957-03-04') <= substr(CAST(n.fetched_at AS VARCHAR), 1, 10) AND (s.date_removed IS NULL OR s.date_removed > substr(CAST(n.fetched_at AS VARCHAR), 1, 10)))""")
def news_gate(spark, d):
    n = table(spark, d, "financial_news_queue").where(~P.is_listed(F.col("provider"), P.CLICKBAIT) & T.normal_date(F.col("published_at")).isNotNull() & (F.size("ticker_symbols") > 0) & ~T.is_stub(F.col("raw_text")))
    x = n.select("id", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), F.explode("ticker_symbols").alias("ticker"))
    s = table(spark, d, "sp500_constituents").select("ticker", F.coalesce("date_added", F.lit("1957-03-04")).alias("f"), F.col("date_removed").alias("u"))
    member = (x["ticker"] == s["ticker"]) & (F.col("f") <= F.col("day")) & (F.col("u").isNull() | (F.col("u") > F.col("day")))
    ids = x.join(s, member, "left_semi").select("id").distinct()
    return n.join(ids, "id", "left_semi").select("id", T.source_hash(F.trim("source_url"), F.col("raw_text")).alias("h"))


@query("FLT_16", "SELECT id FROM financial_news_queue ORDER BY id LIMIT 100")
def clamped(spark, d):
    return table(spark, d, "financial_news_queue").select("id").orderBy("id").limit(min(500, 100))


@query("FLT_17", "SELECT id FROM financial_news_queue WHERE coalesce(title, '') <> '' AND coalesce(source_url, '') <> '' AND coalesce(raw_text, '') <> ''")
def required(spark, d):
    ok = [F.coalesce(c, F.lit("")) != "" for c in ("title", "source_url", "raw_text")]
    return table(spark, d, "financial_news_queue").where(ok[0] & ok[1] & ok[2]).select("id")


@query("FLT_18", """SELECT n.id FROM (SELECT id, fetched_at, regexp_replace(regexp_extract(lower(source_url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS dom FROM financial_news_queue WHERE source_url IS NOT NULL) n
LEFT JOIN domain_status d ON d.domain = n.dom AND d.status = 'blacklisted' WHERE d.domain IS NULL OR n.fetched_at > d.updated_at + INTERVAL 60 MINUTE""")
def blacklist(spark, d):
    n = table(spark, d, "financial_news_queue").where("source_url is not null").select("id", "fetched_at", T.url_domain(F.col("source_url")).alias("dom"))
    return P.not_blacklisted(n, table(spark, d, "domain_status"), "dom", "fetched_at").select("id")


@query("FLT_19", "SELECT ticker, company_name FROM sp500_constituents WHERE is_current AND upper(trim(listing_exchange)) LIKE '%NASDAQ%'")
def listed(spark, d):
    c = table(spark, d, "sp500_constituents")
    return c.where(F.col("is_current") & (T.exchange_name(F.col("listing_exchange")) == "NASDAQ")).select("ticker", "company_name")


@query("FLT_20", """SELECT o_orderkey AS k, 'C' || o_custkey AS s, 'N' || c_nationkey AS t FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'N' || c_nationkey, 'R' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'""")
def nested_edges(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    cid, nid, rid = (F.concat(F.lit(x), F.col(c).cast("string")) for x, c in (("C", "o_custkey"), ("N", "c_nationkey"), ("R", "n_regionkey")))
    return o.select(F.col("o_orderkey").alias("k"), F.inline(F.array(F.struct(cid.alias("s"), nid.alias("t")), F.struct(nid.alias("s"), rid.alias("t")))))


@query("FLT_21", """SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, coalesce(CASE WHEN l_linenumber = 1 THEN l_discount END, CASE WHEN l_linenumber = 2 THEN l_quantity END / 100,
CASE WHEN l_linenumber = 3 THEN CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END END, 1.0))), 6) AS share FROM lineitem""")
def shares(spark, d):
    x = table(spark, d, "lineitem")
    at = lambda n, c: F.when(F.col("l_linenumber") == n, F.col(c))
    x = x.select("l_orderkey", "l_linenumber", at(1, "l_discount").alias("share"), at(2, "l_quantity").alias("exposure_pct"), at(3, "l_quantity").alias("revenue_share"))
    return x.select("l_orderkey", "l_linenumber", F.round(P.share_of(["share", "exposure_pct", "revenue_share"]), 6).alias("share"))
