"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.core.runtime import table
from quarry.functions import clauses as C, text as T
from quarry.plans.graph import _KEY
from quarry.plans.joins import _CK, TRI
from quarry.plans.registry import query

WORDS = "len(regexp_extract_all({0}, '\\S+'))"


def names(spark, d):
    return table(spark, d, "sp500_constituents").select(F.col("company_name").alias("id")).distinct()


_N = "(SELECT DISTINCT company_name AS id FROM sp500_constituents)"


@query("SCA_01", f"SELECT id, {_KEY} AS k FROM {_N}")
def entity_keys(spark, d):
    return names(spark, d).select("id", T.entity_key(F.col("id")).alias("k"))


@query("SCA_02", f"SELECT id, {_CK.format('id')} AS k FROM {_N}")
def company_keys(spark, d):
    return names(spark, d).select("id", T.company_key(F.col("id")).alias("k"))


@query("SCA_03", f"""WITH w AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(id, '[,.()\\-&]', ' ', 'g'), '\\S+'), lambda w: lower(w) NOT IN ({', '.join(f"'{s}'" for s in T.INITIAL_STOPWORDS)})) AS w FROM {_N})
SELECT id, CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(w, lambda x: upper(substr(x, 1, 1))), '') ELSE '' END AS initials FROM w""")
def initials(spark, d):
    return names(spark, d).select("id", T.initialism(F.col("id")).alias("initials"))


@query("SCA_04", f"WITH n AS (SELECT id FROM {_N} ORDER BY id) SELECT a.id AS a, b.id AS b, round(jaro_winkler_similarity(a.id, b.id), 4) AS jw FROM n a JOIN n b ON substr(a.id, 1, 5) = substr(b.id, 1, 5) AND a.id < b.id WHERE jaro_winkler_similarity(a.id, b.id) >= 0.88")
def jaro_winkler(spark, d):
    n = names(spark, d).withColumn("p", F.substring("id", 1, 5))
    x = n.withColumnRenamed("id", "a").join(n.withColumnRenamed("id", "b"), "p").where("a < b")
    return x.select("a", "b", F.round(C.jaro_winkler(F.col("a"), F.col("b")), 4).alias("jw")).where("jw >= 0.88")


@query("SCA_05", f"WITH n AS (SELECT id FROM {_N}) SELECT a.id AS a, b.id AS b, levenshtein(a.id, b.id) AS dist FROM n a JOIN n b ON substr(a.id, 1, 4) = substr(b.id, 1, 4) AND a.id < b.id WHERE levenshtein(a.id, b.id) <= 6")
def edit_distance(spark, d):
    n = names(spark, d).withColumn("p", F.substring("id", 1, 4))
    x = n.withColumnRenamed("id", "a").join(n.withColumnRenamed("id", "b"), "p").where("a < b")
    return x.select("a", "b", F.levenshtein("a", "b", 6).cast("long").alias("dist")).where("dist >= 0")


@query("SCA_06", f"WITH n AS (SELECT id, {TRI.format('id')} AS g FROM {_N}) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS sim FROM n a JOIN n b ON substr(a.id, 1, 4) = substr(b.id, 1, 4) AND a.id < b.id")
def trigram(spark, d):
    n = names(spark, d).select(F.substring("id", 1, 4).alias("p"), "id", T.trigrams(F.col("id")).alias("g"))
    x = n.withColumnsRenamed({"id": "a", "g": "ga"}).join(n.withColumnsRenamed({"id": "b", "g": "gb"}), "p").where("a < b")
    return x.select("a", "b", F.round(T.set_similarity(F.col("ga"), F.col("gb")), 6).alias("sim"))


# SCA_04 to SCA_06 and their SQL compare names of one prefix; the queries below score every pair of the (bounded) list of names.
_PAIRS = f"WITH n AS (SELECT id, {TRI.format('id')} AS g FROM {_N}), p AS (SELECT a.id AS a, b.id AS b, a.g AS ga, b.g AS gb FROM n a JOIN n b ON a.id < b.id)"


def name_pairs(spark, d):
    n = names(spark, d)
    return n.withColumnRenamed("id", "a").crossJoin(n.withColumnRenamed("id", "b")).where("a < b")


@query("SCA_04_all", f"{_PAIRS} SELECT a, b, round(jaro_winkler_similarity(a, b), 4) AS jw FROM p WHERE jaro_winkler_similarity(a, b) >= 0.88")
def jaro_winkler_all(spark, d):
    x = name_pairs(spark, d).select("a", "b", C.jaro_winkler(F.col("a"), F.col("b")).alias("jw")).where("jw >= 0.88")
    return x.withColumn("jw", F.round("jw", 4))


@query("SCA_05_all", f"{_PAIRS} SELECT a, b, levenshtein(a, b) AS dist FROM p WHERE levenshtein(a, b) <= 6")
def edit_distance_all(spark, d):
    # Names whose lengths differ by more than 6 are further apart than that.
    x = name_pairs(spark, d).where("abs(length(a) - length(b)) <= 6")
    return x.select("a", "b", F.levenshtein("a", "b", 6).cast("long").alias("dist")).where("dist >= 0")


@query("SCA_06_all", f"{_PAIRS} SELECT a, b, round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) AS sim FROM p")
def trigram_all(spark, d):
    n = names(spark, d).select("id", T.trigrams(F.col("id")).alias("g"))
    x = n.withColumnsRenamed({"id": "a", "g": "ga"}).crossJoin(n.withColumnsRenamed({"id": "b", "g": "gb"})).where("a < b")
    return x.select("a", "b", F.round(T.set_similarity(F.col("ga"), F.col("gb")), 6).alias("sim"))


@query("SCA_07", "SELECT id, regexp_replace(regexp_extract(lower(source_url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '^www\\.', '') AS dom FROM financial_news_queue")
def domains(spark, d):
    return table(spark, d, "financial_news_queue").select("id", T.url_domain(F.col("source_url")).alias("dom"))


@query("SCA_08", "SELECT id, substr(sha256(CASE WHEN coalesce(source_url, '') <> '' THEN trim(source_url) ELSE raw_text END), 1, 32) AS h FROM financial_news_queue")
def hashes(spark, d):
    return table(spark, d, "financial_news_queue").select("id", T.source_hash(F.col("source_url"), F.col("raw_text")).alias("h"))


@query("SCA_09", "SELECT id, substr(sha256(raw_text), 1, 16) AS h FROM financial_news_queue")
def payload_hashes(spark, d):
    return table(spark, d, "financial_news_queue").select("id", F.substring(F.sha2("raw_text", 256), 1, 16).alias("h"))


_PAGE = "'<script type=\"x\">var a = 1;</style> b</script><style>p {}</style><p>' || raw_text || '</p>'"


@query("SCA_10", rf"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PAGE}, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM financial_news_queue")
def html(spark, d):
    page = F.concat(F.lit('<script type="x">var a = 1;</style> b</script><style>p {}</style><p>'), "raw_text", F.lit("</p>"))
    return table(spark, d, "financial_news_queue").select("id", T.strip_html(page).alias("t"))


_TAIL = "raw_text || CASE WHEN id % 3 = 0 THEN chr(10) || 'Disclosure: The author holds shares.' ELSE '' END"
for _p in T.TAIL_PATTERNS:
    _TAIL = f"regexp_replace({_TAIL}, '{_p}', '', 'g')"


@query("SCA_11", f"SELECT id, trim({_TAIL}, E' \\t\\r\\n') AS t FROM financial_news_queue")
def tails(spark, d):
    n = table(spark, d, "financial_news_queue")
    t = F.concat("raw_text", F.when(F.col("id") % 3 == 0, "\nDisclosure: The author holds shares.").otherwise(""))
    return n.select("id", F.trim(T.strip_tail(t), F.lit(" \t\r\n")).alias("t"))


@query("SCA_12", f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE floor(greatest({WORDS.format('text')} * 1.35, length(text) / 3.7) + 1)::INT END AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SCA_15", "SELECT chunk_id, '[' || concat_ws(' | ', metadata.form_type, 'CIK ' || metadata.cik, metadata.ticker, metadata.company_name, section_name) || ']' AS header FROM filing_chunks")
def headers(spark, d):
    m = F.col("metadata")
    return table(spark, d, "filing_chunks").select("chunk_id", T.metadata_header(m["form_type"], F.concat(F.lit("CIK "), m["cik"]), m["ticker"], m["company_name"], F.col("section_name")).alias("header"))


@query("SCA_20")
def clause_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.clauses(F.col("text"))).alias("i", "clause"))


@query("SCA_21")
def polarity(spark, d):
    return table(spark, d, "financial_news_queue").select("id", C.polarity(F.col("raw_text")).alias("polarity"))


@query("SCA_22", "SELECT triple_id, CASE WHEN rel_type IN ('SOLE_SOURCE_DEPENDENT_ON', 'ACQUIRED_BY', 'DEFAULTED_ON') OR upper(provenance) IN ('SEC_EXHIBIT_21', 'SEC_8K') THEN 'CRITICAL_TIER_1' WHEN contains(lower(coalesce(nature, '')), 'standard vendor') THEN 'COMMODITY_TIER_3' ELSE 'MATERIAL_TIER_2' END AS tier FROM annotated_triples")
def materiality(spark, d):
    return table(spark, d, "annotated_triples").select("triple_id", C.materiality(F.col("nature"), F.col("rel_type"), F.col("provenance")).alias("tier"))


@query("FLT_12")
def unnegated(spark, d):
    return table(spark, d, "financial_news_queue").where(C.has_unnegated(F.col("raw_text"), r"\bstrike\b")).select("id")


@query("SCA_25", "SELECT triple_id, '(a:' || source_type || ' {name: \"' || source_name || '\"})-[:' || rel_type || ' {confidence: ' || printf('%.2f', confidence) || '}]->(b:' || target_type || ' {name: \"' || target_name || '\"})' AS dsl FROM annotated_triples")
def rendered(spark, d):
    return table(spark, d, "annotated_triples").select("triple_id", F.format_string('(a:%s {name: "%s"})-[:%s {confidence: %.2f}]->(b:%s {name: "%s"})', "source_type", "source_name", "rel_type", "confidence", "target_type", "target_name").alias("dsl"))


@query("SCA_31", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(floor(o_totalprice / 10000) AS INT) AS onset, CAST(o_orderdate AS DATE) + CAST(ceil(o_totalprice / 7000) AS INT) AS recovery FROM orders")
def projected(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, F.floor(F.col("o_totalprice") / 10000).cast("int")).alias("onset"), F.date_add(day, F.ceil(F.col("o_totalprice") / 7000).cast("int")).alias("recovery"))


@query("SCA_32", "SELECT o_orderkey, l_linenumber AS line, coalesce(l_extendedprice, 0) AS impact FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40")
def flattened(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("impact"))).alias("impacts"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.inline_outer("impacts")).select("o_orderkey", "line", F.coalesce("impact", F.lit(0.0)).alias("impact"))


@query("SCA_35", "SELECT DISTINCT ticker, CASE WHEN upper(listing_exchange) LIKE '%NASDAQ%' THEN 'NASDAQ' WHEN upper(listing_exchange) LIKE '%AMEX%' OR upper(listing_exchange) LIKE '%AMERICAN%' THEN 'AMEX' WHEN upper(listing_exchange) LIKE '%NYSE%' OR upper(listing_exchange) LIKE '%NEW YORK%' THEN 'NYSE' ELSE 'UNKNOWN' END AS x FROM sp500_constituents")
def exchange_names(spark, d):
    return table(spark, d, "sp500_constituents").select("ticker", T.exchange_name(F.col("listing_exchange")).alias("x")).distinct()


@query("SCA_36", "SELECT DISTINCT ticker, CASE WHEN length(trim(cik)) < 10 THEN lpad(trim(cik), 10, '0') ELSE trim(cik) END AS cik FROM sp500_constituents")
def ciks(spark, d):
    return table(spark, d, "sp500_constituents").select("ticker", T.padded_cik(F.col("cik")).alias("cik")).distinct()


@query("SCA_39", "SELECT record_no, regexp_extract_all(target_completion, '([0-9.]+) percent', 1) AS shares FROM sft_records WHERE target_completion IS NOT NULL")
def parsed(spark, d):
    return table(spark, d, "sft_records").where("target_completion is not null").select("record_no", F.regexp_extract_all("target_completion", F.lit("([0-9.]+) percent"), 1).alias("shares"))


@query("SCA_45", "SELECT event_id, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS t FROM events")
def assembled(spark, d):
    return table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("t"))


@query("SCA_46", "SELECT id, try_strptime(published_at, '%Y-%m-%d') AS ts FROM financial_news_queue WHERE length(published_at) = 10")
def timestamps(spark, d):
    return table(spark, d, "financial_news_queue").where("length(published_at) = 10").select("id", F.try_to_timestamp("published_at", F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("ts"))


@query("TOP_06")
def salient(spark, d):
    return C.salient_paragraphs(table(spark, d, "filing_chunks").select("chunk_id", "text").distinct(), "chunk_id", "text", ("shortage", "strike", "fire"), 600)
