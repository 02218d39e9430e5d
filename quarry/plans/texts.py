"""Queries over texts of filings, statements of the graph language and answers of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import table
from quarry.functions import clauses as C, filings as L, statements as S
from quarry.operators import graph as G
from quarry.plans.registry import query

# Written out for the SQL: place of each item, tier and rank.
_ITEMS = """(VALUES ('1.05', 1, 0), ('1.04', 1, 1), ('1.03', 1, 2), ('1.02', 1, 3), ('2.05', 1, 4), ('2.06', 1, 5), ('2.04', 1, 6), ('1.01', 2, 0), ('8.01', 2, 1), ('2.01', 3, 0), ('2.02', 3, 1), ('2.03', 3, 2), ('7.01', 3, 3),
('3.01', 4, 0), ('3.02', 4, 1), ('3.03', 4, 2), ('4.01', 4, 3), ('4.02', 4, 4), ('5.01', 4, 5), ('5.02', 4, 6), ('5.03', 4, 7), ('5.04', 4, 8), ('5.05', 4, 9), ('5.06', 4, 10), ('5.07', 4, 11), ('5.08', 4, 12),
('6.01', 4, 13), ('6.02', 4, 14), ('6.03', 4, 15), ('6.04', 4, 16), ('6.05', 4, 17), ('9.01', 4, 18))"""
_PICK = "(1 + {x} % 9) || '.0' || ({x} % 7)"
_P1, _P2 = _PICK.replace("{x}", "event_id"), _PICK.replace("{x}", "(event_id // 63 + 5 * event_id)")


def _pick(x):
    return F.concat((1 + x % 9).cast("string"), F.lit(".0"), (x % 7).cast("string"))


def _with_items(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select("event_id", F.array(F.concat(F.lit("Item "), _pick(k)), _pick(F.floor(k / 63) + 5 * k), F.lit("no item")).alias("items"))


@query("WIN_08", f"""WITH i AS (SELECT * FROM {_ITEMS} t(code, tier, rank)), x AS (SELECT event_id, unnest([{_P1}, {_P2}]) AS code FROM events), b AS (SELECT event_id, min_by(code, (tier, rank)) AS code FROM x JOIN i USING (code) GROUP BY 1)
SELECT event_id, 'Item ' || coalesce(b.code, '8.01') AS item FROM events LEFT JOIN b USING (event_id)""")
def primary_items(spark, d):
    return _with_items(spark, d).select("event_id", L.primary_item(F.col("items")).alias("item"))


@query("SCA_17", f"SELECT event_id, coalesce(tier, 2) AS tier FROM (SELECT event_id, {_P1} AS code FROM events) LEFT JOIN {_ITEMS} t(code, tier, rank) USING (code)")
def item_tiers(spark, d):
    return _with_items(spark, d).select("event_id", L.item_tier(F.col("items")[0]).alias("tier"))


_HEAD = "Check the appropriate box below.\n\nCommission File Number 1"
_TAIL = "\nForward-looking statements involve risks and uncertainties.\n\nItem 9.01 Exhibits\n\nSIGNATURES\n\nPursuant to the requirements of the Securities Exchange Act of 1934, signed."


def _filed(spark, d):
    return table(spark, d, "filing_chunks").dropDuplicates(["chunk_id"]).select("chunk_id", F.concat(F.lit(_HEAD + "\n\n"), "text", F.lit(_TAIL)).alias("t"), "section_name")


@query("SCA_16", r"""WITH x AS (SELECT chunk_id, min(text) AS text FROM filing_chunks GROUP BY 1), b AS (SELECT chunk_id, list_filter(list_transform(string_split_regex(text, '\r?\n\s*\r?\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM x)
SELECT chunk_id, array_to_string(ps, chr(10) || chr(10)) AS t, 6 AS stripped FROM b""")
def sanitised(spark, d):
    """Chunks with a cover page before and safe harbour, exhibits and signature after them: the text alone comes back."""
    x = _filed(spark, d).select("chunk_id", L.sanitized(F.col("t")).alias("s"))
    return x.select("chunk_id", F.col("s.text").alias("t"), F.col("s.stripped").alias("stripped"))


_CLASS = r"""CASE WHEN regexp_matches(t, '(?i)\b(?:fire|fires|explosion|explosions|blast)\b') THEN 'FACILITY_FIRE_OR_EXPLOSION'
WHEN regexp_matches(t, '(?i)\b(?:flood|flooding|earthquake|hurricane|typhoon|tornado|force\s+majeure)\b') THEN 'NATURAL_DISASTER_FORCE_MAJEURE'
WHEN regexp_matches(t, '(?i)\b(?:power\s+(?:outage|failure|loss|grid|shortage)|grid\s+failure|blackout|utility\s+outage)\b') THEN 'UTILITY_POWER_GRID_FAILURE'
WHEN regexp_matches(t, '(?i)\b(?:ransomware|cyberattack|cyber\s+incident|cybersecurity\s+incident|network\s+intrusion|unauthorized\s+access)\b') THEN 'RANSOMWARE_CYBER_INFRASTRUCTURE_HALT'
WHEN regexp_matches(t, '(?i)\b(?:equipment\s+breakdown|machinery\s+failure|fab(?:rication)?\s+(?:halt|shutdown)|emergency\s+(?:halt|shutdown)|operational\s+halt|production\s+(?:halt|stoppage|curtailment)|plant\s+shutdown|facility\s+(?:shutdown|disruption)|cleanroom\s+(?:halt|contamination|outage))\b') THEN 'EQUIPMENT_BREAKDOWN_FAB_HALT'
WHEN regexp_matches(t, '(?i)\b(?:supply\s+(?:agreement|contract)\s+(?:terminated|termination)|terminat(?:ed|ion)\s+of\s+(?:the\s+)?(?:supply|manufacturing|foundry)\s+(?:agreement|contract)|contract\s+severance)\b') THEN 'PRIMARY_SUPPLY_CONTRACT_TERMINATED'
WHEN regexp_matches(t, '(?i)\b(?:port\s+(?:closure|congestion|blockage|strike|halt)|canal\s+blockage|maritime\s+(?:disruption|blockade|chokepoint)|shipping\s+suspension)\b') THEN 'MARITIME_CANAL_PORT_LOGISTICS_CHOKEPOINT'
WHEN regexp_matches(t, '(?i)\b(?:product\s+recall|safety\s+recall|fda\s+(?:hold|warning|suspension)|clinical\s+hold|regulatory\s+halt)\b') THEN 'REGULATORY_SAFETY_RECALL_OR_FDA_HOLD'
WHEN regexp_matches(t, '(?i)\b(?:labor\s+strike|union\s+strike|work\s+stoppage|walkout)\b') THEN 'LABOR_UNION_STRIKE_WALKOUT'
WHEN regexp_matches(t, '(?i)\b(?:plant\s+closure|facility\s+closure|cease\s+operations\s+at\s+(?:its|the)\s+(?:plant|facility|fab))\b') THEN 'PERMANENT_FACILITY_CLOSURE_EXIT' END"""


@query("SCA_18", f"SELECT id, {_CLASS} AS category FROM (SELECT id, raw_text AS t FROM financial_news_queue)")
def disruption_classes(spark, d):
    return table(spark, d, "financial_news_queue").select("id", L.disruption_class(F.col("raw_text")).alias("category"))


@query("SCA_19", f"""WITH i AS (SELECT * FROM {_ITEMS} t(code, tier, rank)), x AS (SELECT id, coalesce(title, '') AS t, (1 + id % 9) || '.0' || (id % 7) AS code, CASE WHEN id % 4 = 0 THEN 12.5 END AS mag FROM financial_news_queue),
y AS (SELECT id, t, mag, coalesce(i.code, '8.01') AS code, coalesce(tier, 2) AS tier, {_CLASS} AS lex, regexp_matches(t, '(?i)\\b(?:supplier|supply|vendor|manufacturing|foundry|wafer|procurement|component|fab)\\b') OR mag IS NOT NULL AS supply FROM x LEFT JOIN i USING (code)),
z AS (SELECT *, CASE WHEN lex IS NOT NULL THEN 'SANITIZED_LEXICAL_DISRUPTION_MATCH' WHEN code = '1.02' AND supply THEN 'TIER_1_SUPPLY_CONTRACT_TERMINATION' WHEN code = '1.02' THEN 'TIER_1_ITEM_1_02_NON_SUPPLY_NEGATIVE_CONTROL'
WHEN tier = 1 THEN 'TIER_1_STATUTORY_ANCHOR_Item_' || replace(code, '.', '_') WHEN mag IS NOT NULL THEN 'EXPLICIT_METADATA_SHOCK_OVERRIDE' ELSE 'NON_DISRUPTIVE_NEGATIVE_CONTROL' END AS reason FROM y)
SELECT id, 'Item ' || code AS primary_item, tier, reason NOT LIKE '%NEGATIVE_CONTROL' AS disruption, reason, CASE WHEN reason LIKE '%NEGATIVE_CONTROL' THEN 0 ELSE coalesce(mag, 100) END::DOUBLE AS magnitude_pct, CASE WHEN reason LIKE '%NEGATIVE_CONTROL' THEN 0 ELSE 60 END::DOUBLE AS duration_days,
coalesce(lex, CASE WHEN reason = 'TIER_1_SUPPLY_CONTRACT_TERMINATION' THEN 'PRIMARY_SUPPLY_CONTRACT_TERMINATED' WHEN reason LIKE 'TIER_1_STAT%' THEN CASE code WHEN '1.05' THEN 'RANSOMWARE_CYBER_INFRASTRUCTURE_HALT' WHEN '1.03' THEN 'COMMERCIAL_INSOLVENCY_BANKRUPTCY'
WHEN '1.04' THEN 'EQUIPMENT_BREAKDOWN_FAB_HALT' WHEN '2.04' THEN 'DEBT_COVENANT_DEFAULT_CREDIT_FREEZE' WHEN '2.05' THEN 'PERMANENT_FACILITY_CLOSURE_EXIT' WHEN '2.06' THEN 'PERMANENT_FACILITY_CLOSURE_EXIT' END END, 'OTHER_UNCLASSIFIED_MATERIAL_HALT') AS category FROM z""")
def assessments(spark, d):
    k = F.col("id")
    x = table(spark, d, "financial_news_queue").select("id", "title", F.array(_pick(k)).alias("items"), F.when(k % 4 == 0, 12.5).alias("mag"), F.lit(None).cast("double").alias("dur"), F.lit("").alias("head"))
    x = L.assessed(x, "items", "head", "title", "mag", "dur")
    return x.select("id", "primary_item", "tier", "disruption", "reason", "magnitude_pct", "duration_days", "category")


def _headed(spark, d):
    """Chunks as a filing of two sections with what stands before them."""
    c = table(spark, d, "filing_chunks").dropDuplicates(["chunk_id"])
    t = F.concat(F.lit("Cover page.\n"), F.lit("ITEM 1. BUSINESS\n"), "text", F.lit("\nItem 1A - Risk Factors\n"), "text")
    return c.select("chunk_id", t.alias("t"), F.concat_ws(" | ", "metadata.form_type", F.concat(F.lit("CIK "), "metadata.cik")).alias("h"))


@query("SCA_13", """SELECT DISTINCT chunk_id, unnest(['Item 1 - Business', 'Item 1A - Risk Factors']) AS section, unnest([11, 29 + length(text)]) AS start FROM filing_chunks""")
def sections(spark, d):
    x = _headed(spark, d)
    found = S.per_value(lambda t: [{"section": n, "start": a} for n, a, _ in L.sections_of(t)], "array<struct<section:string,start:long>>")(F.col("t"))
    return x.select("chunk_id", F.inline(found))


@query("SCA_14")
def filing_segments(spark, d):
    return L.segmented(_headed(spark, d), "chunk_id", "t", "h")


@query("WIN_10")
def packed_chunks(spark, d):
    """Paragraphs of long chunks packed under 400 tokens with an overlap of 120."""
    return L.segmented(_headed(spark, d), "chunk_id", "t", "h", limit=400)


@query("UDF_05", "SELECT DISTINCT chunk_id, 'Cover' AS section, 0 AS start FROM filing_chunks UNION ALL SELECT DISTINCT chunk_id, 'Risks', 29 + length(text) FROM filing_chunks")
def own_sections(spark, d):
    """Sections by patterns of the caller."""
    own = (("Cover", r"Cover page"), ("Risks", r"Item 1A - Risk"))
    found = S.per_value(lambda t: [{"section": n, "start": a} for n, a, _ in L.sections_of(t, own)], "array<struct<section:string,start:long>>")(F.col("t"))
    return _headed(spark, d).select("chunk_id", F.inline(found))


def _evidence(spark, d):
    """Triples with a sentence about them, every third hedged, some of them only beside the entities."""
    t, k = table(spark, d, "annotated_triples"), F.col("triple_id")
    hedge = F.when(k % 3 == 0, " may consider supplying ").otherwise(" supplies ")
    t = t.withColumns({c: F.replace(c, F.lit("."), F.lit("")) for c in ("source_name", "target_name")})  # a period may end a clause
    text = F.concat("source_name", hedge, F.lit("parts; the board met in May; "), F.when(k % 2 == 0, F.lit("others are exploring a sale")).otherwise(F.lit("others wait")))
    return t.withColumn("prompt", text)


@query("FLT_11", "SELECT triple_id, triple_id % 3 = 0 AS hedged FROM annotated_triples")
def hedged(spark, d):
    x = _evidence(spark, d)
    return x.select("triple_id", C.triple_hedged(F.col("prompt"), F.array("source_name", "target_name"), F.col("rel_type")).alias("hedged"))


# Written out for the SQL: canonical relations.
_CANON = "('SUBSIDIARY_OF', 'PARENT_OF', 'SUPPLIES_TO', 'CUSTOMER_OF', 'SOLE_SOURCE_DEPENDENT_ON', 'COMPETES_WITH', 'PARTNERED_WITH', 'CEO_OF', 'EXECUTIVE_OF', 'DIRECTOR_OF', 'INSIDER_OF', 'EXPOSED_TO_RISK', 'LICENSES_FROM', 'LICENSES_TO', 'ACQUIRED_BY', 'DEFAULTED_ON', 'SPUN_OFF_FROM', 'OWNS', 'INVESTS_IN', 'PRODUCES', 'IMPACTS', 'REPORTS', 'FILED', 'CO_INVESTS_WITH', 'PEER_OF', 'COLLABORATES_WITH')"
_GATED = f"""SELECT triple_id, CASE WHEN triple_id % 3 = 0 OR rel = 'TRADES_WITH' THEN NULL WHEN rel = 'TERMINATED' THEN CASE triple_id % 4 WHEN 0 THEN 'LICENSES_FROM' WHEN 1 THEN 'PARTNERED_WITH' WHEN 2 THEN 'CUSTOMER_OF' ELSE 'SUPPLIES_TO' END WHEN rel IN {_CANON} THEN rel END AS relation
FROM (SELECT triple_id, CASE WHEN triple_id % 10 = 0 THEN 'TRADES_WITH' WHEN triple_id % 5 = 1 THEN 'TERMINATED' ELSE rel_type END AS rel FROM annotated_triples)"""


def _gate(spark, d):
    x, k = _evidence(spark, d), F.col("triple_id")
    rel = F.when(k % 10 == 0, "TRADES_WITH").when(k % 5 == 1, " terminated ").otherwise(F.col("rel_type"))
    words = F.array(F.lit("royalties"), F.lit("a joint venture"), F.lit("a customer"), F.lit("a supplier"))
    h = C.triple_hedged(F.col("prompt"), F.array("source_name", "target_name"), rel)
    return x.withColumn("relation", S.gated_relation(rel, h, F.get(words, (k % 4).cast("int")), tuple(G.ONTOLOGY)))


@query("FLT_13", f"SELECT triple_id, relation FROM ({_GATED}) WHERE relation IS NOT NULL")
def gate(spark, d):
    return _gate(spark, d).where("relation is not null").select("triple_id", "relation")


@query("FLT_14", f"""WITH g AS ({_GATED}) SELECT triple_id, relation, CASE WHEN triple_id % 3 = 0 THEN NULL WHEN triple_id % 10 <> 0 AND triple_id % 5 = 1 THEN 'TERMINATED' ELSE upper(status) END AS status,
CASE lpad(trim(source_cik), 10, '0') WHEN '0001001811' THEN '0001001082' ELSE lpad(trim(source_cik), 10, '0') END AS cik FROM g JOIN annotated_triples USING (triple_id) WHERE relation IS NOT NULL""")
def payload_gate(spark, d):
    """Gated edges with the status a repair sets, and the parent's number for a subsidiary's."""
    x = _gate(spark, d).where("relation is not null")
    status = F.when((F.col("triple_id") % 10 != 0) & (F.col("triple_id") % 5 == 1), "TERMINATED").otherwise(F.upper("status"))
    cik = F.trim("source_cik")
    parents = F.create_map(*[F.lit(v) for kv in PARENTS.items() for v in kv])
    padded = F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)
    return x.select("triple_id", "relation", status.alias("status"), F.coalesce(parents[padded], padded).alias("cik"))


# Subsidiaries known without a registry, and their parents.
PARENTS = {"0001001811": "0001001082", "0001061219": "0001045810", "0001108524": "0001018724", "0001326801": "0001326801"}


@query("SCA_23", r"""SELECT id, CASE WHEN regexp_matches(raw_text, '(?i)\b(licens\w*|royalt\w*|patent\w*|intellectual\s+property)\b') THEN 'LICENSES_FROM' WHEN regexp_matches(raw_text, '(?i)\b(joint\s+venture|partnership|partner\w*|alliance|collaborat\w*)\b') THEN 'PARTNERED_WITH'
WHEN regexp_matches(raw_text, '(?i)\b(customer\w*|purchas\w*|procur\w*|offtake)\b') AND NOT regexp_matches(raw_text, '(?i)\b(suppli\w*|vendor\w*|foundry|manufactur\w*)\b') THEN 'CUSTOMER_OF' ELSE 'SUPPLIES_TO' END AS relation FROM financial_news_queue""")
def terminated(spark, d):
    return table(spark, d, "financial_news_queue").select("id", S.terminated_relation(F.col("raw_text")).alias("relation"))


@query("SCA_24", "SELECT event_id, 'CIK ' || CASE event_id % 4 WHEN 0 THEN '0001001082' WHEN 1 THEN '0001045810' WHEN 2 THEN '0001018724 of 0001018724' ELSE '0001326801' END AS t FROM events")
def cik_rollup(spark, d):
    k = F.col("event_id") % 4
    t = F.concat(F.lit("CIK "), F.when(k == 0, "0001001811").when(k == 1, "0001061219").when(k == 2, "0001108524 of 0001108524").otherwise("0001326801"))
    return table(spark, d, "events").select("event_id", S.rolled_up(t, PARENTS).alias("t"))


@query("SCA_26", "SELECT triple_id, trim(replace(replace(source_name, '\"', ''), '''', '')) AS source, upper(rel_type) AS relation, 'x' AS target FROM annotated_triples")
def triple_parse(spark, d):
    name = F.trim(F.regexp_replace("source_name", "[\"']", ""))
    s = F.concat(F.lit('Edge (see (a) below): (a:Company {name: "'), name, F.lit('"}) - [:'), F.lower("rel_type"), F.lit(' {confidence: 0.5, note: "a ] ) b"}]-> (b {id: "x"}) and (c)-[KNOWS]->(d)'))
    x = table(spark, d, "annotated_triples").select("triple_id", F.inline(S.parsed_triples(s)))
    return x.select("triple_id", "source", "relation", "target")


def _statements(spark, d):
    """A statement for every event, of six kinds."""
    k = F.col("event_id") % 6
    s = (
        F.when(k == 0, "MATCH (a:Company)-[:SUPPLIES_TO]->(b) RETURN a.name LIMIT 5").when(k == 1, "MATCH (a)-[s:OWNS]->(b) WHERE a.ticker = 'SET DELETE' RETURN b.ticker").when(k == 2, "MATCH (a) SET a.name = 'x' RETURN a")
        .when(k == 3, "CALL dbms.components() YIELD name RETURN name").when(k == 4, "EXPLAIN MATCH (a) RETURN a").otherwise("MATCH (a {mood: 'good'})-[r:OWNS {confidence: 1}]->(b) RETURN a.age // CREATE")
    )
    return table(spark, d, "events").select("event_id", s.alias("s"))


@query("FLT_15", "SELECT event_id, ['OK', 'OK', 'MUTATING_KEYWORD', 'ADMIN_PROCEDURE', 'INVALID_START', 'UNKNOWN_PROPERTY'][1 + event_id % 6] AS verdict FROM events")
def read_only(spark, d):
    return _statements(spark, d).select("event_id", S.guard(F.col("s")).alias("verdict"))


_ACTIVE = "coalesce({v}.status, ''ACTIVE_CURRENT'') = ''ACTIVE_CURRENT'' AND ({v}.valid_from IS NULL OR {v}.valid_from <= ''2024-01-31'') AND ({v}.valid_to IS NULL OR {v}.valid_to >= ''2024-01-31'')"
_R, _S = _ACTIVE.replace("{v}", "r"), _ACTIVE.replace("{v}", "s")


@query("SCA_41", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'MATCH (a:Company)-[r:SUPPLIES_TO]->(b) WHERE {_R} RETURN a.name LIMIT 5' WHEN 1 THEN 'MATCH (a)-[s:OWNS]->(b) WHERE ({_S}) AND a.ticker = ''SET DELETE'' RETURN b.ticker'
WHEN 2 THEN 'MATCH (a) SET a.name = ''x'' RETURN a' WHEN 3 THEN 'CALL dbms.components() YIELD name RETURN name' WHEN 4 THEN 'EXPLAIN MATCH (a) RETURN a' ELSE 'MATCH (a {{mood: ''good''}})-[r:OWNS {{confidence: 1}}]->(b) WHERE {_R} RETURN a.age // CREATE' END AS s FROM events""")
def temporal_rewrite(spark, d):
    return _statements(spark, d).select("event_id", S.as_of(F.col("s"), "2024-01-31").alias("s"))


@query("SCA_40", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'so ' || event_id END AS thought, CASE event_id % 4 WHEN 0 THEN 'it is' WHEN 1 THEN '(unclosed reasoning)' WHEN 2 THEN 'plain' ELSE '<think>x</think> kept' END AS answer FROM events")
def demux(spark, d):
    k = F.col("event_id")
    so = F.concat(F.lit("<think> so "), k.cast("string"))
    t = F.when(k % 4 == 0, F.concat(so, F.lit(" </think>\nit is "))).when(k % 4 == 1, so).when(k % 4 == 2, " plain ").otherwise("<think>x</think> kept")
    x = table(spark, d, "events").select("event_id", S.demuxed(t, k % 4 != 3).alias("x"))
    return x.select("event_id", "x.thought", "x.answer")


@query("SCA_44", "SELECT id, coalesce(source_url, '') <> '' AND (coalesce(contains(title, 'strike'), false) OR id % 5 = 0) AS cited FROM financial_news_queue")
def citations(spark, d):
    n, k = table(spark, d, "financial_news_queue"), F.col("id")
    answer = F.concat(F.lit("As told: "), F.when(F.col("title").contains("strike"), F.col("title")).otherwise("nothing"))
    return n.select("id", F.coalesce(S.cited(answer, F.when(F.col("title").contains("strike"), F.col("title")), F.col("source_url"), F.when(k % 5 == 0, 3).otherwise(9)), F.lit(False)).alias("cited"))


@query("SCA_33", "SELECT event_id, list_filter([CASE WHEN event_id % 2 = 1 THEN 'contraction' END, CASE WHEN event_id % 3 = 0 THEN 'downtime' END], lambda v: v IS NOT NULL) AS missing FROM events")
def verbatim(spark, d):
    k = F.col("event_id")
    pct, days = k.cast("double") + 0.25, k.cast("double") + 1000000.5
    prose = F.concat(F.lit("Output falls "), F.when(k % 2 == 0, F.concat(F.format_string("%.2f", pct), F.lit("%"))).otherwise("a lot"), F.lit(" for "), F.when(k % 3 != 0, F.format_string("%.1f", days)).otherwise("some"), F.lit(" days."))
    return table(spark, d, "events").select("event_id", S.uncited_figures(prose, pct, days).alias("missing"))
