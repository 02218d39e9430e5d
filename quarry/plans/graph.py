"""Graph queries over edges derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarry.core.components import connected_components
from quarry.core.runtime import scratch, table
from quarry.functions import text as T
from quarry.operators import graph as G, predicates as P, resolution as R
from quarry.plans.registry import query

AS_OF = "2023-06-30"
_E = f"""e AS (SELECT source_name AS source, target_name AS target, rel_type, triple_id FROM annotated_triples WHERE status = 'ACTIVE_CURRENT' AND (substr(valid_from, 1, 10) IS NULL OR substr(valid_from, 1, 10) <= '{AS_OF}') AND (substr(valid_to, 1, 10) IS NULL OR substr(valid_to, 1, 10) >= '{AS_OF}'))"""
_ROOT = "Juntodale Industrial Controls Group Ltd."


def current(spark, d):
    e = P.edges_at(table(spark, d, "annotated_triples"), AS_OF, "ACTIVE_CURRENT")
    return e.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", "triple_id")


def root(spark):
    return spark.createDataFrame([(_ROOT,)], "node string")


_BFS = f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 2), n AS (SELECT node, min(d) AS d FROM w GROUP BY 1)"""


@query("GRF_02", _BFS + " SELECT e.triple_id, n.d + 1 AS hop FROM e JOIN n ON n.node = e.source")
def bfs(spark, d):
    return G.k_hop(current(spark, d), root(spark), 3).select("triple_id", "hop")


@query("GRF_03", f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 2), u AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.source, u.d + 1 FROM u JOIN e ON e.target = u.node WHERE u.d < 2),
wn AS (SELECT node, min(d) AS d FROM w GROUP BY 1), un AS (SELECT node, min(d) AS d FROM u GROUP BY 1),
a AS (SELECT e.target AS node, n.d + 1 AS hop, 'DOWNSTREAM' AS role FROM e JOIN wn n ON n.node = e.source WHERE n.d < 2 UNION ALL SELECT e.source, n.d + 1, 'UPSTREAM' FROM e JOIN un n ON n.node = e.target WHERE n.d < 2 UNION ALL SELECT '{_ROOT}', 0, 'ROOT')
SELECT node, min(hop) AS hop, CASE WHEN bool_or(role = 'ROOT') THEN 'ROOT' WHEN count(DISTINCT role) > 1 THEN 'BOTH' ELSE min(role) END AS role FROM a GROUP BY node""")
def ego(spark, d):
    return G.ego(current(spark, d), root(spark), 2)[0]


@query("GRF_05", f"WITH {_E} SELECT triple_id FROM e WHERE source IN ('{_ROOT}', 'Oblonex') OR target IN ('{_ROOT}', 'Oblonex') ORDER BY triple_id LIMIT 50")
def neighbours(spark, d):
    return current(spark, d).where(F.col("source").isin(_ROOT, "Oblonex") | F.col("target").isin(_ROOT, "Oblonex")).select("triple_id").orderBy("triple_id").limit(50)


@query("GRF_06", f"WITH {_E}, b AS (SELECT source AS node, target AS other FROM e UNION SELECT target, source FROM e) SELECT node, count(DISTINCT other) AS neighbours, list(DISTINCT other ORDER BY other) AS others FROM b GROUP BY node")
def collected(spark, d):
    e = current(spark, d)
    b = e.select(F.col("source").alias("node"), F.col("target").alias("other")).union(e.select("target", "source")).distinct()
    return b.groupBy("node").agg(F.count("*").alias("neighbours"), F.array_sort(F.collect_list("other")).alias("others"))


_DIST = f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 12) SELECT node, min(d) AS dist FROM w GROUP BY 1"""


@query("GRF_07", _DIST)
def distances(spark, d):
    return G.hop_distances(current(spark, d), root(spark), 12)


@query("GRF_15", f"""WITH RECURSIVE {_E}, x AS (SELECT source AS u, target AS v FROM e WHERE source <> target), b AS (SELECT u, v FROM x UNION SELECT v, u FROM x),
w AS (SELECT u AS node, u AS c FROM b UNION SELECT b.v, w.c FROM w JOIN b ON b.u = w.node) SELECT node, min(c) AS component FROM w GROUP BY 1""")
def components(spark, d):
    return connected_components(current(spark, d), "source", "target")


@query("GRF_16", f"""WITH t AS (SELECT least(source_name, target_name) AS a, greatest(source_name, target_name) AS b, min(strftime(extracted_at, '%Y-%m-%d')) AS day FROM annotated_triples WHERE status <> 'ACTIVE_CURRENT' GROUP BY 1, 2)
SELECT triple_id, CASE WHEN day IS NOT NULL AND (valid_to IS NULL OR valid_to > day) THEN day ELSE valid_to END AS valid_to FROM annotated_triples LEFT JOIN t ON a = least(source_name, target_name) AND b = greatest(source_name, target_name)""")
def closed(spark, d):
    e = table(spark, d, "annotated_triples").select("triple_id", "status", "valid_to", F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.date_format("extracted_at", "yyyy-MM-dd").alias("day"))
    return G.close_states(e.drop("day"), e.where("status <> 'ACTIVE_CURRENT'")).select("triple_id", "valid_to")


@query("GRF_17", "WITH d AS (SELECT node FROM (SELECT source_name AS node FROM annotated_triples UNION ALL SELECT target_name FROM annotated_triples) GROUP BY 1 HAVING count(*) >= 25) SELECT triple_id FROM annotated_triples WHERE source_name NOT IN (FROM d) AND target_name NOT IN (FROM d)")
def quarantined(spark, d):
    e = table(spark, d, "annotated_triples").select("triple_id", F.col("source_name").alias("source"), F.col("target_name").alias("target"))
    return G.quarantine(e)[0].select("triple_id")


# Fixed values, written out for the SQL: relation, domain, range, symmetric.
_ONT = """
    ('SUBSIDIARY_OF', ['COMPANY', 'SUBSIDIARY'], ['COMPANY'], false),
    ('PARENT_OF', ['COMPANY'], ['COMPANY', 'SUBSIDIARY'], false),
    ('SUPPLIES_TO', ['COMPANY', 'SUBSIDIARY', 'SUPPLIER'], ['COMPANY', 'CUSTOMER'], false),
    ('CUSTOMER_OF', ['COMPANY', 'CUSTOMER'], ['COMPANY', 'SUPPLIER'], false),
    ('SOLE_SOURCE_DEPENDENT_ON', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY', 'SUPPLIER'], false),
    ('COMPETES_WITH', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], true),
    ('PARTNERED_WITH', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], true),
    ('CEO_OF', ['EXECUTIVE', 'PERSON'], ['COMPANY', 'SUBSIDIARY'], false),
    ('EXECUTIVE_OF', ['EXECUTIVE', 'PERSON'], ['COMPANY', 'SUBSIDIARY'], false),
    ('DIRECTOR_OF', ['EXECUTIVE', 'PERSON'], ['COMPANY', 'SUBSIDIARY'], false),
    ('INSIDER_OF', ['EXECUTIVE', 'PERSON'], ['COMPANY', 'SUBSIDIARY'], false),
    ('EXPOSED_TO_RISK', ['COMPANY', 'SUBSIDIARY'], ['COMMODITY', 'GEOPOLITICALRISK', 'MARKETEVENT', 'METRIC', 'REGULATORYBODY', 'RISK'], false),
    ('LICENSES_FROM', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], false),
    ('LICENSES_TO', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], false),
    ('ACQUIRED_BY', ['COMPANY', 'SUBSIDIARY'], ['COMPANY'], false),
    ('DEFAULTED_ON', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'FINANCIALINSTITUTION'], false),
    ('SPUN_OFF_FROM', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], false),
    ('OWNS', ['COMPANY', 'FINANCIALINSTITUTION', 'PERSON', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], false),
    ('INVESTS_IN', ['COMPANY', 'FINANCIALINSTITUTION', 'PERSON', 'SUBSIDIARY'], ['COMPANY', 'INDUSTRY', 'PRODUCT', 'SECTOR', 'SUBSIDIARY', 'TECHNOLOGY'], false),
    ('PRODUCES', ['COMPANY', 'SUBSIDIARY'], ['COMMODITY', 'PRODUCT', 'TECHNOLOGY'], false),
    ('IMPACTS', ['COMPANY', 'GEOPOLITICALRISK', 'MARKETEVENT', 'METRIC', 'PRODUCT', 'REGULATORYBODY', 'RISK', 'SECTOR'], ['COMPANY', 'METRIC', 'PRODUCT', 'SECTOR', 'SUBSIDIARY'], false),
    ('REPORTS', ['COMPANY', 'SUBSIDIARY'], ['FILING', 'FORM', 'METRIC', 'RISK'], false),
    ('FILED', ['COMPANY', 'SUBSIDIARY'], ['DOCUMENT', 'FILING', 'FORM'], false),
    ('CO_INVESTS_WITH', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], true),
    ('PEER_OF', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], true),
    ('COLLABORATES_WITH', ['COMPANY', 'SUBSIDIARY'], ['COMPANY', 'SUBSIDIARY'], true)
"""


@query("GRF_18", f"""WITH o AS (SELECT * FROM (VALUES {_ONT}) t(relation, dom, rng, sym)), a AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v[0]}', {str(v[1]).lower()})" for k, v in G.ALIASES.items())}) t(raw, rel, swap)),
x AS (SELECT triple_id, coalesce(rel, rel_type) AS relation, CASE WHEN swap THEN target_name ELSE source_name END AS s, CASE WHEN swap THEN source_name ELSE target_name END AS t, upper(CASE WHEN swap THEN target_type ELSE source_type END) AS sl, upper(CASE WHEN swap THEN source_type ELSE target_type END) AS tl FROM annotated_triples LEFT JOIN a ON raw = rel_type),
y AS (SELECT x.*, sym, list_contains(dom, sl) AND list_contains(rng, tl) AS ok, list_contains(dom, tl) AND list_contains(rng, sl) AS turn FROM x JOIN o USING (relation)), z AS (SELECT triple_id, relation, sym, CASE WHEN ok THEN s ELSE t END AS s, CASE WHEN ok THEN t ELSE s END AS t FROM y WHERE ok OR turn)
SELECT triple_id, relation, CASE WHEN sym AND s > t THEN t ELSE s END AS source, CASE WHEN sym AND s > t THEN s ELSE t END AS target FROM z""")
def ontology(spark, d):
    e = table(spark, d, "annotated_triples").withColumnsRenamed({"source_name": "source", "target_name": "target"})
    return G.oriented(spark, e).select("triple_id", "relation", "source", "target")


@query("GRF_19", "SELECT triple_id, least(source_name, target_name) AS a, greatest(source_name, target_name) AS b FROM annotated_triples WHERE rel_type IN ('COMPETES_WITH', 'PARTNERED_WITH')")
def ordered(spark, d):
    e = table(spark, d, "annotated_triples").where(F.col("rel_type").isin("COMPETES_WITH", "PARTNERED_WITH"))
    return e.select("triple_id", F.least("source_name", "target_name").alias("a"), F.greatest("source_name", "target_name").alias("b"))


_NODE = "SELECT DISTINCT company_name AS id FROM sp500_constituents"
_KEY = "coalesce(nullif(array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(trim(id)), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\S+'), lambda w: w NOT IN (" + ", ".join(f"'{s}'" for s in T.ENTITY_SUFFIXES) + ")), ' '), ''), regexp_replace(lower(trim(id)), '[^\\p{L}\\p{N}\\s]', '', 'g'))"


_WS = "list_filter(regexp_extract_all(regexp_replace(id, '[,.()\\-&]', ' ', 'g'), '\\S+'), lambda w: lower(w) NOT IN ('of', 'and', 'the', 'for', 'in', 'to', 'a', 'an', 'at', 'by', 'on'))"
_INITIALS = f"CASE WHEN len({_WS}) >= 2 THEN array_to_string(list_transform({_WS}, lambda x: upper(substr(x, 1, 1))), '') ELSE '' END"
_NODES = f"""nn AS (SELECT source_name AS id, min(source_type) AS label, min(nullif(upper(trim(source_ticker)), '')) AS ticker, min(nullif(upper(trim(source_cik)), '')) AS cik FROM annotated_triples GROUP BY 1),
n AS (SELECT *, {_KEY} AS norm, {_INITIALS} AS init, min(id) OVER (PARTITION BY ticker) AS tfirst, min(id) OVER (PARTITION BY cik) AS cfirst FROM nn)"""
# The seven rules and the two identifiers over all pairs, and their components.
_LINKED = f"""{_NODES}, al AS (SELECT *, {_KEY.replace('(id)', '(full_name)')} AS full_norm FROM (VALUES ('tsmc', 'Taiwan Semiconductor Manufacturing Company', 'TSM'), ('taiwan semiconductor', 'Taiwan Semiconductor Manufacturing Company', 'TSM'), ('foxconn', 'Hon Hai Precision Industry Co., Ltd.', 'HNHPF'),
('google', 'Alphabet Inc.', 'GOOGL'), ('facebook', 'Meta Platforms, Inc.', 'META'), ('bofa', 'Bank of America Corporation', 'BAC'), ('apple', 'Apple Inc.', 'AAPL'), ('microsoft', 'Microsoft Corporation', 'MSFT'), ('nvidia', 'NVIDIA Corporation', 'NVDA'), ('broadcom', 'Broadcom Inc.', 'AVGO'), ('cisco', 'Cisco Systems, Inc.', 'CSCO')) t(alias, full_name, tick)),
p AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id < b.id AND (a.cik IS NULL OR b.cik IS NULL OR a.cik = b.cik) AND (a.ticker IS NULL OR b.ticker IS NULL OR a.ticker = b.ticker OR (a.cik = b.cik AND a.cik IS NOT NULL)) WHERE
 (coalesce(a.cik = b.cik, false) AND a.id = a.cfirst) OR ((a.ticker IS NULL OR b.ticker IS NULL OR a.ticker = b.ticker) AND ((coalesce(a.ticker = b.ticker, false) AND a.id = a.tfirst) OR (a.label = b.label AND (
 (length(a.id) BETWEEN 2 AND 5 AND upper(a.id) = a.id AND lower(a.id) <> a.id AND a.id = b.init) OR (length(b.id) BETWEEN 2 AND 5 AND upper(b.id) = b.id AND lower(b.id) <> b.id AND b.id = a.init) OR (a.norm = b.norm AND a.norm <> '') OR coalesce(a.ticker = upper(b.id), false) OR coalesce(b.ticker = upper(a.id), false)
 OR (length(a.norm) >= 6 AND length(b.norm) >= 6 AND substr(a.norm, 1, 4) = substr(b.norm, 1, 4) AND (list_has_all(string_split(b.norm, ' '), string_split(a.norm, ' ')) OR list_has_all(string_split(a.norm, ' '), string_split(b.norm, ' '))))
 OR (abs(length(a.norm) - length(b.norm)) <= 2 AND least(length(a.norm), length(b.norm)) >= 4 AND (levenshtein(a.norm, b.norm) <= 1 OR (levenshtein(a.norm, b.norm) <= 2 AND least(length(a.norm), length(b.norm)) >= 6)))
 OR (a.norm <> '' AND substr(a.norm, 1, 1) = substr(b.norm, 1, 1) AND abs(length(a.norm) - length(b.norm)) <= 5 AND jaro_winkler_similarity(strip_accents(a.norm), strip_accents(b.norm)) >= 0.88))))) 
 UNION SELECT least(x.id, y.id), greatest(x.id, y.id) FROM n x JOIN al ON lower(trim(x.id)) = alias OR x.norm = alias JOIN n y ON y.label = x.label AND y.id <> x.id AND (x.cik IS NULL OR y.cik IS NULL OR x.cik = y.cik) AND (x.ticker IS NULL OR y.ticker IS NULL OR x.ticker = y.ticker)
 AND (contains(lower(y.id), lower(full_name)) OR contains(lower(full_name), lower(y.id)) OR full_norm = y.norm OR coalesce(y.ticker = tick, false))),
r AS (SELECT id AS node, id AS seen FROM n UNION SELECT r.node, CASE WHEN p.a = r.seen THEN p.b ELSE p.a END FROM r JOIN p ON p.a = r.seen OR p.b = r.seen), c AS (SELECT node AS id, min(seen) AS component FROM r GROUP BY 1)"""
_SCORE = f"""(CASE WHEN regexp_matches(id, '(?i)^(the|our|this)\\b|\\b(giant|maker|supplier|customer|counterparty|firm)\\b') THEN 1 ELSE 0 END, CASE WHEN list_has_any(regexp_extract_all(lower(id), '\\b[a-z]+\\b'), ['inc', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'llc', 'plc', 'nv', 'ag', 'sa', 'gmbh', 'bv', 'group', 'holding', 'holdings',
'technology', 'technologies', 'tech', 'system', 'systems', 'solution', 'solutions', 'semiconductor', 'semiconductors', 'international', 'intl', 'enterprises', 'enterprise', 'industries', 'industry']) THEN 0 ELSE 1 END, CASE WHEN regexp_matches(id, '(?i)^(the|our|this)\\b|\\b(giant|maker|supplier|customer|counterparty|firm)\\b') THEN length(id) ELSE -length(id) END, id)"""
_CANONICAL = f"{_LINKED}, k AS (SELECT component, min_by(id, {_SCORE}) AS canonical, count(*) AS mention_count FROM c GROUP BY 1), m AS (SELECT id, canonical, mention_count FROM c JOIN k USING (component))"


def entities(spark, d):
    """Sources of triples with their identifiers."""
    t = table(spark, d, "annotated_triples")
    return t.groupBy(F.col("source_name").alias("id")).agg(F.min("source_type").alias("label"), F.min("source_ticker").alias("ticker"), F.min("source_cik").alias("cik"))


@query("JOI_07", f"WITH RECURSIVE {_LINKED} SELECT id, component FROM c")
def entity_components(spark, d):
    """What the rules link, as the least name of each component."""
    n = entities(spark, d)
    comp = connected_components(R.links(n), "a", "b")
    return n.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query("GRF_21", f"WITH RECURSIVE {_CANONICAL} SELECT id, canonical, mention_count FROM m")
def resolved(spark, d):
    n = entities(spark, d)
    return R.resolved(n, R.links(n)).select("id", "canonical", "mention_count")


@query("GRF_22", f"""WITH RECURSIVE {_CANONICAL}, x AS (SELECT coalesce(s.canonical, source_name) AS s, coalesce(t.canonical, target_name) AS t, rel_type, confidence FROM annotated_triples LEFT JOIN m s ON s.id = source_name LEFT JOIN m t ON t.id = target_name),
y AS (SELECT CASE WHEN rel_type IN ('COMPETES_WITH', 'PARTNERED_WITH') THEN least(s, t) ELSE s END AS source, CASE WHEN rel_type IN ('COMPETES_WITH', 'PARTNERED_WITH') THEN greatest(s, t) ELSE t END AS target, rel_type, confidence FROM x WHERE s <> t)
SELECT source, target, rel_type, count(*) AS evidence, max(confidence) AS confidence FROM y GROUP BY 1, 2, 3""")
def rewired_merged(spark, d):
    n = entities(spark, d)
    e = table(spark, d, "annotated_triples").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", "confidence")
    x = R.rewired(e, R.resolved(n, R.links(n)))
    return x.groupBy("source", "target", "rel_type").agg(F.count("*").alias("evidence"), F.max("confidence").alias("confidence"))


@query("GRF_23", f"WITH RECURSIVE {_CANONICAL}, i AS (SELECT m.canonical, min_by(ticker, {_SCORE.replace('(id', '(n.id').replace(', id)', ', n.id)')}) FILTER (ticker IS NOT NULL) AS ticker, count(*) AS nodes FROM m JOIN n ON n.id = m.id GROUP BY 1) SELECT canonical, ticker, nodes FROM i")
def resolved_snapshot(spark, d):
    """A snapshot written, read, resolved and written again: one node an entity."""
    folder, out = scratch(spark, "raw"), scratch(spark, "resolved")
    entities(spark, d).write.parquet(f"{folder}/nodes.parquet")
    n = spark.read.parquet(f"{folder}/nodes.parquet")
    r = R.resolved(n, R.links(n))
    r.groupBy("canonical").agg(F.first("ticker").alias("ticker"), F.count("*").alias("nodes")).write.parquet(f"{out}/nodes.parquet")
    return spark.read.parquet(f"{out}/nodes.parquet")


@query("GRF_25", _BFS + """, h AS (SELECT e.source || ' -[' || rel_type || ']-> ' || e.target AS line, n.d + 1 AS hop FROM e JOIN n ON n.node = e.source) SELECT hop, string_agg(DISTINCT line, chr(10) ORDER BY line) AS words FROM h GROUP BY hop""")
def verbalised(spark, d):
    x = G.k_hop(current(spark, d), root(spark), 3)
    line = F.format_string("%s -[%s]-> %s", "source", "rel_type", "target")
    return x.select("hop", line.alias("line")).distinct().groupBy("hop").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("words"))


def shock_edges(spark, d):
    """Suppliers to customers by brand, customers to nations by segment, nations to regions; shares sum to 1 per target and group."""
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    one = x.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("target"), F.col("p_brand").alias("input_group")).agg(F.count("*").alias("x"))
    c = table(spark, d, "customer")
    two = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("target"), F.col("c_mktsegment").alias("input_group"), F.lit(1).cast("long").alias("x"))
    three = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("target"), F.lit("ALL").alias("input_group"), F.lit(1).cast("long").alias("x"))
    e = one.unionByName(two).unionByName(three)
    total = e.groupBy("target", "input_group").agg(F.sum("x").alias("total"))
    return e.join(total, ["target", "input_group"]).select("source", "target", "input_group", (F.col("x") / F.col("total")).alias("share"), F.lit(0.0).alias("buffer_days"))


_SHOCK = """WITH x1 AS (SELECT 'S' || l_suppkey AS source, 'C' || o_custkey AS target, p_brand AS input_group, count(*) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
x AS (FROM x1 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_mktsegment, 1 FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'ALL', 1 FROM nation),
e AS (SELECT source, target, input_group, x / sum(x) OVER (PARTITION BY target, input_group) AS a FROM x),
n AS (SELECT source AS node FROM e UNION SELECT target FROM e), h0 AS (SELECT node, CASE WHEN node IN ('S1', 'S7') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h FROM n),
""" + ",\n".join(f"g{i} AS (SELECT target, max(least(1.0, s)) AS v FROM (SELECT target, input_group, sum(a * h) AS s FROM e JOIN h{i - 1} ON node = source WHERE h > 0 GROUP BY 1, 2) GROUP BY 1), h{i} AS (SELECT b.node, greatest(b.h, coalesce(v, 0)) AS h FROM h0 b LEFT JOIN g{i} ON target = b.node)" for i in (1, 2, 3))  # fmt: skip


@query("GRF_11", _SHOCK + """ SELECT node AS target_entity, round(h * 100, 4) AS peak_shock_pct, round(h, 6) AS impairment_score, CASE WHEN h > 0 THEN 0.0 END AS onset_day, CASE WHEN h > 0 THEN 30.0 ELSE 0.0 END AS downtime_days, round(h * CASE WHEN h > 0 THEN 30.0 ELSE 0.0 END, 4) AS lost_capacity_days,
h = 0 AS is_out_of_horizon, false AS is_friction_floor, CASE WHEN round(h * 100, 4) >= 25 THEN 'DISRUPTIVE_SHOCK' WHEN round(h * 100, 4) > 0 THEN 'CONTAINED_MINIMAL_CONTAGION' ELSE 'NEUTRAL_UNAFFECTED' END AS verdict FROM h3""")
def shock_cascade(spark, d):
    shocks = spark.createDataFrame([("S1", 100.0, 30.0, 0.0), ("S7", 1.0, 30.0, 0.0)], "node string, shock double, duration double, onset double")
    return G.cascade(shock_edges(spark, d), shocks, acyclic=True)


@query("AGG_08", _SHOCK + " SELECT target, round(v, 6) AS v FROM g1")
def leontief(spark, d):
    h = shock_edges(spark, d).where(F.col("source").isin("S1", "S7"))
    g = h.groupBy("target", "input_group").agg(F.least(F.lit(1.0), F.sum("share")).alias("s"))
    return g.groupBy("target").agg(F.round(F.max("s"), 6).alias("v"))


_REACH = f"""WITH RECURSIVE {_E.replace("e AS (", "e0 AS (", 1)}, e AS (SELECT source, target, triple_id FROM e0 UNION ALL SELECT target, source, -triple_id FROM e0 WHERE rel_type = 'COMPETES_WITH'), x AS (SELECT DISTINCT source AS u, target AS v FROM e), w AS (SELECT u, v FROM x UNION SELECT w.u, x.v FROM w JOIN x ON x.u = w.v), cyc AS (SELECT u AS node FROM w WHERE u = v),
s AS (SELECT w.u AS node, min(w.v) AS scc FROM w JOIN w b ON b.u = w.v AND b.v = w.u GROUP BY 1)"""


def mutual(spark, d):
    """The current edges, with competition running both ways, so that there are cycles."""
    e = current(spark, d)
    back = e.where("rel_type = 'COMPETES_WITH'").select(F.col("target").alias("source"), F.col("source").alias("target"), "rel_type", (-F.col("triple_id")).alias("triple_id"))
    return e.unionByName(back)


@query("GRF_08", _REACH + " SELECT node, scc FROM s")
def cycles(spark, d):
    return G.strong_components(mutual(spark, d))


@query("GRF_09", _REACH + f""", h AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, h.d + 1 FROM h JOIN e ON e.source = h.node WHERE h.d < 40), d AS (SELECT node, min(d) AS d FROM h GROUP BY 1)
SELECT triple_id FROM e JOIN s a ON a.node = source JOIN s b ON b.node = target AND a.scc = b.scc LEFT JOIN d u ON u.node = source LEFT JOIN d v ON v.node = target WHERE coalesce(v.d, 2147483647) <= coalesce(u.d, 2147483647)""")
def feedback(spark, d):
    return G.feedback_edges(mutual(spark, d), root(spark)).select("triple_id")


@query("GRF_10")
def radius(spark, d):
    e = mutual(spark, d).withColumn("share", F.lit(0.5))
    return spark.createDataFrame([(round(G.spectral_radius(e), 4),)], "spectral_radius double")


def owners(spark, d):
    """Ownership edges: subsidiary relations as they are, and every fifth supply edge as a parent relation, so that there are cycles to break."""
    e = table(spark, d, "annotated_triples").where("rel_type = 'SUBSIDIARY_OF' or rel_type = 'SUPPLIES_TO'")
    rel = F.when(F.col("rel_type") == "SUBSIDIARY_OF", F.col("rel_type")).otherwise("PARENT_OF")
    return e.select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), rel.alias("rel_type"), "confidence", F.col("triple_id").alias("ordinal"))


@query("GRF_14")
def ownership(spark, d):
    return G.acyclic_ownership(owners(spark, d))[1]


@query("TOP_03", f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 1), u AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.source, u.d + 1 FROM u JOIN e ON e.target = u.node WHERE u.d < 1),
a AS (SELECT e.*, n.d + 1 AS hop FROM e JOIN (SELECT node, min(d) AS d FROM w GROUP BY 1) n ON n.node = e.source UNION ALL SELECT e.*, n.d + 1 FROM e JOIN (SELECT node, min(d) AS d FROM u GROUP BY 1) n ON n.node = e.target)
SELECT triple_id, min(hop) AS hop, row_number() OVER (ORDER BY min(hop), source, target, rel_type, triple_id) AS place FROM a GROUP BY triple_id, source, target, rel_type""")
def ego_edges(spark, d):
    """Edges around the root within two hops either way, in the order of a report."""
    e = G.ego(current(spark, d), root(spark), 2)[1]
    return e.select("triple_id", "hop", F.row_number().over(W.orderBy("hop", "source", "target", "rel_type", "triple_id")).cast("long").alias("place"))


@query("TOP_04", f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 3) SELECT node, min(d) AS hop, row_number() OVER (ORDER BY min(d), node) AS place FROM w GROUP BY node""")
def report_order(spark, d):
    return G.hop_distances(current(spark, d), root(spark), 3).select("node", F.col("dist").alias("hop"), F.row_number().over(W.orderBy("dist", "node")).cast("long").alias("place"))


@query("TOP_08", f"""WITH {_E}, g AS (SELECT source, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, source LIMIT 8) SELECT source, triple_id FROM e JOIN g USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY triple_id) <= 5""")
def seeds(spark, d):
    """The eight best connected seeds, five edges of each."""
    e = current(spark, d)
    top = e.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)
    return e.join(F.broadcast(top.select("source")), "source").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("triple_id"))).where("r <= 5").select("source", "triple_id")


@query("SET_05", f"""WITH RECURSIVE {_E}, w AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.target, w.d + 1 FROM w JOIN e ON e.source = w.node WHERE w.d < 2), u AS (SELECT '{_ROOT}' AS node, 0 AS d UNION SELECT e.source, u.d + 1 FROM u JOIN e ON e.target = u.node WHERE u.d < 2),
a AS (SELECT node, d, 'DOWNSTREAM' AS role FROM w WHERE d > 0 UNION ALL SELECT node, d, 'UPSTREAM' FROM u WHERE d > 0) SELECT node, min(d) AS hop, CASE WHEN count(DISTINCT role) > 1 THEN 'BOTH' ELSE min(role) END AS role FROM a WHERE node <> '{_ROOT}' GROUP BY node""")
def roles(spark, d):
    return G.ego(current(spark, d), root(spark), 2)[0].where("role <> 'ROOT'").select("node", "hop", "role")


@query("JOI_15", f"WITH {_E}, h AS (SELECT source AS node, (length(source) % 10) / 10.0 AS h FROM e GROUP BY 1) SELECT triple_id, h::DOUBLE AS h FROM e JOIN h ON h.node = e.source WHERE h > 0")
def carried_state(spark, d):
    """In-edges with the state of their source, where there is any."""
    e = current(spark, d)
    state = e.select("source").distinct().withColumn("h", (F.length("source") % 10) / 10.0)
    return e.join(state, "source").where("h > 0").select("triple_id", "h")


@query("AGG_09", f"WITH {_E} SELECT target, min(length(source)) AS onset, max(length(source) + triple_id % 30) AS ends FROM e WHERE triple_id % 3 <> 0 GROUP BY 1")
def converging(spark, d):
    """Earliest onset and latest end over the active in-edges."""
    e = current(spark, d).where("triple_id % 3 <> 0")
    return e.groupBy("target").agg(F.min(F.length("source")).cast("long").alias("onset"), F.max(F.length("source") + F.col("triple_id") % 30).alias("ends"))


_ORIGIN = f"""{_E}, s AS (SELECT source, target, triple_id, 20 + triple_id % 60 AS exposure, triple_id % 45 AS buffer FROM e WHERE source <> target),
l1 AS (SELECT target AS node, triple_id, lpad(triple_id::VARCHAR, 12, '0') AS path, '{_ROOT}' AS parent, exposure, buffer FROM s WHERE source = '{_ROOT}' QUALIFY row_number() OVER (PARTITION BY target ORDER BY path) = 1),
m1 AS (SELECT *, 1 AS hop, greatest(90 - buffer, 0) AS dur, round(50.0 * exposure / 100 * CASE WHEN 90 > buffer THEN 1 - buffer / 90 ELSE 0.05 END, 2) AS mag FROM l1),
l2 AS (SELECT s.target AS node, s.triple_id, p.path || lpad(s.triple_id::VARCHAR, 12, '0') AS path, p.node AS parent, s.exposure, s.buffer, p.dur AS pd, p.mag AS pm FROM s JOIN m1 p ON s.source = p.node WHERE s.target <> '{_ROOT}' AND s.target NOT IN (SELECT node FROM m1) QUALIFY row_number() OVER (PARTITION BY s.target ORDER BY path) = 1),
m2 AS (SELECT *, 2 AS hop, greatest(pd - buffer, 0) AS dur, round(pm * exposure / 100 * CASE WHEN pd > buffer THEN 1 - buffer / pd ELSE 0.05 END, 2) AS mag FROM l2)"""


@query("GRF_12", f"WITH {_ORIGIN} SELECT node, parent, hop, dur::BIGINT AS duration, mag::DOUBLE AS magnitude FROM m1 UNION ALL SELECT node, parent, hop, dur::BIGINT, mag::DOUBLE FROM m2")
def first_visit_shock(spark, d):
    """A shock of 50 % and 90 days from the root over two hops."""
    e = current(spark, d).where("source <> target").select("source", "target", F.col("triple_id").alias("edge"), (20 + F.col("triple_id") % 60).cast("double").alias("exposure_pct"), (F.col("triple_id") % 45).cast("double").alias("buffer_days"))
    return G.first_visit_shock(e, _ROOT, 50.0, 90.0, 2).select("node", "parent", "hop", F.col("duration").cast("long").alias("duration"), "magnitude")


@query("GRF_13", "SELECT event_id, 'T' || user_id AS origin, round(abs(value), 2) AS magnitude_pct, CASE WHEN event_id % 4 = 0 THEN 30 ELSE 90 END AS duration_days, CASE WHEN value / 50 - 2.2 <= -2.0 THEN 0.95 ELSE 0.8 END AS confidence FROM events")
def shock_vectors(spark, d):
    x = table(spark, d, "events").select("event_id", F.concat(F.lit(" t"), F.col("user_id").cast("string")).alias("ticker"), F.col("value").alias("car"), (F.col("value") / 50 - 2.2).alias("z"), F.when(F.col("event_id") % 4 == 0, 30).alias("days"))
    return G.shock_vectors(x, "ticker", "car", "z", "days").select("event_id", "origin", "magnitude_pct", "duration_days", "confidence")


@query("GRF_20", f"""WITH o AS (SELECT * FROM (VALUES {_ONT}) t(relation, dom, rng, sym)), x AS (SELECT t.*, upper(source_type) AS sl, upper(target_type) AS tl FROM annotated_triples t),
y AS (SELECT triple_id, relation IS NULL AS other, sym, source_name AS s, target_name AS t, list_contains(dom, sl) AND list_contains(rng, tl) AS ok, list_contains(dom, tl) AND list_contains(rng, sl) AS turn FROM x LEFT JOIN o ON relation = rel_type)
SELECT triple_id, CASE WHEN other THEN 'relation' WHEN NOT ok AND NOT turn THEN 'ontology' ELSE 'kept' END AS verdict FROM y WHERE triple_id NOT IN (SELECT triple_id FROM annotated_triples WHERE rel_type = 'EXPOSED_TO')""")
def payload_gate(spark, d):
    """Every edge with the rule of the gate that rejects it, or kept."""
    e = table(spark, d, "annotated_triples").where("rel_type <> 'EXPOSED_TO'").withColumnsRenamed({"source_name": "source", "target_name": "target"})
    kept = G.oriented(spark, e).select("triple_id", F.lit(True).alias("kept"))
    known = F.col("rel_type").isin(*G.ONTOLOGY, *G.ALIASES)
    return e.join(kept, "triple_id", "left").select("triple_id", F.when(~known, "relation").when(F.col("kept").isNull(), "ontology").otherwise("kept").alias("verdict"))
