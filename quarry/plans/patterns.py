"""Pattern queries over the triples, each written as a statement and again as joins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.core.runtime import cut, table
from quarry.operators import patterns as P
from quarry.plans.registry import query


def graph(spark, d):
    t = table(spark, d, "annotated_triples")
    e = t.select(F.col("triple_id").alias("edge"), F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type")
    ends = t.select(F.col("source_name").alias("id"), F.col("source_type").alias("label"), F.col("source_ticker").alias("ticker")).unionByName(t.select(F.col("target_name").alias("id"), F.col("target_type").alias("label"), F.col("target_ticker").alias("ticker")))
    return cut(ends.groupBy("id").agg(F.min("label").alias("label"), F.min("ticker").alias("ticker"))), cut(e)


#: Statement by name: shapes of supply, competition, investment, leadership and exposure questions.
STATEMENTS = {
    "shared_supplier": "MATCH (a:Company)-[:SUPPLIES_TO|PRODUCES]-(s:Company)-[:SUPPLIES_TO|PRODUCES]-(b:Company) WHERE a.id =~ '(?i).*Robotics.*' AND b.id =~ '(?i).*Medical.*' AND a <> b AND s <> a AND s <> b RETURN DISTINCT s.id AS x, a.id AS y, b.id AS z",
    "product_suppliers": "MATCH (a:Company)-[:PRODUCES]->(p:Product)-[:PRODUCES|EXPOSED_TO]-(s:Company) WHERE a.id =~ '(?i).*Steel.*' RETURN DISTINCT p.id AS x, s.id AS y",
    "two_hop_dependency": "MATCH (a:Company)-[:SUPPLIES_TO|DEPENDS_ON]->(m)-[:DEPENDS_ON|SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Battery.*' AND b <> a RETURN DISTINCT a.id AS x, m.id AS y, b.id AS z",
    "components_of_both": "MATCH (a:Company)-[:SUPPLIES_TO]-(s:Company)-[:SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Robotics.*' AND (b.id =~ '(?i).*Marine.*' OR b.id =~ '(?i).*Freight.*') AND s <> a AND s <> b RETURN DISTINCT s.id AS x",
    "technology_partners": "MATCH (a:Company)-[:PRODUCES|SUPPLIES_TO]-(t)-[:SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Optical.*' AND b <> a RETURN DISTINCT a.id AS x, t.id AS y, b.id AS z",
    "competitor_that_supplies": "MATCH (a:Company)-[:COMPETES_WITH]-(c:Company)-[:SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Medical.*' AND b.id =~ '(?i).*Steel.*' RETURN DISTINCT c.id AS x, b.id AS y",
    "extended_competitors": "MATCH (a:Company)-[:COMPETES_WITH]-(b:Company)-[:COMPETES_WITH*0..1]-(c:Company) WHERE a.id =~ '(?i).*Robotics.*' RETURN DISTINCT b.id AS x, c.id AS y",
    "peers": "MATCH (a:Company)-[:COMPETES_WITH|PRODUCES]-(b:Company) WHERE a.id =~ '(?i).*Automotive.*' AND b <> a RETURN DISTINCT b.id AS x",
    "product_overlap": "MATCH (a:Company)-[:PRODUCES]->(p:Product)<-[:PRODUCES]-(b:Company) WHERE a.id =~ '(?i).*Steel.*' RETURN DISTINCT p.id AS x, b.id AS y",
    "direct_rivals": "MATCH (a:Company)-[:COMPETES_WITH]-(b:Company) WHERE a.id =~ '(?i).*Semiconductor.*' RETURN DISTINCT b.id AS x",
    "common_target": "MATCH (f:Company)-[:SUPPLIES_TO|DEPENDS_ON]->(t:Company)<-[:SUPPLIES_TO|DEPENDS_ON]-(g:Company) WHERE t.id =~ '(?i).*Water.*' AND f <> g RETURN DISTINCT t.id AS x, f.id AS y, g.id AS z",
    "shared_target": "MATCH (a:Company)-[:SUPPLIES_TO|DEPENDS_ON]->(t:Company)<-[:SUPPLIES_TO|DEPENDS_ON]-(b:Company) WHERE a.id =~ '(?i).*Copper.*' AND b.id =~ '(?i).*Paper.*' RETURN DISTINCT t.id AS x",
    "ventures": "MATCH (a:Company)-[:SUBSIDIARY_OF|DEPENDS_ON]->(b:Company) WHERE a.id =~ '(?i).*Energy.*' RETURN DISTINCT b.id AS x",
    "joint_partners": "MATCH (a:Company)-[:DEPENDS_ON|SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Data Networks.*' RETURN DISTINCT b.id AS x",
    "joint_consortium": "MATCH (a:Company)-[:SUPPLIES_TO]-(m)-[:SUPPLIES_TO]-(b:Company) WHERE a.id =~ '(?i).*Chemicals.*' AND b.id =~ '(?i).*Aerospace.*' RETURN DISTINCT m.id AS x",
    "leader_and_partners": "MATCH (l:Person)-[:EXECUTIVE_OF]->(c:Company)-[:SUPPLIES_TO]-(p:Company) WHERE c.id =~ '(?i).*Robotics.*' RETURN DISTINCT l.id AS x, c.id AS y, p.id AS z",
    "leaders": "MATCH (l:Person)-[:EXECUTIVE_OF]->(c:Company) WHERE c.id =~ '(?i).*Water.*' RETURN DISTINCT l.id AS x, c.id AS y",
    "leaders_of_makers": "MATCH (l:Person)-[:EXECUTIVE_OF]->(c:Company)-[:PRODUCES]->(p:Product) WHERE c.id =~ '(?i).*Steel.*' RETURN DISTINCT l.id AS x, p.id AS y",
    "other_roles": "MATCH (l:Person)-[:EXECUTIVE_OF]->(c:Company), (l)-[:BOARD_MEMBER_OF|EXECUTIVE_OF]->(o:Company) WHERE o <> c RETURN DISTINCT l.id AS x, c.id AS y, o.id AS z",
    "board": "MATCH (l:Person)-[:BOARD_MEMBER_OF]->(c:Company) WHERE c.id =~ '(?i).*Medical.*' RETURN DISTINCT l.id AS x, c.id AS y",
    "regulators": "MATCH (c:Company)-[:REGULATED_BY|EXPOSED_TO]-(r) WHERE c.id =~ '(?i).*Steel.*' OR c.id =~ '(?i).*Freight.*' OR c.id =~ '(?i).*Medical.*' RETURN DISTINCT c.id AS x, r.id AS y",
    "regulation_spread": "MATCH (r)<-[:REGULATED_BY|EXPOSED_TO]-(c:Company)-[:SUPPLIES_TO]->(b:Company) RETURN DISTINCT r.id AS x, c.id AS y, b.id AS z",
    "exposed_rivals": "MATCH (r)<-[:EXPOSED_TO]-(c:Company)-[:COMPETES_WITH]-(b:Company) RETURN DISTINCT r.id AS x, b.id AS y",
    "family_exposure": "MATCH (s)-[:SUBSIDIARY_OF]->(c:Company)-[:EXPOSED_TO|REGULATED_BY]->(r) RETURN DISTINCT s.id AS x, r.id AS y",
    "regulated_leaders": "MATCH (l:Person)-[:EXECUTIVE_OF]->(c:Company)-[:REGULATED_BY]->(r) RETURN DISTINCT l.id AS x, r.id AS y",
}

_BASE = """WITH ends AS (SELECT source_name AS id, source_type AS label FROM annotated_triples UNION ALL SELECT target_name, target_type FROM annotated_triples), n AS (SELECT id, min(label) AS label FROM ends GROUP BY 1),
c AS (SELECT id FROM n WHERE label = 'Company'), d AS (SELECT triple_id AS e, source_name AS s, target_name AS t, rel_type AS r FROM annotated_triples), u AS (SELECT e, s, t, r FROM d UNION ALL SELECT e, t, s, r FROM d)"""


def _two(first: str, second: str, where: str, out: str, v1="u", v2="u", la="a.s", lm: str | None = None, lb="b.t") -> str:
    """A chain of two relations in SQL; ``la``, ``lm``, ``lb``: columns that must be companies."""
    labels = "".join(f" AND {x} IN (SELECT id FROM c)" for x in (la, lm, lb) if x)
    return f"SELECT DISTINCT {out} FROM {v1} a JOIN {v2} b ON a.t = b.s AND a.e <> b.e WHERE a.r IN ({first}) AND b.r IN ({second}){labels}{' AND ' + where if where else ''}"


_Z = "NULL::VARCHAR"
_CONTAINS = "regexp_matches({0}, '(?i){1}')"


def _has(col: str, word: str) -> str:
    return _CONTAINS.format(col, word)


def _kind(col: str, label: str) -> str:
    return f"{col} IN (SELECT id FROM n WHERE label = '{label}')"


_S, _P, _D, _C, _E = "'SUPPLIES_TO'", "'PRODUCES'", "'DEPENDS_ON'", "'COMPETES_WITH'", "'EXECUTIVE_OF'"
_REV = "(SELECT e, t AS s, s AS t, r FROM d)"
_SQL = {
    "shared_supplier": _two(f"{_S}, {_P}", f"{_S}, {_P}", f"{_has('a.s', 'Robotics')} AND {_has('b.t', 'Medical')} AND a.s <> b.t AND a.t <> a.s AND a.t <> b.t", "a.t AS x, a.s AS y, b.t AS z", lm="a.t"),
    "product_suppliers": _two(_P, f"{_P}, 'EXPOSED_TO'", f"{_has('a.s', 'Steel')} AND {_kind('a.t', 'Product')}", f"a.t AS x, b.t AS y, {_Z} AS z", v1="d"),
    "two_hop_dependency": _two(f"{_S}, {_D}", f"{_S}, {_D}", f"{_has('a.s', 'Battery')} AND b.t <> a.s", "a.s AS x, a.t AS y, b.t AS z", v1="d"),
    "components_of_both": _two(_S, _S, f"{_has('a.s', 'Robotics')} AND ({_has('b.t', 'Marine')} OR {_has('b.t', 'Freight')}) AND a.t <> a.s AND a.t <> b.t", f"a.t AS x, {_Z} AS y, {_Z} AS z", lm="a.t"),
    "technology_partners": _two(f"{_S}, {_P}", _S, f"{_has('a.s', 'Optical')} AND b.t <> a.s", "a.s AS x, a.t AS y, b.t AS z"),
    "competitor_that_supplies": _two(_C, _S, f"{_has('a.s', 'Medical')} AND {_has('b.t', 'Steel')}", f"a.t AS x, b.t AS y, {_Z} AS z", lm="a.t"),
    "extended_competitors": _two(_C, _C, _has("a.s", "Robotics"), f"a.t AS x, b.t AS y, {_Z} AS z", lm="a.t") + f" UNION SELECT a.t, a.t, {_Z} FROM u a WHERE a.r = {_C} AND {_has('a.s', 'Robotics')} AND a.s IN (SELECT id FROM c) AND a.t IN (SELECT id FROM c)",
    "peers": f"SELECT DISTINCT t AS x, {_Z} AS y, {_Z} AS z FROM u WHERE r IN ({_C}, {_P}) AND {_has('s', 'Automotive')} AND t <> s AND s IN (SELECT id FROM c) AND t IN (SELECT id FROM c)",
    "product_overlap": _two(_P, _P, f"{_has('a.s', 'Steel')} AND {_kind('a.t', 'Product')}", f"a.t AS x, b.t AS y, {_Z} AS z", v1="d", v2=_REV),
    "direct_rivals": f"SELECT DISTINCT t AS x, {_Z} AS y, {_Z} AS z FROM u WHERE r = {_C} AND {_has('s', 'Semiconductor')} AND s IN (SELECT id FROM c) AND t IN (SELECT id FROM c)",
    "common_target": _two(f"{_S}, {_D}", f"{_S}, {_D}", f"{_has('a.t', 'Water')} AND a.s <> b.t", "a.t AS x, a.s AS y, b.t AS z", v1="d", v2=_REV, lm="a.t"),
    "shared_target": _two(f"{_S}, {_D}", f"{_S}, {_D}", f"{_has('a.s', 'Copper')} AND {_has('b.t', 'Paper')}", f"a.t AS x, {_Z} AS y, {_Z} AS z", v1="d", v2=_REV, lm="a.t"),
    "ventures": f"SELECT DISTINCT t AS x, {_Z} AS y, {_Z} AS z FROM d WHERE r IN ('SUBSIDIARY_OF', {_D}) AND {_has('s', 'Energy')} AND s IN (SELECT id FROM c) AND t IN (SELECT id FROM c)",
    "joint_partners": f"SELECT DISTINCT t AS x, {_Z} AS y, {_Z} AS z FROM u WHERE r IN ({_S}, {_D}) AND {_has('s', 'Data Networks')} AND s IN (SELECT id FROM c) AND t IN (SELECT id FROM c)",
    "joint_consortium": _two(_S, _S, f"{_has('a.s', 'Chemicals')} AND {_has('b.t', 'Aerospace')}", f"a.t AS x, {_Z} AS y, {_Z} AS z"),
    "leader_and_partners": _two(_E, _S, f"{_has('a.t', 'Robotics')} AND {_kind('a.s', 'Person')}", "a.s AS x, a.t AS y, b.t AS z", v1="d", la="b.t", lm="a.t"),
    "leaders": f"SELECT DISTINCT s AS x, t AS y, {_Z} AS z FROM d WHERE r = {_E} AND {_has('t', 'Water')} AND {_kind('s', 'Person')} AND t IN (SELECT id FROM c)",
    "leaders_of_makers": _two(_E, _P, f"{_has('a.t', 'Steel')} AND {_kind('a.s', 'Person')} AND {_kind('b.t', 'Product')}", f"a.s AS x, b.t AS y, {_Z} AS z", v1="d", v2="d", la="a.t", lb=None),
    "other_roles": f"SELECT DISTINCT a.s AS x, a.t AS y, b.t AS z FROM d a JOIN d b ON a.s = b.s AND a.e <> b.e WHERE a.r = {_E} AND b.r IN ('BOARD_MEMBER_OF', {_E}) AND a.t <> b.t AND {_kind('a.s', 'Person')} AND a.t IN (SELECT id FROM c) AND b.t IN (SELECT id FROM c)",
    "board": f"SELECT DISTINCT s AS x, t AS y, {_Z} AS z FROM d WHERE r = 'BOARD_MEMBER_OF' AND {_has('t', 'Medical')} AND {_kind('s', 'Person')} AND t IN (SELECT id FROM c)",
    "regulators": f"SELECT DISTINCT s AS x, t AS y, {_Z} AS z FROM u WHERE r IN ('REGULATED_BY', 'EXPOSED_TO') AND ({_has('s', 'Steel')} OR {_has('s', 'Freight')} OR {_has('s', 'Medical')}) AND s IN (SELECT id FROM c)",
    "regulation_spread": _two("'REGULATED_BY', 'EXPOSED_TO'", _S, "", "a.s AS x, a.t AS y, b.t AS z", v1=_REV, v2="d", la="a.t"),
    "exposed_rivals": _two("'EXPOSED_TO'", _C, "", f"a.s AS x, b.t AS y, {_Z} AS z", v1=_REV, la="a.t"),
    "family_exposure": _two("'SUBSIDIARY_OF'", "'REGULATED_BY', 'EXPOSED_TO'", "", f"a.s AS x, b.t AS y, {_Z} AS z", v1="d", v2="d", la="a.t", lb=None),
    "regulated_leaders": _two(_E, "'REGULATED_BY'", _kind("a.s", "Person"), f"a.s AS x, b.t AS y, {_Z} AS z", v1="d", v2="d", la="a.t", lb=None),
}
_ALL = _BASE + " " + " UNION ALL ".join(f"SELECT '{k}' AS pattern, x, y, z FROM ({v})" for k, v in _SQL.items())


def matches(spark, d):
    """Rows of all statements with the statement's name."""
    nodes, edges = graph(spark, d)
    out = None
    for name, statement in STATEMENTS.items():
        x = P.run(statement, nodes, edges)
        x = x.select(F.lit(name).alias("pattern"), *[F.col(c) if c in x.columns else F.lit(None).cast("string").alias(c) for c in ("x", "y", "z")])
        out = x if out is None else out.unionByName(x)
    return out


@query("JOI_17", _ALL)
def pattern_joins(spark, d):
    return matches(spark, d)


@query("GRF_24", f"SELECT pattern, count(*) AS n FROM ({_ALL}) GROUP BY 1")
def golden_patterns(spark, d):
    return matches(spark, d).groupBy("pattern").agg(F.count("*").alias("n"))


@query("TOP_07", f"{_BASE} SELECT least(50, count(*)) AS n FROM ({_SQL['other_roles']})")
def limited(spark, d):
    """The statement's own limit."""
    nodes, edges = graph(spark, d)
    return P.run(STATEMENTS["other_roles"] + " LIMIT 50", nodes, edges).agg(F.count("*").alias("n"))


_Q = [
    "MATCH (a {ticker: 'abc'})-[r:SUPPLIES_TO|OWNS*1..4]->(b) WHERE r.status = 'active' RETURN b", "MATCH (s)-[:OWNS*2]->(b) WHERE s.ticker = $t RETURN b", "MATCH (a)-[r]->(b) WHERE r.valid_from <= '2024-02-03' RETURN b",
    "MATCH (a) SET a.x = 1", "RETURN 1", "MATCH (a)-[:X*..9]->(b) WHERE a.name = 'SET' RETURN a",
]


@query("GRF_01", """SELECT event_id, ['ABC', 'XYZ', NULL, NULL, NULL, NULL][k] AS root, [['SUPPLIES_TO', 'OWNS'], ['OWNS'], NULL, NULL, NULL, ['X']][k] AS relations, [4, 2, 1, 3, 3, 5][k] AS hops, [NULL, NULL, '2024-02-03', NULL, NULL, NULL][k] AS as_of,
['ACTIVE', NULL, 'ACTIVE_CURRENT', 'ACTIVE_CURRENT', 'ACTIVE_CURRENT', NULL][k] AS status, [true, true, true, false, true, true][k] AS read_only FROM (SELECT event_id, (1 + event_id % 6)::INT AS k FROM events)""")
def statement_parse(spark, d):
    """A statement for every event, parsed."""
    parsed = [P.subgraph(q, {"t": "xyz"}) for q in _Q]
    dim = spark.createDataFrame([(i, p.root, list(p.relations) if p.relations else None, p.hops, p.as_of, p.status, p.read_only) for i, p in enumerate(parsed)], "k long, root string, relations array<string>, hops int, as_of string, status string, read_only boolean")
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 6).alias("k")).join(F.broadcast(dim), "k").drop("k")  # six statements


@query("GRF_04", """SELECT triple_id, 1 AS hop FROM annotated_triples WHERE rel_type IN ('SUPPLIES_TO', 'COMPETES_WITH') AND upper(status) = 'ACTIVE_CURRENT' AND coalesce(valid_from <= '2023-06-30', true) AND coalesce(valid_to >= '2023-06-30', true)""")
def dispatch(spark, d):
    t = table(spark, d, "annotated_triples").withColumnsRenamed({"source_name": "source", "target_name": "target"}).select("triple_id", "source", "target", "rel_type", "status", "valid_from", "valid_to")
    return P.dispatched(t, "MATCH (a)-[r:SUPPLIES_TO|COMPETES_WITH]->(b) RETURN b", {"as_of_date": "2023-06-30"}).select("triple_id", "hop")
