"""Small tests: filings, statements, patterns, resolution, ranks, training sets; nulls, blanks, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from quarry.core.ranks import ranked
from quarry.functions import clauses as C, filings as L, statements as S
from quarry.operators import curation as Q, patterns as P, resolution as R, training as T
from quarry.sources import files as FS, tasks


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]


def test_negation_is_looked_for_before_each_hit(spark):
    f = lambda c: C.has_unnegated(c, r"defaulted")
    far = "It was not the case in any of the many years that the board had been looking into it yet it never defaulted"
    assert not one(spark, "string", far, f) and one(spark, "string", "It never slept " + "x" * 80 + " and defaulted", f)
    assert one(spark, "string", "not defaulted; later it defaulted", f) and not one(spark, "string", None, f)


def test_head_word_of_an_entity_names_a_clause(spark):
    df = spark.createDataFrame([("Acme might sell the plant; others wait", ["Acme Robotics Inc"]), ("Acmex might sell; others wait", ["Acme Robotics Inc"]), (None, ["Acme"])], "p string, e array<string>")
    assert [r.h for r in df.select(C.triple_hedged(F.col("p"), F.col("e"), F.lit("OWNS")).alias("h")).collect()] == [True, False, False]


def test_sanitised_text_and_items(spark):
    t = "Commission File Number 1\n\nA fire broke out.\nForward-looking statements: none.\n\nSIGNATURES\n\nPursuant to the requirements of the Securities Exchange Act of 1934 x"
    s = one(spark, "string", t, L.sanitized)
    assert s["text"] == "A fire broke out." and s["stripped"] == 4
    assert one(spark, "string", None, L.sanitized)["text"] == ""
    assert one(spark, "array<string>", ["Item 9.01", "2.04", "item 1.05"], L.primary_item) == "Item 1.05" and one(spark, "array<string>", [], L.primary_item) == "Item 8.01"
    assert one(spark, "string", "Item 9.01", L.item_tier) == 4 and one(spark, "string", None, L.item_tier) == 2


def test_chunks_stay_under_the_budget_and_overlap():
    paragraphs = [f"Paragraph {i} " + "word " * 60 for i in range(12)]
    chunks = L.packed(paragraphs, 300, 120)
    assert all(L.estimate(c) <= 300 + 120 for c in chunks)
    assert [p for p in paragraphs if not any(p in c for c in chunks)] == []
    assert all(a.split("\n\n")[-1] == b.split("\n\n")[0] for a, b in zip(chunks, chunks[1:]))
    assert L.packed([], 10, 5) == [] and L.packed(["w " * 500, "b"], 100, 20) == ["w " * 500, "b"]
    assert L.sections_of("no heading") == [("General Disclosure", 0, 10)]


def test_guard_and_rewrite(spark):
    assert one(spark, "string", "MATCH (a) WHERE a.name = 'CREATE' RETURN a.name // DROP", S.guard) == "OK"
    assert one(spark, "string", "  ", S.guard) == "EMPTY_QUERY" and one(spark, "string", "match (a) delete a", S.guard) == "MUTATING_KEYWORD"
    assert one(spark, "string", "MATCH (a)-[:OWNS]->(b)", lambda c: S.as_of(c, "2024-01-01")).startswith("MATCH (a)-[r:OWNS]->(b) WHERE coalesce(r.status")
    assert one(spark, "string", "(none)", S.as_of) == "(none)"
    assert S.triples_of(None) == [] and S.triples_of('(a {name: "x)"})-[:OWNS]->(b)') == [("x)", "OWNS", "", "")]


def test_statements_over_a_small_graph(spark):
    nodes = spark.createDataFrame([("a", "C", "A"), ("b", "C", None), ("c", "P", None)], "id string, label string, ticker string")
    edges = spark.createDataFrame([(1, "a", "b", "X"), (2, "b", "c", "Y"), (3, "c", "a", "X")], "edge long, source string, target string, rel_type string")
    rows = lambda s: sorted(tuple(r) for r in P.run(s, nodes, edges).collect())
    assert rows("MATCH (x:C)-[:X]->(y:C) RETURN x, y.id AS z") == [("a", "b")]
    assert rows("MATCH (x {ticker: 'A'})-[:X|Y*1..2]-(y) RETURN DISTINCT y") == [("b",), ("c",)]  # no relation twice, so not back to a
    assert rows("MATCH (x)<-[:X]-(y) WHERE x.id =~ '(?i)A' RETURN y") == [("c",)]
    for bad in ("MATCH (x) DELETE x RETURN x",):
        with pytest.raises(PermissionError):
            P.run(bad, nodes, edges)
    with pytest.raises(ValueError):
        P.run("MATCH (x), (y) RETURN x", nodes, edges)


def test_resolution_rules_and_vetoes(spark):
    rows = [
        ("Apple Inc.", "Company", "AAPL", None), ("apple", "Company", None, None), ("Aple Inc", "Company", None, None), ("Apple Inc", "Company", "XXXX", None),
        ("IBM", "Company", None, None), ("International Business Machines", "Company", None, None), ("Big Iron Gates", "Person", None, None), ("BIG", "Person", None, None), (None, "Company", None, None),
    ]
    n = spark.createDataFrame(rows, "id string, label string, ticker string, cik string")
    got = {(r.a, r.b) for r in R.links(n).collect()}
    assert ("Apple Inc.", "apple") in got and ("Aple Inc", "Apple Inc.") in got and ("Apple Inc", "Apple Inc.") not in got
    assert ("IBM", "International Business Machines") in got and ("BIG", "Big Iron Gates") not in got
    best = {r.id: r.canonical for r in R.resolved(n, R.links(n)).collect()}
    assert best["IBM"] == "International Business Machines" and best["Big Iron Gates"] == "Big Iron Gates"
    assert R.links(n.limit(0)).count() == 0


def test_ranks_with_a_hot_group_ties_and_nulls(spark):
    rows = [("hot" if i % 3 else None, i % 7, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = {(r.k, r.id): (r["_rank"], r["_size"]) for r in ranked(df, ["k"], ["o", "id"], 9).collect()}
    for key in ("hot", None):
        mine = sorted((o, i) for k, o, i in rows if k == key)
        assert all(got[key, i] == (n, len(mine)) for n, (_, i) in enumerate(mine))
    assert ranked(df.limit(0), ["k"], ["o", "id"]).count() == 0


def test_coreset_of_most_rows_keeps_tasks_bounded(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)], "id long, v array<double>")
    picked = [r.id for r in Q.coreset(df, "id", "v", 96, block=30).collect()]
    assert len(picked) == len(set(picked)) == 96


def test_semantic_groups_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 6))
    v[5], v[9] = v[4] * 2, 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b) for r in Q.similar_vectors(df, "id", "v", 0.8, block=13).collect()}
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8} and (4, 5) in got
    assert sum(r.kept for r in Q.semantic_groups(df, "id", "v", 0.8).where("id in (4, 5)").collect()) <= 1


def test_training_helpers(spark):
    rows = spark.createDataFrame([(1, "Acme buys steel", "Acme", "C"), (2, "Bolt buys steel", "Bolt", "C"), (3, "Acme buys steel", "Acme", "C")], "id long, text string, name string, kind string")
    swapped = T.swapped(rows, "id", "text", "name", rows.select(F.col("name").alias("entity"), "kind"), "kind", 4).collect()
    assert {r.text for r in swapped} <= {"Acme buys steel", "Bolt buys steel"} and len({r.text for r in swapped}) == len(swapped)
    assert T.steered({"a": 100}, {"a": True, "b": False}) == {"a": 150, "b": 200}
    assert one(spark, "string", "go a b c d a b c d a b c d a b c d end", T.truncated_runaway) == "go a b c d" and one(spark, "string", None, T.truncated_runaway) is None
    known = spark.createDataFrame([("Acme", "Bolt")], "a string, b string")
    assert T.template_negatives(rows.select(F.col("name").alias("entity")), known, "{a} {b}", 5).count() == 0


def test_tasks_fail_alone_and_vectors_fall_back(spark):
    tasks.ingest_task("fails")(lambda s, d: 1 / 0)
    tasks.ingest_task("works")(lambda s, d: 7)
    try:
        got = {n: (r, e) for n, r, e in tasks.run_tasks(spark, "", ["fails", "works"])}
    finally:
        tasks.TASKS.pop("fails"), tasks.TASKS.pop("works")
    assert got["works"] == (7, None) and got["fails"][1].startswith("ZeroDivisionError")
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [round(sum(x * x for x in r.v), 6) for r in tasks.embedded(df, "t", "v").collect()] == [1.0, 0.0, 0.0]
    assert all(not any(r.v) for r in tasks.embedded(df, "t", "v", model=lambda t: [1.0]).collect())


def test_workspace_refuses_foreign_folders(spark):
    with pytest.raises(PermissionError):
        FS.workspace(spark, "/etc", ("/srv/work",))
