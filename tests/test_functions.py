import json
import os

from pyspark.sql import functions as F

from quarry.functions import clauses as C, text as T
from quarry.operators import aggregates as A, curation as Q, predicates as P
from quarry.streaming import events as S


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(col(*[F.col(n) for n in names]).alias("x")).first().x


def test_text_functions_on_null_empty_and_odd(spark):
    assert one(spark, T.entity_key, "Acme Holdings, Inc.") == "acme" and one(spark, T.entity_key, "Inc") == "inc" and one(spark, T.entity_key, None) is None
    assert one(spark, T.company_key, "The Acme Co., Ltd.") == "acme" and one(spark, T.company_key, None) is None
    assert one(spark, T.initialism, "Bank of the North") == "BN" and one(spark, T.initialism, "Bank") == ""
    assert one(spark, T.normal_date, " 2024-01-02T00:00 ") == "2024-01-02" and one(spark, T.normal_date, "NaN") is None
    assert one(spark, T.is_stub, None) is True and one(spark, T.token_estimate, "") == 0
    assert one(spark, T.padded_cik, "12345678901") == "12345678901" and one(spark, T.padded_cik, "7") == "0000000007"


def test_placeholders(spark):
    yes = ("Customer A", "our largest supplier", "the company", "they", "Unnamed party")
    no = ("IT", "Acme Corp", "a supplier of Acme Corp", "", None)
    assert all(one(spark, P.is_placeholder, v) for v in yes) and not any(one(spark, P.is_placeholder, v) for v in no)


def test_clauses_negation_and_polarity(spark):
    assert one(spark, C.clauses, "Acme Inc. grew, but sales fell; it stopped.") == ["Acme Inc. grew", "sales fell", "it stopped."]
    assert one(spark, C.polarity, "The firm avoided bankruptcy.") == "NEUTRAL_STABLE"
    assert one(spark, C.polarity, "The firm did not expand, and a rival faced bankruptcy.") == "DISRUPTIVE_SHOCK"
    assert abs(one(spark, C.jaro_winkler, "MARTHA", "MARHTA") - 0.9611) < 1e-4 and one(spark, C.jaro_winkler, "", "x") == 0


def test_cartography_golden(spark):
    rows = [("e", i, p, True) for i, p in enumerate((0.80, 0.85, 0.90))] + [("a", i, p, c) for i, (p, c) in enumerate(((0.3, False), (0.9, True), (0.4, False)))] + [("h", i, p, False) for i, p in enumerate((0.05, 0.08, 0.05))]
    got = {r.g: r for r in A.coordinates(spark.createDataFrame(rows, "g string, e int, p double, c boolean"), "g", ["e"], "p", "c").collect()}
    assert [(got[k].region, got[k].forgetfulness) for k in "eah"] == [("easy", 0), ("ambiguous", 1), ("hard", 999)]


def test_duplicate_classes_copies_and_blank(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t), (2, t), (3, t.replace("w30", "other")), (4, "nothing alike here at all today"), (5, ""), (6, None)]
    classes, links = Q.duplicate_links(spark.createDataFrame(rows, "id long, text string"), "id", "text", 0.8)
    assert {(r.id, r.cls, r.n) for r in classes.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)}
    assert [(r.a, r.b) for r in links.collect()] == [(1, 3)]


def test_coreset_and_nearest_ties(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.9]), (4, [0.0, 0.0])]
    e = spark.createDataFrame(v, "id long, v array<float>")
    assert {r.id for r in Q.coreset(e, "id", "v", 2).collect()} == {0, 2}
    assert [(r.query, r.id) for r in Q.nearest(e.where("id = 0"), e, "id", "v", 2).orderBy("query", "similarity").collect()][-1] == (0, 1)


def test_routes(spark):
    ok = {"raw_payload": "{}", "fetched_at": "t", "source_hash": "h"}
    rows = [json.dumps(ok), "{oops", None, json.dumps({"raw_payload": "x"}), json.dumps({**ok, "raw_payload": " "})]
    df = S.routed(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string"))
    assert [r.route for r in df.orderBy("i").collect()] == ["processed", "dlt_malformed", "dlt_malformed", "dlt_missing_fields", "skipped_empty"]


def test_write_once_is_replay_safe(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    for i in range(2):
        df.write.mode("append").parquet(src)
        q = S.write_once(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "ck"), "k")
        q.awaitTermination()
        assert spark.read.parquet(out).count() == 2


def test_names_of_any_prefix_are_compared(spark, tmp_path):
    from quarry.plans.catalogue import QUERIES

    rows = [("Acme Corp",), ("Bcme Corp",), ("Zenith Holdings",), ("Acme Corp",)]
    spark.createDataFrame(rows, "company_name string").write.parquet(str(tmp_path / "sp500_constituents.parquet"))
    assert [tuple(r) for r in QUERIES["SCA_05_all"](spark, str(tmp_path)).collect()] == [("Acme Corp", "Bcme Corp", 1)]
    assert [tuple(r)[:2] for r in QUERIES["SCA_04_all"](spark, str(tmp_path)).collect()] == [("Acme Corp", "Bcme Corp")]
    assert {tuple(r)[:2] for r in QUERIES["SCA_06_all"](spark, str(tmp_path)).collect()} == {("Acme Corp", "Bcme Corp"), ("Acme Corp", "Zenith Holdings"), ("Bcme Corp", "Zenith Holdings")}


def test_documents_of_any_label_are_compared(spark, tmp_path):
    import hashlib
    import random
    import re

    from quarry.plans.catalogue import QUERIES

    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(200)] + ["ärger", "новости", "株式"]
    base = [[rng.choice(vocab) for _ in range(80)] for _ in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:78] + ["new", "end"]) for w in base] + [" ".join(base[0]).upper(), "two words", "", None]
    langs = ["en", "EN", "eng", "de", None, "ru"]
    rows = [(i, t, langs[i % 6] if i < 6 else langs[(i + 1) % 6], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    def hashes(t):
        w = re.findall(r"\w+", (t or "").lower())
        g = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
        return frozenset(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in g)

    sets = {i: hashes(t) for i, t, _, _ in rows if hashes(t)}
    least = {}
    for i, h in sets.items():
        least.setdefault(h, i)
    cls = sorted(least.values())
    links = {(a, b) for a in cls for b in cls if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    assert {(r.doc_id, r.n, r.least) for r in QUERIES["CUR_01_all"](spark, str(tmp_path)).collect()} == {(i, len(h), f"{min(h):08x}") for i, h in sets.items()}
    assert len(links) == 6 and {(r.a, r.b) for r in QUERIES["CUR_03_all"](spark, str(tmp_path)).collect()} == links
    assert {(r.doc_id, r.cls) for r in QUERIES["CUR_03_classes_all"](spark, str(tmp_path)).collect()} == {(i, least[h]) for i, h in sets.items()}
    assert len(QUERIES["CUR_03_kept_all"](spark, str(tmp_path)).collect()) == len(cls) - len(links)


def test_the_entry_loads_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 200)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("True"), done.stderr[-500:]
