import json

import pytest

from quarry.sources import files as R, sinks as S


def test_snapshot_round_trip_and_precedence(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "Company", "abc", None, "{}")], R.NODES)
    edges = spark.createDataFrame([("n1", "n2", None, "h", '{"rel_type": "OWNS", "source_hash": "j", "share": "0.5"}'), (None, "n1", "X", "h", '{"source": "n9"}'), ("n3", "n1", "", "h", "{broken")], R.EDGES)
    S.write_snapshot(nodes, edges, str(tmp_path))
    got = {(r.source, r.target): (r.rel_type, r.source_hash, r.share) for r in R.snapshot(spark, str(tmp_path)).collect()}
    assert got == {("ABC", "N2"): ("OWNS", "j", 0.5), ("N9", "ABC"): ("X", "h", None), ("N3", "ABC"): ("SUPPLIES_TO", "h", None)}
    with pytest.raises(FileNotFoundError):
        R.snapshot(spark, str(tmp_path / "none"))


def test_manifest_shapes(spark, tmp_path):
    e = {"source": "a", "target": "b"}
    (tmp_path / "l.jsonl").write_text(json.dumps(e) + "\n" + json.dumps(e))
    (tmp_path / "a.json").write_text(json.dumps([e]))
    (tmp_path / "o.json").write_text(json.dumps({"edges": [e, e, e]}))
    assert [R.edge_manifest(spark, str(tmp_path / n)).where("source = 'a'").count() for n in ("l.jsonl", "a.json", "o.json")] == [2, 1, 3]
    with pytest.raises(ValueError):
        R.edge_manifest(spark, "x.csv")


def test_strict_and_lenient_lines(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"sample_id": "s", "epoch": 1}\n{"epoch": 2}\n')
    assert [(r.guid, r.epoch, r.seq_prob) for r in R.dynamics(spark, str(tmp_path / "d.jsonl")).collect()] == [("s", 1, 0.0)]
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        R.dynamics(spark, str(tmp_path / "bad.jsonl")).collect()
    logs = tmp_path / "logs"
    logs.mkdir()
    for day in ("20240101", "20240103"):
        (logs / f"rejections_{day}.jsonl").write_text('{"task_id": "%s", "timestamp": "%s-%s-%sT10:00"}\n{oops\n' % (day, day[:4], day[4:6], day[6:]))
    schema = "task_id string, timestamp string"
    assert R.daily_logs(spark, str(logs), schema).count() == 2
    assert [r.task_id for r in R.daily_logs(spark, str(logs), schema, "2024-01-02").collect()] == ["20240103"]
    assert R.daily_logs(spark, str(logs), schema, "2024-01-03T11:00").count() == 0 and R.daily_logs(spark, str(tmp_path / "no"), schema).count() == 0


def test_insert_upsert_overlay_cursor(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 4)], "k string, v int")
    assert S.insert_or_ignore(rows, p, "k", ["v"]) == 2 and S.insert_or_ignore(rows, p, "k", ["v"]) == 0
    assert {tuple(r) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 4)}
    up = S.upserted(rows.where("k = 'b'"), spark.createDataFrame([("b", 4), ("c", 1)], "k string, v int"), "k", "v")
    assert {tuple(r) for r in up.collect()} == {("b", 4), ("c", 1)}
    m = "k string, p map<string,string>"
    o = S.overlaid(spark.createDataFrame([("a", {"x": "1", "y": "1"}), ("b", None)], m), spark.createDataFrame([("a", {"y": "2"}), ("c", {"z": "3"})], m), "k", "p")
    assert {r.k: r.p for r in o.collect()} == {"a": {"x": "1", "y": "2"}, "b": {}, "c": {"z": "3"}}
    c = str(tmp_path / "cursor")
    assert S.load_cursor(spark, c) is None
    S.save_cursor(spark, c, "2024-01-01")
    assert S.load_cursor(spark, c) == "2024-01-01"
