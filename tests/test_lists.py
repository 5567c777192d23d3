"""Snapshots, feeds, readers, the store and the services over it."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from namelens import cli
from namelens.operators import aggregates, drift
from namelens.operators.screening import prepare_watchlist, screen
from namelens.operators.snapshots import diff_snapshots
from namelens.server import Service
from namelens.sources import loaders
from namelens.sources.store import WatchlistStore
from namelens.streaming.screen import screen_stream

ROW = "snapshot_no int, row_no long, id string, name string, aliases string, dob string, nationality string, list_type string, roles string"


def changes(spark, rows, **more):
    return sorted((r.snapshot_no, r.id, r.change_kind) for r in diff_snapshots(spark.createDataFrame(rows, ROW), **more).collect())


def row(no, n, key, **own):
    base = {"name": "A", "aliases": None, "dob": None, "nationality": "X", "list_type": "EU", "roles": '["P"]'} | own
    return (no, n, key, *base.values())


def test_snapshot_rules(spark):
    rows = [
        row(1, 1, " a1 "), row(2, 1, "A1", aliases="[]", dob="", roles='[ "P" ]'), row(3, 1, "a1", name="B"),  # notation, then a change
        row(1, 2, "b"), row(2, 2, "b", list_type="UN"),  # a move; UN is not delivered again
        row(1, 3, "c"), row(3, 3, "C"),  # gone and back
        row(1, 4, "d", name="old"), row(1, 9, "d", name="new"), row(2, 4, "d", name="new"), row(2, 4, "d", name="new"), row(3, 4, "d", name="new"),
        row(1, 5, "e", aliases='["x","y"]'), row(2, 5, "e", aliases='["y", "x"]'), row(3, 5, "e", aliases='["y"]'),
        row(2, 6, None), row(2, 7, "  "),
    ]
    assert changes(spark, rows) == [(2, "B", "changed"), (2, "C", "removed"), (3, "A1", "changed"), (3, "C", "added"), (3, "E", "changed")]


def test_snapshots_without_rows(spark):
    assert changes(spark, []) == []
    assert changes(spark, [row(1, 1, "a")]) == []


def test_snapshots_against_sets(spark):
    rng = random.Random(3)
    rows, want, before = [], [], {}
    for no in range(1, 6):
        now = {}
        for k in range(400):
            if rng.random() < 0.8:
                now[f"K{k}"] = ("AB"[rng.random() < 0.05], "EU")
        rows += [row(no, i, key, name=name) for i, (key, (name, _)) in enumerate(rng.sample(sorted(now.items()), len(now)))]
        if no > 1:
            want += [(no, k, "added" if k not in before else "removed" if k not in now else "changed") for k in before.keys() | now.keys() if before.get(k) != now.get(k)]
        before = now
    for chunk in (1, 16, 10_000):
        assert changes(spark, rows, chunk_keys=chunk) == sorted(want)


FILES = "feed_id long, file_seq int, file_name string, file_format string, default_list string, declared_rows int, delivered_at timestamp"
RECORDS = "file_name string, line_no int, raw_line string"


def feed(spark, files):
    import datetime as dt

    rows = [(1, seq, name, "json", "EU", None, dt.datetime(2024, 1, seq)) for seq, name, _ in files]
    lines = [(name, i, x if isinstance(x, str) or x is None else json.dumps(x)) for _, name, recs in files for i, x in enumerate(recs)]
    codes = spark.createDataFrame([(101, "AA-X", "", ""), (102, "BB-Y", "", "")], "program_no int, program_code string, authority string, title string")
    return spark.createDataFrame(rows + rows[:1], FILES), spark.createDataFrame(lines, RECORDS), codes


def test_schema_drift(spark):
    first = [{"id": str(i), "name": f"N{i}", "programs": ["AA-X"] if i % 2 else ["AA-X", "BB-Y"], "list": "EU", "old": i} for i in range(10)]
    second = [{"id": str(i), "name": f"N{i}", "measures": [101] if i % 2 else [101, 102], "list": 2, "new": "x"} for i in range(10)]
    second[3] = {"ID": "3", "name": "N3", "MEASURES": "AA-X", "list": None}
    data = feed(spark, [(1, "f1", [*first, None, "", "{broken", "[1]", first[0]]), (3, "f3", second), (4, "f4", second)])
    got = sorted((r.file_name, r.field_path, r.change_kind) for r in drift.found_changes(drift.schema_changes(*data)).collect())
    assert got == [("f3", "list", "retyped"), ("f3", "new", "added"), ("f3", "old", "removed"), ("f3", "programs", "renamed"), ("f3", "programs", "retyped")]
    table = {(r.file_name, r.line_no): r for r in drift.consistent_records(*data).collect()}
    assert len(table) == 11 + 10 + 10
    assert table["f3", 2].programs == ["AA-X", "BB-Y"] and table["f3", 2]["list"] == "EU" and table["f3", 3].programs == ["AA-X"]
    versions = [r.version for r in drift.schema_versions(*data[:2]).orderBy("file_seq").collect()]
    assert versions == [1, 2, 2]


def test_feeds_without_rows(spark):
    files, records, codes = feed(spark, [(1, "f1", [{"id": "1"}])])
    assert drift.schema_changes(files.limit(0), records.limit(0), codes).count() == 0
    assert drift.consistent_records(files, records.limit(0), codes.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,nationality\nS-1, Mohammed Al-Rashid ,SY\nS-2,"Li, Wei",CN\n')
    rows = loaders.load_watchlist(spark, str(tmp_path / "a.csv"), "csv", "UN").orderBy("id").collect()
    assert [(r.id, r.name, r.list_type, r.aliases) for r in rows] == [("S-1", "Mohammed Al-Rashid", "OFAC", []), ("S-2", "Li, Wei", "OFAC", [])]
    (tmp_path / "a.json").write_text('[{"id":"1","name":"X","list":"OFAC","programs":"P"},\n{"id":"2","name":"Y","aliases":["Z"],"programs":["P","Q"]}]')
    rows = loaders.load_watchlist(spark, str(tmp_path / "a.json"), "jsonl", "UN").orderBy("id").collect()
    assert [(r.list_type, r.roles, r.aliases) for r in rows] == [("OFAC", ["P"], []), ("UN", ["P", "Q"], ["Z"])]
    entity = lambda schema, **props: json.dumps({"id": "e", "schema": schema, "properties": props})
    text = [entity("Person", name=["A"], alias=["", "B"], country=["ru"], birthDate=["1960-01-02"], programId=["P"]), "", "   ", entity("Company", name=["C"]), "garbage", entity("Organization", name=["D"], birthDate=["1960"])]
    (tmp_path / "a.jsonl").write_text("\n".join([*text, entity("Person", name="scalar"), entity("Person", name=[])]))
    rows = loaders.load_watchlist(spark, str(tmp_path / "a.jsonl"), "jsonl", "UN").orderBy("name").collect()
    assert [(r.name, r.aliases, r.nationality, str(r.dob), r.roles) for r in rows] == [("A", ["B"], "RU", "1960-01-02", ["P", "individual"]), ("D", [], "unknown", "None", ["entity"])]
    (tmp_path / "empty.json").write_text("  \n ")
    with pytest.raises(ValueError, match="empty"):
        loaders.load_watchlist(spark, str(tmp_path / "empty.json"), "json")
    with pytest.raises(ValueError, match="unsupported format"):
        loaders.load_watchlist(spark, "x", "xml")
    (tmp_path / "names.csv").write_text(" Full_Name ,x\nJohn Smith,1\nname,2\n")
    assert [r.name for r in loaders.read_names(spark, str(tmp_path / "names.csv")).orderBy("input_id").collect()] == ["John Smith", "name"]


PEOPLE = "id string, name string, aliases array<string>, dob date, nationality string, list_type string, roles array<string>"


def people(spark, *rows):
    return spark.createDataFrame([(i, n, [], None, "", lt, []) for i, n, lt in rows], PEOPLE)


def test_store_and_services(spark, tmp_path):
    store = WatchlistStore(spark, str(tmp_path / "store"))
    assert store.load(["OFAC"]).count() == 0
    assert store.replace(people(spark, ("1", "John Smith", "OFAC"), ("2", "B", "OFAC"), ("3", "C", "OFAC"), ("9", "Jane Smith", "EU"))) == 4
    assert store.replace(people(spark, ("1", "John Smith", "OFAC"), ("2", "B", "OFAC"), ("2", "B2", "OFAC"))) == 3
    assert store.replace(people(spark)) == 0
    ids = lambda: sorted((r.id, r.name, r.list_type) for r in store.people().collect())
    assert ids() == [("1", "John Smith", "OFAC"), ("2", "B2", "OFAC"), ("9", "Jane Smith", "EU")]
    store.replace(people(spark, ("2", "B2", "UN")))
    assert ids() == [("1", "John Smith", "OFAC"), ("2", "B2", "UN"), ("9", "Jane Smith", "EU")]
    assert {r["list"]: r["count"] for r in store.counts(["OFAC", "EU", "UN", "NONE"]).collect()} == {"OFAC": 1, "EU": 1, "UN": 1, "NONE": 0}
    service = Service(spark, str(tmp_path / "store"))
    status, answer = service.answer("POST", "/api/v1/screen", {"name": "John Smith", "lists": []})
    assert status == 200 and [m["person_id"] for m in answer["matches"]] == ["1", "9"] and set(answer) == {"matches", "input_name", "count", "screening_time_ms"}
    status, answer = service.answer("POST", "/api/v1/screen/batch", {"names": ["B2", "", "B2"], "lists": ["UN", "NONE"]})
    assert status == 200 and [r["count"] for r in answer["results"]] == [1, 0, 1] and answer["total_matches"] == 2
    assert service.answer("POST", "/api/v1/screen", {"name": "x", "threshold": 0})[0] == 400
    assert service.answer("POST", "/api/v1/screen", {"name": ""})[0] == 400
    assert service.answer("GET", "/api/v1/health", None) == (200, {"status": "ok"})
    assert service.answer("GET", "/api/v1/lists/NONE/count", None) == (200, {"list": "NONE", "count": 0})
    names = spark.createDataFrame([(0, "John Smith")], "input_id long, name string")
    found = cli.screened(spark, str(tmp_path / "store"), names, 0.8, ["OFAC"]).collect()
    assert cli.lines(found, True, 0.8, 1)[0] == "[1.00] John Smith (exact) — OFAC"
    assert cli.main(["version"]) == 0


def test_counts_and_stream(spark, tmp_path):
    watchlist = prepare_watchlist(people(spark, ("1", "John Smith", "OFAC"), ("2", "Jon Smith", "EU")).select("id", "name", "aliases", "nationality", "list_type")).cache()
    inputs = spark.createDataFrame([(0, "John Smith"), (1, "Nobody Else"), (2, "John Smith")], "input_id long, name string")
    found = screen(inputs, watchlist)
    assert {r.input_id: r["count"] for r in aggregates.match_counts(inputs, found).collect()} == {0: 2, 1: 0, 2: 2}
    assert aggregates.total_matches(found).first().total_matches == 4
    inputs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("input_id long, name string").parquet(str(tmp_path / "in"))
    query = screen_stream(stream, watchlist, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select(F.countDistinct("input_id")).first()[0] == 2
