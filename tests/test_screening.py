from __future__ import annotations

import json
import random

import pytest

import plain
from namelens.operators.screening import prepare_watchlist, screen, top_k

WATCHLIST = "id string, name string, aliases array<string>, nationality string, list_type string"
BASIC = [
    ("SDN-001", "Mohammed Al-Rashid", None, "SY", "OFAC"),
    ("SDN-002", "John Smith", None, "US", "OFAC"),
    ("SDN-003", "Viktor Ivanov", ["Viktor Ivanovich"], "RU", "OFAC"),
    ("SDN-004", "François Dupont", None, "FR", "EU"),
]


def found(spark, people, names, threshold=0.8, lists=None):
    watchlist = prepare_watchlist(spark.createDataFrame(people, WATCHLIST)).cache()
    inputs = spark.createDataFrame(list(enumerate(names)), "input_id long, name string")
    rows = screen(inputs, watchlist, threshold, lists).orderBy("input_id", "rank").collect()
    return [[(r.person_id, round(r.score, 6), r.match_type, r.explain.method if r.explain else None) for r in rows if r.input_id == i] for i in range(len(names))]


def one(entry, aliases=None):
    return [("X", entry, aliases, "", "OFAC")]


def test_basic_list(spark):
    got = found(spark, BASIC, ["John Smith", "Viktor Ivanovich", "Francois Dupont", "", "   ", "Smith John", "!@#$%"])
    assert got == [
        [("SDN-002", 1.0, "exact", "exact_primary")],
        [("SDN-003", 0.95, "alias", "exact_alias")],
        [("SDN-004", 1.0, "exact", "exact_primary")],
        [],
        [],
        [("SDN-002", 1.0, "fuzzy", "token")],
        [],
    ]
    assert found(spark, BASIC, ["Johnson Smith"], 0.7) == [[("SDN-002", 0.95, "fuzzy", "token")]]
    assert found(spark, BASIC, ["Viktor Ivanovich"], 1.0) == [[]]


PAIRS = [
    ("Владимир Путин", None, {"Vladimir Putin": (1.0, "fuzzy", "transliterated_exact")}),
    ("Vladimir Putin", None, {"Владимир Путин": (1.0, "fuzzy", "transliterated_exact")}),
    ("Юрий", None, {"Yuri": (0.95, "fuzzy", "token"), "Yuriy": (0.97, "fuzzy", "token")}),
    ("Александр", None, {"Alexander": (0.946296, "fuzzy", "token")}),
    ("John Paul Smith", None, {"John Smith": (0.933333, "fuzzy", "fuzzy"), "J. P. Smith": (0.9, "fuzzy", "token"), "JP Smith": (0.9, "fuzzy", "token")}),
    ("Vladimir Vladimirovich Putin", None, {"Vladimir Putin": (0.814286, "fuzzy", "fuzzy")}),
    ("John Smith", None, {"J. Smith": (0.925, "fuzzy", "token"), "Jane Smith": (0.883333, "fuzzy", "token"), "JS": None}),
    ("O'Brien", None, {"O Brien": (1.0, "exact", "exact_primary"), "OBrien": (1.0, "exact", "exact_primary")}),
    ("J. P. Smith", None, {"JP Smith": (1.0, "exact", "exact_primary")}),
    ("Łukasz Kowalski", None, {"Lukasz Kowalski": (1.0, "exact", "exact_primary")}),
    ("Li", None, {"Lo": None}),
    ("李明", None, {"Li Ming": None}),
    ("Αλέξανδρος", None, {"Владимир Путин": None}),
    ("", None, {"": (1.0, "exact", "exact_primary"), "John": None}),
    ("Владимир Путин", ["Vladimir Putin"], {"Vladimir Putin": (0.95, "alias", "exact_alias")}),
    ("Иван Иванов", None, {"И Иванов": (0.95, "fuzzy", "token")}),
    ("John Smith", ["John Smith"], {"John Smith": (1.0, "exact", "exact_primary")}),
]


def alone(spark, cases):
    """(entry name, aliases, query, threshold) cases, each entry in a list of its own."""
    people = [(f"P{i}", name, aliases, "", f"L{i}") for i, (name, aliases, _, _) in enumerate(cases)]
    inputs = spark.createDataFrame([(i, q, t, [f"L{i}"]) for i, (_, _, q, t) in enumerate(cases)], "input_id long, name string, threshold double, lists array<string>")
    rows = {r.input_id: r for r in screen(inputs, prepare_watchlist(spark.createDataFrame(people, WATCHLIST))).collect()}
    return [(round(r.score, 6), r.match_type, r.explain.method if r.explain else None) if (r := rows.get(i)) else None for i in range(len(cases))]


def test_pairs(spark):
    cases = [(entry, aliases, query, 0.8) for entry, aliases, asked in PAIRS for query in asked]
    assert alone(spark, cases) == [want for _, _, asked in PAIRS for want in asked.values()]


def test_low_thresholds(spark):
    got = alone(spark, [("John Paul Smith", None, "John Smith", 0.55), ("John Paul Smith", None, "John Smith", 0.5), ("Jan Adams", None, "ja", 0.3)])
    # the token score is taken where it reaches the threshold, though the string score is higher
    assert got == [(0.933333, "fuzzy", "fuzzy"), (0.516667, "fuzzy", "token"), (0.792593, "initial", None)]


def test_fallback_depends_on_the_whole_list(spark):
    assert found(spark, one("John Smith"), ["J. S."]) == [[("X", 0.875, "fuzzy", "token")]]
    two = one("John Smith") + [("Y", "J Doe", None, "", "EU")]
    assert found(spark, two, ["J. S."]) == [[]]
    assert found(spark, two, ["J. S."], lists=["OFAC"]) == [[("X", 0.875, "fuzzy", "token")]]


def test_same_name_in_two_lists_and_repeated_rows(spark):
    people = [("A", "John Smith", None, "", "OFAC"), ("B", "John Smith", None, "", "EU"), ("B", "John Smith", None, "", "EU")]
    assert [m[0] for m in found(spark, people, ["John Smith"])[0]] == ["A", "B", "B"]


def test_thresholds_and_lists_of_single_inputs(spark):
    watchlist = prepare_watchlist(spark.createDataFrame(BASIC, WATCHLIST))
    rows = [(1, "John Smith", None, None), (2, "John Smith", 1.5, None), (3, "John Smith", 0.0, None), (4, "John Smith", None, ["EU"]), (5, None, None, None), (1, "John Smith", None, [])]
    inputs = spark.createDataFrame(rows, "input_id long, name string, threshold double, lists array<string>")
    assert sorted(r.input_id for r in screen(inputs, watchlist).collect()) == [1, 1]
    assert top_k(screen(inputs, watchlist), 1).count() == 2


def test_bad_thresholds(spark):
    watchlist = prepare_watchlist(spark.createDataFrame(BASIC, WATCHLIST))
    inputs = spark.createDataFrame([(1, "John Smith")], "input_id long, name string")
    for bad in (0, -0.5, 1.5, float("nan")):
        with pytest.raises(ValueError, match="threshold"):
            screen(inputs, watchlist, bad)
    assert screen(inputs, watchlist, -0.5, strict=False).count() == 0


def test_empty_tables(spark):
    nobody = prepare_watchlist(spark.createDataFrame([], WATCHLIST))
    assert screen(spark.createDataFrame([(1, "John")], "input_id long, name string"), nobody).count() == 0
    assert screen(spark.createDataFrame([], "input_id long, name string"), prepare_watchlist(spark.createDataFrame(BASIC, WATCHLIST))).count() == 0


def test_against_plain_screening(spark):
    rng = random.Random(7)
    given = ["John", "Jon", "Юрий", "Jean-Paul", "J.", "Al", "O'Neil", "Zoë", "李", "Łukasz", "Ivan", "İbrahim", "x"]
    last = ["Smith", "Smyth", "Иванов", "Ivanov", "Al-Rashid", "Müller", "& Sons", "Paul", "de la Cruz", "", "Σοφός"]
    name = lambda: " ".join(rng.choice(rng.choice([given, last])) for _ in range(rng.randint(1, 3)))
    people = [(f"P{i:03}", name(), [name() for _ in range(rng.randint(0, 2))] or None, "", rng.choice(["OFAC", "EU"])) for i in range(60)]
    names = [name() for _ in range(50)] + ["", "  ", "JP Smith", "js", "!!"] + ["y" * 300 + " Smith"]
    cases = [(n, t) for t in (0.35, 0.5, 0.8) for n in names]
    inputs = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(cases)], "input_id long, name string, threshold double")
    got: dict[int, list] = {}
    for r in screen(inputs, prepare_watchlist(spark.createDataFrame(people, WATCHLIST))).collect():
        got.setdefault(r.input_id, []).append((r.person_id, round(r.score, 6), r.match_type, r.explain.method if r.explain else None))
    for i, (n, t) in enumerate(cases):
        want = [(p, round(s, 6), kind, method) for p, s, kind, method in plain.screen(n, people, t)]
        assert sorted(got.get(i, [])) == sorted(want), (n, t)


def test_request_counts(spark, tmp_path):
    from namelens.plans import catalogue

    stored = [(i, n, json.dumps(a) if a else None, "", c, t, "[]") for i, n, a, c, t in BASIC] + [("EU-005", "Jon Smith", None, "", "US", "EU", "[]")]
    spark.createDataFrame(stored, "id string, name string, aliases string, dob string, nationality string, list_type string, roles string").write.parquet(str(tmp_path / "sanctions_list.parquet"))
    names = ["John Smith", "Smith John", "Viktor Ivanovich", "Mohamed Al Rashid", "J. Smith", "Francois Dupont", "Nobody Else", ""]
    requests = [(i, n, None, None) for i, n in enumerate(names)] + [(20, "John Smith", 0.99, None), (21, "John Smith", 0.8, ["EU"])] * 2
    spark.createDataFrame(requests, "request_id long, name string, threshold double, lists array<string>").write.parquet(str(tmp_path / "screen_request.parquet"))
    people = [*BASIC, ("EU-005", "Jon Smith", None, "US", "EU")]
    want = {i: len(plain.screen(n, people, 0.8 if t is None else t, lists or ())) for i, n, t, lists in requests}
    got = {r.input_id: r["count"] for r in catalogue.request_counts(spark, str(tmp_path)).collect()}
    assert got == want and got[0] == 2 and got[1] == 2 and got[2] >= 1 and got[6] == 0
