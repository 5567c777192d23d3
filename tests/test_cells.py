"""Screening in cells: counts without rows, and the similarities on bit vectors."""

from __future__ import annotations

import random

import numpy as np
import pytest

from namelens.functions import similarity as S
from namelens.functions.cells import Candidates, Compared, Sieve, Spelt, Winkler
from namelens.operators import aggregates, screening
from namelens.session import cut_lineage

PEOPLE = "id string, name string, aliases array<string>, nationality string, list_type string"
INPUTS = "input_id long, name string, threshold double, lists array<string>"


def _texts(rng: random.Random, n: int) -> list[str]:
    letters = "abcd 01é李"
    return ["", "a", "é", "x" * 70, "abc " * 20] + list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 18))) for _ in range(n)} - {"", "a", "é"})


def test_bit_vectors_give_the_same_scores():
    rng = random.Random(5)
    left, right = _texts(rng, 80), _texts(rng, 90)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right))))
    got = Winkler(Spelt(left), Spelt(right)).scores(i, j)
    assert (got == S.jaro_winkler_pairs([left[x] for x in i], [right[x] for x in j])).all()
    compared = Compared(left, right)
    for t in (0.2, 0.6, 0.8, 0.95, 1.0):
        token, string = compared.scores(i, j, np.full(len(i), t))
        a, b = S.scored_pairs(np.array(left, object)[i], np.array(right, object)[j], np.full(len(i), t))
        reached = (a >= t) | (b >= t)
        assert (((token >= t) | (string >= t)) == reached).all()
        assert (token[a >= t] == a[a >= t]).all() and (string[(a < t) & (b >= t)] == b[(a < t) & (b >= t)]).all()


@pytest.fixture(scope="module")
def numbered(spark):
    """Names that all share one key, as those of suppliers do."""
    names = [(f"{k}", f"Supplier#{k * 37:09d}", ["Supplier One"] if k % 50 == 0 else None, "", ("EU", "UN")[k % 2]) for k in range(900)]
    return cut_lineage(screening.prepare_watchlist(spark.createDataFrame(names + names[:5], PEOPLE)))


def test_one_key_is_spread_over_tasks(spark, numbered):
    inputs = spark.createDataFrame([(k, f"Supplier#{k:09d}", 1.0, None) for k in range(900)], INPUTS)
    _, queries = screening._asked(inputs, None, None, True)
    cells = screening._grid(queries, numbered).where("listed").groupBy("cell").count().collect()
    assert len(cells) > 1 and sum(r["count"] for r in cells) == len(cells) * 900


def test_counts_are_those_of_the_rows(spark, numbered):
    asked = [("Supplier#000000037", 1.0, None), ("Supplier One", 0.9, ["EU"]), ("Supplier One", 1.0, None), ("supplier 37", 0.8, ["UN", "EU"]), ("S#000000074", 0.3, None), (None, 0.5, None), ("Owen", 0.6, None), ("x", 2.0, None)]
    inputs = spark.createDataFrame([(k % 7, *x) for k, x in enumerate(asked)], INPUTS)
    rows = aggregates.match_counts(inputs, screening.screen(inputs, numbered)).orderBy("input_id").collect()
    counts = aggregates.with_zeros(inputs, screening.counted(inputs, numbered)).orderBy("input_id").collect()
    assert counts == rows and sum(r["count"] for r in rows) > 900


def test_rows_are_ordered_once(spark, numbered):
    """The best match of a pair is chosen in its cell: the only window of the plan ranks the matches of a name."""
    inputs = spark.createDataFrame([(1, "Supplier One", 0.9, None)], INPUTS)
    plan = screening.screen(inputs, numbered)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("ArrowEvalPython") == 0


def test_sieve_finds_what_all_pairs_give():
    rng = random.Random(7)
    words = ["anna", "ana", "a", "b", "bello", "bell", "x" * 70, "ö", "李", "dvla", "vlad", "vladi"] + ["".join(rng.choice("abcdelv") for _ in range(rng.randint(2, 9))) for _ in range(30)]
    some = lambda n: list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)))
    left, right = some(60) + [""], sorted({*some(150), "", "y" * 200})
    compared = Compared(left, right)
    sieve = Sieve(compared)
    own = Candidates(sieve, np.arange(len(right)))
    for t in (0.05, 0.5, 0.8, 1.0):
        for x in range(len(left)):
            token, string = compared.scores(np.full(len(right), x), own.at, np.full(len(right), t))
            by_token = (token >= t) & (token > 0)
            want = np.flatnonzero((by_token | ((string >= t) & (string > 0))) & (compared.same_text[x] != own.at))
            places, score, kind = sieve.scores(x, t, own)
            assert places.tolist() == want.tolist() and (kind == by_token[want]).all()
            assert (score == np.where(by_token, token, string)[want]).all()


def test_matches_of_many_names_are_not_shuffled(spark, numbered, monkeypatch):
    """Where names alone make enough tasks, the rows are those of the window, and no exchange follows the cells."""
    asked = [("Supplier#000000037", 1.0, None), ("Supplier One", 0.9, ["EU"]), ("supplier 37", 0.8, ["UN", "EU"]), ("S#000000074", 0.3, None), (None, 0.5, None), ("Owen", 0.6, None), ("x", 2.0, None)]
    asked += [(f"Supplier#{k:09d}", 0.9, None) for k in range(60)]
    inputs = spark.createDataFrame([(k if k else None, *x) for k, x in enumerate(asked + asked[:3])], INPUTS)
    by_window = screening.screen(inputs, numbered)
    monkeypatch.setattr(screening, "_CELL_PAIRS", 1)
    monkeypatch.setattr(screening, "_LONG_CELL", 300)
    monkeypatch.setattr(screening, "_BATCH", 7)
    rows, brief = screening.screen(inputs, numbered), screening.screen(inputs, numbered, full=False)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Window" not in plan and "Exchange" not in above and "Sort" not in above
    key = lambda r: (r.input_id is not None, r.input_id, r.rank, repr(r))
    want = sorted(by_window.collect(), key=key)
    assert len(want) > 1000 and sorted(rows.collect(), key=key) == want and rows.dtypes == by_window.dtypes
    assert brief.drop("explain").exceptAll(by_window.drop("explain")).count() == 0 and brief.count() == len(want)


def test_entries_are_on_disk_once_for_many_names(spark, numbered, monkeypatch):
    """However many rows of names there are, what is shuffled are the names, and the entries are written once, for all calls."""
    asked = [(k, f"Supplier#{k * 37:09d}", 0.97, None if k % 3 else ["EU"]) for k in range(60)] + [(7, "Supplier One", 0.9, None), (None, "Owen", 0.6, None)]
    inputs = spark.createDataFrame(asked, INPUTS)
    counts, rows = screening.counted(inputs, numbered).collect(), screening.screen(inputs, numbered).drop("explain").collect()
    monkeypatch.setattr(screening, "_CELL_PAIRS", 1)
    monkeypatch.setattr(screening, "_LONG_CELL", 300)
    many, ranked = screening.counted(inputs, numbered), screening.screen(inputs, numbered, full=False).drop("explain")
    for df in (many, ranked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "sequence" not in plan and "person_id" not in plan[plan.index("MapInArrow") :].split("\n", 1)[1]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(many.collect(), key=key) == sorted(counts, key=key) and len(counts) > 50
    assert sorted(ranked.collect(), key=key) == sorted(rows, key=key)
    assert len(screening._FILES[numbered]) == 1
