from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from namelens.functions import normalize as N
from namelens.functions import similarity as S

VECTORS = [
    ("john", "john", 1.0), ("", "", 1.0), ("john", "", 0.0), ("abc", "xyz", 0.0), ("abcd", "abcdef", 0.9333), ("abcd", "abce", 0.8833), ("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("abc", "xabc", 0.9167),
    ("abcde", "abcdef", 0.9667), ("ab", "abc", 0.9111), ("js", "john smith", 0.76), ("abc", "axy", 0.6), ("abcxyz", "bcaxyz", 0.9444), ("иван", "ивам", 0.8833),
]


@pytest.mark.parametrize(("a", "b", "score"), VECTORS)
def test_jaro_winkler(a, b, score):
    assert S.jaro_winkler(a, b) == pytest.approx(score, abs=1e-4)


words = st.text(alphabet="abcжя ", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_pairs_are_as_single_ones(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert S.jaro_winkler_pairs(left, right).tolist() == pytest.approx([plain.jaro_winkler(a, b) for a, b in pairs])
    split = [(tuple(a.split()), tuple(b.split())) for a, b in pairs]
    assert S.token_match_pairs([a for a, _ in split], [b for _, b in split]).tolist() == pytest.approx([plain.token_match(list(a), list(b)) for a, b in split])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(words, words, st.sampled_from([0.3, 0.6, 0.8, 1.0])), min_size=1, max_size=8))
def test_bounds_lose_nothing(pairs):
    import numpy as np

    left, right, t = (np.array(x, object) for x in zip(*pairs))
    token, string = S.scored_pairs(left, right, t.astype(float))
    for i, (a, b, level) in enumerate(pairs):
        want = plain.token_match(a.split(), b.split())
        assert token[i] == pytest.approx(want) or (want < level and token[i] < level)
        if want < level <= plain.jaro_winkler(a, b):
            assert string[i] == pytest.approx(plain.jaro_winkler(a, b))


NAMES = [
    "John Smith", "  John   Smith  ", "Jöhn Smíth", "O'Brien", "Al-Sayed", "J. P. Smith", "Straße", "Café", "François", "Łukasz", "  MÜLLER  ", "café", "Привет", "שָׁלוֹם", "名前", "", "Юрий", "Юрій",
    "Володимир Зеленський", "Ivan Иванов", "Øyvind Đorđe", "がぎ", "한국", "İstanbul", "!@#$%", "a b c d", "Jean-Paul Sartre", "O’Neil & Sons", "JP Smith", "x y z", "é" * 300, None,
]


def test_variants(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, name string")
    both = N.with_variants(N.with_variants(df, "name", "v"), "name", "q", query=True).orderBy("i").collect()
    for r, name in zip(both, NAMES):
        assert [(x.text, x.label) for x in r.v] == plain.list_variants(name or ""), name
        assert [(x.text, x.label) for x in r.q] == plain.asked_variants(name or ""), name
    text = {n: [x.text for x in r.v] for r, n in zip(both, NAMES)}
    assert text["Юрий"] == ["юрии", "yurii", "iuryy"] and text["Ivan Иванов"] == ["ivan иванов", "ivanov", "yvanov"]
    asked = {n: [x.text for x in r.q] for r, n in zip(both, NAMES)}
    assert asked["O’Neil & Sons"] == ["o neil sons", "oneil sons", "o  Sons", "o’neil & sons"]


def test_expanded_names(spark):
    names = ["John Smith", " J.  Smith", "(Abc) Def", "3M Corp", "& X", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.x for r in df.select(N.expanded_name(F.col("name")).alias("x")).collect()]
    assert [g.split() for g in got] == [N.expand_initials("".join(plain.letters_of(n)), n).split() for n in names]
