"""Look-alike characters, encoding, packing and cut-off texts."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namelens.llm import bpe, packing, truncation
from namelens.llm.lookalikes import unusual_values, usual_form, usual_forms

PEOPLE = "id string, name string, aliases string, dob string, nationality string, list_type string, roles string"


@pytest.mark.parametrize(
    ("value", "form"),
    [
        ("Nаsser", "Nasser"), ("ЈЅС Trade", "JSC Trade"), ("Ｈａｊｉ", "Haji"), ("Förk", "Förk"), ("A B", "A B"), ("A​B", "AB"), ("Sսnɡ", "Sung"),
        ("\U0001d401\U0001d41e\U0001d427 X", "Ben X"), ("Inveﬆment", "Investment"), ("Al‐X", "Al-X"), ("Maксим", "Максим"), ("Tab\tName", "Tab Name"),
    ],
)
def test_unusual(value, form):
    got, unusual = usual_form(value)
    assert unusual and (form is None or got == form)
    assert usual_form(got)[1] is False


@pytest.mark.parametrize("value", ["", "John  Smith", "Łucja Grékigrölez", "Людмила Лунмазеков", "М. Собицаров", "А. П. Фаллефелич", "Игор Zasakunenkov", "王海峰", "しみず まこと", "김철민", "דוד לוין", "محمد الراوي", "Νικόλαος Βρετάκης", "A.Ş. İbrahim ı"])
def test_usual(value):
    assert usual_form(value) == (value.strip(), False)


@pytest.mark.parametrize("value", ["ꓡisa", "ⲟmar", "ᗪavid", "Yamaᚠ"])
def test_mixed_words_are_unusual_in_any_script(value):
    assert usual_form(value)[1]


def test_values_of_rows(spark):
    rows = [("1", "Nаsser", '["ok", "A\\u00a0B", null]', "", "", "", ""), ("2", None, "null", None, None, None, None), ("3", "", "{broken", "", "", "", ""), ("3", "x" * 20_000 + "​", None, "", "", "", "")]
    people = spark.createDataFrame(rows, PEOPLE).withColumn("value", F.lit(1)).withColumn("alias_index", F.lit(2))
    assert sorted(map(tuple, unusual_values(people).collect())) == [("1", -1), ("1", 1), ("3", -1)]
    forms = {(r.id, r.alias_index, r.unusual): r.form for r in usual_forms(people).collect()}
    assert forms["1", 1, True] == "A B" and forms["1", 0, False] == "ok" and forms["3", -1, True] == "x" * 20_000
    assert unusual_values(people.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Encoder(f.read())


parts = st.lists(st.sampled_from(["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Bc", "é", "1", "٣", "<|endoftext|>", ".", "—", "你", "　", "\xa0", "́", "😀", "'t", "d", "\x1c", "​", "\x85"]), max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, min_size=1, max_size=5))
def test_encoding_equals_the_library(library, encoder, texts):
    got = []
    for a, b, ids, counts in encoder.encode(texts):
        at = 0
        for n in counts:
            got.append(ids[at : at + n].tolist())
            at += n
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encoding_of_tables(spark, library):
    texts = [None, "", "Hello world", "it's " * 3000, "a" * 9000, "\n\n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    with open(bpe.VOCABULARY, "rb") as f:
        vocabulary = f.read()
    rows = bpe.encode(docs, offsets=True).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert r.ids == library.encode(t or "", add_special_tokens=False).ids
        assert bpe.decode(r.ids, vocabulary) == (t or "") and len(r.starts) == len(r.ids) and r.starts[:1] == [0][: len(r.ids)]
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in rows}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 7, 40, 90, 250, None])) for i in range(3000)] + [(0, 40)]
    items = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(40)
    limits = spark.createDataFrame([("s", 100), ("m", 300), ("m", 300), ("bad", 0)], "limit_name string, capacity_tokens int")
    got = packing.pack(items, limits, open_windows=4).collect()
    for name, capacity in (("s", 100), ("m", 300)):
        own = [r for r in got if r.limit_name == name]
        fill: dict[str, int] = {}
        pieces: dict[int, list] = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_tokens))
        total = sum(n or 0 for _, n in sizes)
        assert max(fill.values()) <= capacity and sum(fill.values()) == total
        assert len(fill) <= 1.05 * total / capacity + 1
        assert set(pieces) == {i for i, _ in sizes}
        for i, n in sizes[1:3000]:
            want = [(k, k * capacity, min(capacity, (n or 0) - k * capacity)) for k in range(max(1, -(-(n or 0) // capacity)))]
            assert sorted(pieces[i]) == want
    assert {r.limit_name for r in got} == {"s", "m"}
    assert packing.pack(items.limit(0), limits).count() == 0


def test_packing_of_empty_items(spark):
    items = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("n_tokens")).repartition(1)
    limits = spark.createDataFrame([("s", 10)], "limit_name string, capacity_tokens int")
    assert packing.pack(items, limits).select(F.countDistinct("doc_id")).first()[0] == 12_000


def test_cut_texts(spark):
    tail = "\nBack to top"
    whole = ["The baker sold bread. It rained all day.", "The baker sold bread." + tail, "Sold out!" + tail, "Gone." + tail, 'He said "we will try."', "Bread.\n© 2024 Some Press", "Bread.\nHome | Help | Login", "Bread.\nRye flour … 12,50 €", "Photo: Ann archive"]
    cut = ["The baker sold bread. It rai", "The baker sold bread. It rained all…", "The baker sold bread. It rained [...]", "It came to 441.", "One day the baker went to"]
    texts = whole + [f"It rained. {x}\nPhoto: {x} archive" for x in ("Ann", "Bob", "Eve")] + cut + [None, "", " \n "]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "s", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, line int")
    first = len(whole) + 3
    assert sorted(r.doc_id for r in truncation.cut_texts(docs).collect()) == list(range(first, first + len(cut)))
    assert truncation.cut_texts(docs.limit(0)).count() == 0


def test_storage_limits(spark):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice("abcdefg é&") for _ in range(n))
    rows = []
    for i in range(300):
        text = "x" + say(rng.randint(20, 400)).replace(" ", "h")
        rows += [(i, text[:200] if len(text) >= 200 else text, "chars"), (i, text, "free"), (i, text.encode()[:150].decode("utf-8", "replace"), "bytes"), (i, text[:120] + "..." if len(text) > 120 else text, "marked")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.union(docs.limit(1).select("doc_id", F.lit(None).cast("string"), F.lit("none")))
    got = {r.source: (r.measure, r.marked, r.length) for r in truncation.source_limits(docs).collect()}
    assert "free" not in got and got["chars"][:2] == ("characters", False) and got["chars"][2] == 200
    assert got["bytes"][0] == "utf8_bytes" and got["marked"][1] is True


def test_a_text_that_stops_at_its_limit_is_cut(spark):
    line = "\nDer Rad"  # of the same kind as a line within others
    filler = lambda n, i: (f"{i:02}" + "abc def ghi " * 20)[: n - len(line)]
    rows = [(i, filler(100, i) + line, "limited") for i in range(6)] + [(10, filler(60, 10) + line, "limited")]
    rows += [(20 + i, f"It rained.{line}{i}\nIt was late on day {i}.", "free") for i in range(4)]
    rows += [(30, filler(100, 30)[:81] + ". It is all over." + " " * 2, "limited")]
    rows += [(40 + i, "The same long text in every copy of it." + line, "mirrors") for i in range(6)]  # copies make no limit
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in truncation.cut_texts(docs).collect()) == list(range(6))


def test_copies_long_openings_and_running_text_make_no_line_whole(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen six"
    texts = [f"It rained on day {i}.\n{long}" for i in range(3)] + [f"It was late on day {i}.\n{long}teen seventeen." for i in range(2)]
    texts += ["It snowed.\nthe snow lay wid"] * 4  # copies of one cut text
    texts += [f"Day {i} ended.\nall was said. then the rain cam" for i in range(3)]  # a sentence stands before
    texts += ["It froze.\nthe frozen riv\nIt thawed."] * 3 + ["It froze again.\nthe frozen riv"]  # within copies of one text
    texts += [f"Number {i} is sold.\nto the whole list" for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert sorted(r.doc_id for r in truncation.cut_texts(docs).collect()) == [0, 1, 2, *range(5, 12), 15]


def test_a_line_end_is_no_plain_character(spark):
    people = spark.createDataFrame([("A", "Ann Bell\u2028", None), ("B", "Ann Bell", None), ("C", "Ann Bell\u0085", None)], "id string, name string, aliases string")
    flagged = {i for i, n in (("A", "Ann Bell\u2028"), ("B", "Ann Bell"), ("C", "Ann Bell\u0085")) if usual_form(n)[1]}
    assert flagged and {r.id for r in unusual_values(people).collect()} == flagged
    assert {r.id for r in usual_forms(people).where("unusual").collect()} == flagged


def test_few_documents_have_the_verdicts_of_many(spark):
    alone = ["It rained.\nFoto: archivo Pilmasolnet", "It rained.\nTabelle 5: Übersicht der Haltestellen", "It rained.\nSuivez-nous : fil Â· courrier", "It rained.\nAfficher plus ...", "It rained.\nThe night market mo", "It rained.\nThe night mar…and so on the boat was late and ever…"]
    docs = lambda n: spark.createDataFrame([(i, t, "s") for i, t in enumerate(alone)] + [(100 + k, f"It was late on day {k}. The night market moved {k} chairs.", "s") for k in range(n)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in truncation.cut_texts(docs(0)).collect()) == sorted(r.doc_id for r in truncation.cut_texts(docs(60)).collect()) == [4, 5]
