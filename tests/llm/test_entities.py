"""Variant spellings and matching across lists."""

from __future__ import annotations

import functools
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namelens.llm import linkage, variants, vectors
from namelens.llm.names import edits, likeness, sound, vector, word_likeness, words_of

PEOPLE = "id string, name string, aliases string, dob string, nationality string, list_type string, roles string"
PERSON = '["CODE-X", "individual"]'
OTHER = '["CODE-Y", "individual"]'
FIRM = '["CODE-Z", "entity"]'

ROWS = [
    ("A1", "Mohammed Al-Qarrifani", None, "1970-05-06", "SY", "OFAC", PERSON),
    ("A2", "Qarifani, Mohamed", '["M. Al-Qarrifani"]', "06.05.1970", "sy", "OFAC", PERSON),
    ("A3", "Мохаммед Каррифани", "null", "", "unknown", "EU", PERSON),
    ("B1", "Mohammed Al-Qarrifani", None, "1941-01-30", "IQ", "OFAC", OTHER),  # bears the same name
    ("C1", "Saeed Al-Qarrifani", None, "1972-05-06", "SY", "OFAC", PERSON),  # a relative
    ("D1", "Drurmimelon Shipping Ltd", None, None, "CY", "UN", FIRM),
    ("D2", '"DRURMIMELON" SHPG. LIMITED', '["DSL Ltd"]', "", "CYP", "HMT", FIRM),
    ("D3", "Drurmimelon Petroleum Ltd", None, None, "CY", "UN", FIRM.replace("Z", "W")),
    ("E1", "Elizabeth Danmedurier", '["The Captain"]', "1968-02-27", "HT", "UN", PERSON),
    ("E2", "Beth Danmeduriier", None, "1968-02-27", "HT", "UN", PERSON),
    ("E3", "Vallinorat, Elizabeth", '["Elizabeth Danmedurier"]', None, "HT", "UN", PERSON),  # found by her former name
    ("F1", None, None, None, None, None, None), ("F2", "", "", "", "", "", ""), ("F3", "  ", "[]", None, None, "UN", "[]"),
    (None, "Mohammed Al-Qarrifani", None, "1970-05-06", "SY", "OFAC", PERSON),
]
SAME = [("A1", "A2"), ("E1", "E2"), ("E1", "E3"), ("E2", "E3")]
ACROSS = [("A1", "A3"), ("A2", "A3"), ("D1", "D2")]


def table(spark):
    return spark.createDataFrame(ROWS, PEOPLE).withColumn("pid", F.lit(1)).withColumn("root", F.lit("x"))


def test_variants_of_one_list(spark):
    assert sorted(map(tuple, variants.variant_pairs(table(spark)).collect())) == SAME


def test_links_across_lists(spark):
    assert sorted(map(tuple, linkage.linked_pairs(table(spark)).collect())) == ACROSS
    scored = linkage.links(table(spark)).collect()
    assert sorted((r.id_a, r.id_b) for r in scored) == ACROSS and all(0 < r.confidence <= 1 for r in scored)
    assert all(r.confidence >= linkage.LEAST_CONFIDENCE for r in scored if r.direct)


def test_empty_tables(spark):
    nobody = table(spark).limit(0)
    assert variants.variant_pairs(nobody).count() == 0 and linkage.linked_pairs(nobody).count() == 0


def test_copies_and_weak_aliases(spark):
    rows = [(f"X{i:02}", "Andrey Belfortinov", '["El Primo"]', "1950-01-01", "RU", "OFAC" if i < 6 else "EU", PERSON) for i in range(9)]
    rows += [(f"Y{i:02}", f"Ivan {'abcdefghij'[i] * 2}rovalkeni{'klmnopqrst'[i]}", '["El Primo"]', "", "RU", "OFAC", PERSON) for i in range(10)]
    rows += [("Z00", "El Primo", None, "", "RU", "UN", PERSON)]  # bears as name what many bear as alias
    people = spark.createDataFrame(rows, PEOPLE)
    same = {(r.id_a, r.id_b) for r in variants.variant_pairs(people).collect()}
    assert {p for p in same if p[0][0] == "X"} == {(f"X{i:02}", f"X{j:02}") for j in range(6) for i in range(j)} | {(f"X{i:02}", f"X{j:02}") for j in range(6, 9) for i in range(6, j)}
    assert not any(a[0] != b[0] for a, b in same)
    assert linkage.linked_pairs(people).count() == 18


def test_programmes_do_not_matter(spark):
    people = table(spark).withColumn("roles", F.when(F.col("roles").contains("entity"), FIRM).otherwise(F.concat(F.lit('["P-'), "id", F.lit('"]'))))
    assert sorted(map(tuple, variants.variant_pairs(people).collect())) == SAME
    assert sorted(map(tuple, linkage.linked_pairs(people).collect())) == ACROSS


def test_a_subset_has_the_same_verdicts(spark):
    rng = random.Random(4)
    syllables = "ba ke li mo nu ra se ti vo zu fal gor hin".split()
    rows = []
    for i in range(300):
        name = "".join(rng.choice(syllables) for _ in range(4))
        given_name = rng.choice(["Ivan", "Pedro", "Omar", "Lena"])
        for k in range(rng.randint(1, 3)):
            typed = name if k == 0 else name[:3] + name[4] + name[3] + name[5:]
            rows.append((f"R{i:03}{k}", f"{given_name} {typed.title()}", '["The Boss"]' if i % 9 == 0 else None, f"19{50 + i % 40}-0{1 + i % 9}-1{i % 10}", "RU", rng.choice(["UN", "EU"]), PERSON))
    whole = spark.createDataFrame(rows, PEOPLE)
    part = whole.where("substr(id, 2, 3) < '080'")
    own = {(r.id_a, r.id_b) for r in linkage.linked_pairs(part).collect()}
    assert own and own == {(r.id_a, r.id_b) for r in linkage.linked_pairs(whole).collect() if r.id_b[1:4] < "080"}


letters = st.text(alphabet="abcdefgh", min_size=2, max_size=12)


@settings(max_examples=800, deadline=None)
@given(letters, letters)
def test_close_vectors_share_a_key(a, b):
    va, vb = vector(a), vector(b)
    if (va ^ vb).bit_count() <= min(vectors.radius(va.bit_count()), vectors.radius(vb.bit_count())):
        (left_a, right_a), (left_b, right_b) = vectors.index_keys(a), vectors.index_keys(b)
        assert set(left_a) & set(right_b) or set(left_b) & set(right_a)


def test_close_words_against_brute_force(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 11))) for _ in range(150)}
    words |= {w[:2] + w[3:] for w in words} | {w[:3] + "x" + w[4:] for w in words}
    got = {(r.word, r.other) for r in vectors.close_words(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()}
    near = lambda a, b: (vector(a) ^ vector(b)).bit_count() <= min(vectors.radius(vector(a).bit_count()), vectors.radius(vector(b).bit_count()))
    assert {(a, b) for a in words for b in words if a == b or near(a, b)} <= got
    assert all(a == b or near(a, b) or word_likeness(a, b) == 0.9 for a, b in got)


def test_edits():
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choice("abcd") for _ in range(8))
        k = rng.randrange(7)
        assert edits(w, w[:k] + w[k + 1] + w[k] + w[k + 2 :], 2) <= 1 and edits(w, w[:k] + w[k + 1 :], 2) <= 1 and edits(w, "zzzzzzzz", 3) == 4


def alike(a, b, person=True):
    x, y = words_of(a, person), words_of(b, person)
    rare = lambda words: [len(w) > 5 for w in words]
    return likeness(x, y, rare(x), rare(y), person)


def test_names_are_alike():
    ok = [("Abdul Rahman bin X", "Abdurrahman X"), ("Abd al-Rahman Qaansadaarawa", "Abdelrahman Qaansadaarawa"), ("A. I. Stirkizaovin", "Anastasiya Igorovich Stirkizaovin")]
    assert all(alike(a, b) > 0.8 for a, b in ok)
    assert alike("Drurmimelon Shipping Ltd", '"DRURMIMELON" SHPG. LIMITED', False) > 0.9
    assert alike("Abdullah Dakabinouf", "Saeed Dakabinouf") < 0.75 and alike("Ivan", "Ivan Rovalkenik") == 0.0 and alike("", "Ivan") == 0.0


def test_dates(spark):
    pairs = [("1970-05-06", "1970-06-05"), ("1970-05-06", "1970"), ("1970-05-06", "1970-05-07"), ("1970-05-06", "1941-11-30"), ("1970-05-06", "")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    bits = lambda c: F.transform(F.filter(F.array(c), lambda x: x != ""), vectors.date_bits)
    got = [r.d for r in rows.select(vectors.date_dice(bits("a"), bits("b")).alias("d")).collect()]
    assert got[0] == 1 and 0.6 < got[1] < 1 and 0.8 < got[2] < 1 and got[3] < 0.4 and got[4] is None


def test_fitted_weights(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        name, dob, country = rng.random(), rng.choice([None, 0.2, 1.0]), rng.choice([None, 0.0, 1.0])
        rows.append((name, dob, country, 8 * name + 3 * (dob or 0.5) + (country or 0.5) > 6.5))
    w = linkage.fitted(spark.createDataFrame(rows, "name double, dob double, country double, same boolean"))
    assert w.name > w.dob > w.country > 0 and 0.2 < w.no_dob < 0.8
    assert linkage.fitted(spark.createDataFrame(rows, "name double, dob double, country double, same boolean"), sample=100).name > 0


def test_sounds_and_vectors():
    assert sound("Zhukoff".lower()) == sound("zhukov") and vector("").bit_count() <= 1


def test_index_keys_are_sent_together(spark):
    """The keys of words come to their buckets in few rows, not one a key."""
    words = [("".join(p) + "onetariv",) for p in itertools.product("bdgklmnprstz", repeat=2)]
    known = vectors.encoded(spark.createDataFrame(words, "word string"))
    plan = vectors.close_numbers(known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
    sent = known.select("w", "v0", "v1", "radius").coalesce(1).mapInArrow(functools.partial(vectors._bucketed, buckets=3), vectors._SENT)
    assert sent.count() == 3 and sum(len(r.left) // 4 for r in sent.collect()) == sum(len(vectors.index_keys(w)[0]) for (w,) in words)


def test_words_of_frequent_dates(spark, monkeypatch):
    """Dates of many words are looked up in the close words, with the same pairs."""
    names = ["Petrovalin Ivan", "Petrovalim Omar", "Bob Danmedurier", "Robert Vallinorat", "Petrovalin Oleg", "Gorhinba Lena", "Li Bo"]
    rows = [(f"X{i}{k}", n, '["El Primo"]' if i % 2 else None, f"1950-0{1 + k}-12", "RU", "OFAC", PERSON) for k in range(2) for i, n in enumerate(names)]
    _, entities, spelt, spellings, close = linkage.prepared(spark.createDataFrame(rows, PEOPLE))
    for fresh in (None, F.col("eid") < "X4"):
        found = []
        for many in (1000, 3):
            monkeypatch.setattr(vectors, "MANY", many)
            found.append(sorted(map(tuple, vectors.dated_pairs(entities, spelt, spellings, close, fresh).collect())))
        assert found[0] == found[1] and len(found[0]) >= 3


def test_frequent_words_are_not_multiplied_by_dates(spark):
    """The words of a date are compared by their vectors: the plan has no join with the close words."""
    _, entities, spelt, spellings, close = linkage.prepared(table(spark))
    plan = vectors.dated_pairs(entities, spelt, spellings, close)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "bit_count" in plan  # two leave frequent dates out


def test_checkpoints_leave_no_shuffle_files(spark):
    from namelens.session import cut_lineage

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n.rsplit("/", 1)[-1] for n in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = files()
    kept = cut_lineage(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before
    assert kept.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_later_rounds_join_what_is_new(spark):
    """With few fresh entities only bearers of spellings near theirs are joined, with the same pairs."""
    rows = [(f"X{i:02}", f"{g} {n}", None, f"195{i % 3}-03-12" if i % 4 else "", "RU", "OFAC", PERSON) for i, (n, g) in enumerate(itertools.product(("Petrovalin", "Petrovalim", "Danmedurier", "Vallinorat"), ("Ivan", "Vanya", "Omar")))]
    _, entities, spelt, spellings, close = linkage.prepared(spark.createDataFrame(rows, PEOPLE))
    every = vectors.scored_names(vectors.name_pairs(spellings, close), spellings)
    some = entities.withColumn("fresh", F.col("eid").isin("X01", "X07"))
    pairs = [linkage.compared(some, spelt, spellings, every, **k) for k in ({}, {"partly": True})]
    found = [sorted(map(tuple, p.collect())) for p in pairs]
    assert found[0] == found[1] and 0 < len(found[0]) < linkage.compared(entities, spelt, spellings, every).count()
