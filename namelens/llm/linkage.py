"""Matching entities across lists that share no identifier.

The words of names and the dates of birth are encoded as fixed bit vectors, and close ones are found by
multi-index Hamming hashing (``vectors``).  Each pair of entities that they lead to has a Dice coefficient for each field: names by
words, dates by their bits, countries and programmes as sets; a field that either side lacks says nothing.  The
coefficients are weighted by field and added up, and a logistic curve turns the sum into a confidence.  A pair
matches if its confidence reaches ``LEAST_CONFIDENCE``, and if an entity without a date does not thereby join unlike ones.  Programmes are no field of the score.

Weights and curve are parameters, fitted by ``fitted`` to at most ``SAMPLE`` labelled pairs; the values given here
come from the 48,053 pairs compared in a watchlist of 100,000 entries, labelled by rules over single words, dates and programmes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm import profiles as P
from namelens.llm import vectors as V
from namelens.session import cut_lineage

#: Confidence at which a pair matches.
LEAST_CONFIDENCE = 0.7
#: What the Dice coefficient of names loses with the logarithm of how many unlike bearers share the spelling.
SHARED = 0.1
#: Least Dice coefficient of dates that may be those of one.
NEAR_DATES = 0.5
#: Labelled pairs that the weights are fitted to at most.
SAMPLE = 50_000


class Weights(NamedTuple):
    """Weights of the fields' Dice coefficients, and the coefficient that a lacking field counts as."""

    base: float = -38.0
    name: float = 34.0
    dob: float = 11.5
    country: float = 4.0
    no_dob: float = 0.5
    no_country: float = 0.6


WEIGHTS = Weights()


def entities_of(heads: DataFrame) -> DataFrame:
    """(eid, person, dobs, countries, fresh) of profiles, each attribute as an array of what is known."""
    return heads.select(
        F.col("pid").alias("eid"),
        "person",
        F.filter(F.array("dob"), lambda x: x != "").alias("dobs"),
        F.filter(F.array("country"), lambda x: x != "").alias("countries"),
        F.lit(True).alias("fresh"),
    )


def _meeting_keys(own: DataFrame, left: bool) -> Column:
    """Keys on which bearers of alike spellings meet.

    A spelling that is the name of either ("n" keys lead to every bearer, "m" keys to those whose name it is) is enough where the
    dates share a half, or one has none; aliases of both tell only together with the whole date.
    """
    dated, main = F.size("dobs") > 0, F.col("main")
    of_dates = lambda *keys: F.flatten(F.transform("dobs", lambda d: F.array_compact(F.array(*[F.concat(F.lit(k), part) for k, part in [(k, {"y": F.left(d, F.lit(4)), "d": F.substring(V.date_key(d), 6, 5), "f": V.date_key(d)}[k[-1]]) for k in keys]]))))
    some = lambda *keys: F.array(*[F.lit(k) for k in keys])
    if left:
        halves = F.when(main, of_dates("ny", "nd")).otherwise(of_dates("my", "md", "f"))
        rest = F.when(dated & main, some("n undated")).when(dated, some("m undated")).when(main, some("n all")).otherwise(some("m all"))
    else:
        halves = F.when(main, of_dates("ny", "nd", "my", "md", "f")).otherwise(of_dates("ny", "nd", "f"))
        rest = F.when(dated & main, some("n all", "m all")).when(dated, some("n all")).when(main, some("n all", "m all", "n undated", "m undated")).otherwise(some("n all", "n undated"))
    return F.array_distinct(F.concat(halves, rest))


def compared(entities: DataFrame, spelt: DataFrame, spellings: DataFrame, names: DataFrame, *, partly: bool = False) -> DataFrame:
    """(a, b, name, dob, country) of pairs of entities, a < b, one of them fresh: a Dice coefficient for each field.

    ``spelt`` is (eid, sid, main), ``names`` comes from ``vectors.scored_names``.  ``name`` is that of the most alike
    spellings, less the more unlike bearers these have, ``dob`` and ``country`` are null where either side lacks them.  Entities of which only aliases are alike
    are compared if their dates are equal.  With ``partly``, where few entities are fresh, only bearers of spellings that
    are linked to those of fresh ones are joined, which gives the same pairs.
    """
    own = spelt.join(entities.select("eid", "dobs", "fresh").hint("merge"), "eid")
    told = lambda likeness: (likeness - SHARED * F.log("unlike")).alias("name")
    itself = spellings.select("sid", F.col("sid").alias("t"), told(F.lit(1.0)))
    links = names.select(F.col("s").alias("sid"), "t", told(F.col("likeness"))).union(names.select("t", "s", told(F.col("likeness")))).union(itself)
    if partly:
        near = links.join(own.where("fresh").select("sid").distinct().hint("merge"), "sid", "left_semi").select(F.col("t").alias("sid")).distinct()
        own = cut_lineage(own.join(near.hint("merge"), "sid", "left_semi"))
    left = own.select(F.col("eid").alias("a"), "sid", F.col("fresh").alias("fa"), F.explode(_meeting_keys(own, True)).alias("key"))
    left = left.join(links.hint("merge"), "sid").select("a", "fa", "key", F.col("t").alias("sid"), "name")
    right = own.select(F.col("eid").alias("b"), "sid", F.col("fresh").alias("fb"), F.explode(_meeting_keys(own, False)).alias("key"))
    met = left.join(right.hint("merge"), ["sid", "key"]).where("a < b AND (fa OR fb)")
    alike = met.groupBy("a", "b").agg(F.max("name").alias("name"))
    facts = entities.select("eid", F.transform("dobs", V.date_bits).alias("dates"), "countries")
    side = lambda k, p: facts.select(F.col("eid").alias(k), *[F.col(c).alias(f"{c}_{p}") for c in ("dates", "countries")])
    full = alike.join(side("a", 1).hint("merge"), "a").join(side("b", 2).hint("merge"), "b")
    shared = lambda c: F.when((F.size(f"{c}_1") > 0) & (F.size(f"{c}_2") > 0), F.arrays_overlap(f"{c}_1", f"{c}_2").cast("double"))
    return full.select("a", "b", "name", V.date_dice(F.col("dates_1"), F.col("dates_2")).alias("dob"), shared("countries").alias("country"))


def confidence(name: Column, dob: Column, country: Column, weights: Weights = WEIGHTS) -> Column:
    """The confidence of a pair from the Dice coefficients of its fields, null for a field that is lacking."""
    w = weights
    score = w.base + w.name * name + w.dob * F.coalesce(dob, F.lit(w.no_dob)) + w.country * F.coalesce(country, F.lit(w.no_country))
    return 1 / (1 + F.exp(-score))


def consistent(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """The matches (a, b, confidence) without those by which an entity without a date would join entities of unlike dates.

    Such an entity may be any of several of one name; it stays with the one that it matches with most confidence, the
    first by id among equals, and with those whose dates are like its.
    """
    dates = entities.select("eid", F.transform("dobs", V.date_bits).alias("dates"))
    ends = matches.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("e"), "confidence").select("a", "b", "e.*", "confidence")
    undated = ends.join(dates.where("size(dates) = 0").select(F.col("eid").alias("own")).hint("merge"), "own", "left_semi")
    dated = cut_lineage(undated.join(dates.where("size(dates) > 0").withColumnRenamed("eid", "other").hint("merge"), "other"))
    chosen = dated.groupBy("own").agg(F.min_by("dates", F.struct(-F.col("confidence"), F.col("other"))).alias("chosen"))
    against = dated.join(chosen.hint("merge"), "own").where(V.date_dice(F.col("dates"), F.col("chosen")) < NEAR_DATES).select("a", "b").distinct()
    return cut_lineage(matches.join(against.hint("merge"), ["a", "b"], "left_anti"))


def fitted(labelled: DataFrame, *, sample: int = SAMPLE) -> Weights:
    """Weights for pairs (name, dob, country, same): a logistic regression on at most ``sample`` of them, chosen by hash."""
    some = labelled.orderBy(F.xxhash64("name", "dob", "country"), "same").limit(sample)
    rows = some.select("name", F.coalesce("dob", F.lit(0.0)), F.isnull("dob").cast("double"), F.coalesce("country", F.lit(0.0)), F.isnull("country").cast("double"), F.col("same").cast("double")).collect()
    data = np.array([list(r) for r in rows], float).reshape(-1, 6)
    x, y = np.column_stack([np.ones(len(data)), data[:, :5]]), data[:, 5]
    w, ridge = np.zeros(6), 0.3 * np.diag([1e-6, 1, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    base, name, dob, no_dob, country, no_country = map(float, w)
    return Weights(base, name, dob, country, no_dob / dob if dob else 0.0, no_country / country if country else 0.0)


def prepared(people: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, entities, spelt, spellings, close) of a watchlist: its rows with their profiles, and what is compared of these."""
    rows = cut_lineage(P.copies(P.profiles(people)))
    heads = cut_lineage(rows.where("id = pid").dropDuplicates(["pid"]))
    spelt, spellings, close = V.spelling_table(heads)
    return rows.select("id", "list_type", "pid"), cut_lineage(entities_of(heads)), cut_lineage(spelt.withColumnRenamed("pid", "eid")), spellings, close


def candidates(people: DataFrame, weights: Weights = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, entities, pairs): rows as (id, list_type, pid), and the compared pairs (a, b, name, dob, country, confidence) of profiles."""
    rows, entities, spelt, spellings, close = prepared(people)
    pairs = V.name_pairs(spellings, close).union(V.dated_pairs(entities, spelt, spellings, close)).distinct()
    scored = cut_lineage(V.scored_names(pairs, spellings))
    both = compared(entities, spelt, spellings, scored)
    return rows, entities, cut_lineage(both.withColumn("confidence", confidence(F.col("name"), F.col("dob"), F.col("country"), weights)))


def resolved(people: DataFrame, *, least: float = LEAST_CONFIDENCE, weights: Weights = WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, entities, matches): each row with an id as (id, list_type, pid, root), and the pairs of profiles that match."""
    rows, entities, pairs = candidates(people, weights)
    matches = consistent(pairs.where(F.col("confidence") >= least), entities)
    roots = P.components(rows.select("pid").distinct(), matches.select("a", "b"), cut_lineage)
    return cut_lineage(rows.distinct().join(roots.hint("merge"), "pid")), entities, matches


def members(people: DataFrame, *, least: float = LEAST_CONFIDENCE, weights: Weights = WEIGHTS) -> DataFrame:
    """(id, list_type, bearer) of every row with an id: rows with the same ``bearer`` describe the same one."""
    return resolved(people, least=least, weights=weights)[0].select("id", "list_type", F.col("root").alias("bearer"))


def linked_pairs(people: DataFrame, *, least: float = LEAST_CONFIDENCE, weights: Weights = WEIGHTS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the rows of different lists that describe the same person or organisation.

    Every pair of a larger group is given.  Rows without an id or without any name match nothing; a repeated row
    counts once, null lists are one list of their own, columns that are not read are ignored.
    """
    own = members(people, least=least, weights=weights)
    a, b = own.alias("a"), own.alias("b")
    return a.join(b.hint("merge"), "bearer").where("a.id < b.id AND a.list_type <> b.list_type").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def links(people: DataFrame, *, least: float = LEAST_CONFIDENCE, weights: Weights = WEIGHTS) -> DataFrame:
    """``linked_pairs`` with the ``confidence`` of each, and whether it was compared (``direct``) or follows from others.

    Rows with equal profiles have the confidence of a profile with itself; a pair that follows from others has the less
    of what its two profiles are linked to the group by.
    """
    own, entities, matches = resolved(people, least=least, weights=weights)
    has = lambda c: F.when(F.size(c) > 0, F.lit(1.0))
    itself = entities.select(F.col("eid").alias("pid"), confidence(F.lit(1.0), has("dobs"), has("countries"), weights).alias("itself"))
    ends = matches.select(F.explode(F.array("a", "b")).alias("pid"), "confidence").groupBy("pid").agg(F.max("confidence").alias("best"))
    known = cut_lineage(own.join(itself.hint("merge"), "pid").join(ends.hint("merge"), "pid", "left"))
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(b.hint("merge"), "root").where("a.id < b.id AND a.list_type <> b.list_type").select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.least("a.pid", "b.pid").alias("a"), F.greatest("a.pid", "b.pid").alias("b"),
        F.when(F.col("a.pid") == F.col("b.pid"), F.col("a.itself")).otherwise(F.least("a.best", "b.best")).alias("follows"),
    )
    full = pairs.join(matches.select("a", "b", "confidence").hint("merge"), ["a", "b"], "left")
    each = full.groupBy("id_a", "id_b").agg(F.max("confidence").alias("own"), F.max("follows").alias("follows"), F.max((F.col("a") == F.col("b")) | F.col("confidence").isNotNull()).alias("direct"))
    return each.select("id_a", "id_b", F.round(F.coalesce("own", "follows"), 6).alias("confidence"), "direct")
