"""Variant spellings of names typed by people, by merging matched records and matching them again.

Records under a common key are compared; those that match are merged, which unites their spellings, the
initials of these, and what is known of dates and countries; merged records are blocked and compared again,
with all others, until none merges any more.  A record may thus be found through what another of the same bearer adds:
a name of the one with the date of birth of the other, or a former name.

Keys and comparison are those of ``vectors``: a rare word, or one close to it, with the initial of another word,
or any word with the date of birth.  Spellings are held one to a row and are compared once whoever bears
them, so that no row grows with the size of a group, and a later round compares only what merging has made new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm import linkage as L
from namelens.llm import profiles as P
from namelens.llm import vectors as V
from namelens.session import cut_lineage


def merged(entities: DataFrame, spelt: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and their spellings after those with the same root became one; what is new of them is ``fresh``.

    The arrays of a record hold distinct dates and countries, of which there are a bounded number.
    """
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    joined = entities.join(roots.withColumnRenamed("pid", "eid").hint("merge"), "eid")
    one = joined.groupBy("root").agg(F.first("person").alias("person"), united("dobs"), united("countries"), (F.count(F.lit(1)) > 1).alias("fresh"))
    moved = spelt.join(roots.withColumnRenamed("pid", "eid").hint("merge"), "eid").groupBy("root", "sid").agg(F.max("main").alias("main"))
    return cut_lineage(one.withColumnRenamed("root", "eid")), cut_lineage(moved.withColumnRenamed("root", "eid"))


def resolve(people: DataFrame, *, least: float = L.LEAST_CONFIDENCE, weights: L.Weights = L.WEIGHTS) -> DataFrame:
    """(id, list_type, bearer) of every row with an id: rows with the same ``bearer`` mean the same one.

    Rows without any name stand alone.
    """
    rows, entities, spelt, spellings, close = L.prepared(people)
    member = rows.select("pid").distinct().select("pid", F.col("pid").alias("bearer"))
    asked = cut_lineage(V.name_pairs(spellings, close))
    names, partly = cut_lineage(V.scored_names(asked, spellings)), False
    while True:
        more = cut_lineage(V.dated_pairs(entities, spelt, spellings, close, F.col("fresh") if partly else None).join(asked.hint("merge"), ["s", "t"], "left_anti"))
        asked, names = asked.union(more), cut_lineage(names.union(V.scored_names(more, spellings)))
        pairs, partly = L.compared(entities, spelt, spellings, names, partly=partly), True
        sure = cut_lineage(pairs.withColumn("confidence", L.confidence(F.col("name"), F.col("dob"), F.col("country"), weights)).where(F.col("confidence") >= least))
        matches = L.consistent(sure, entities).select("a", "b")
        if matches.isEmpty():
            break
        roots = cut_lineage(P.components(entities.select(F.col("eid").alias("pid")), matches, cut_lineage))
        entities, spelt = merged(entities, spelt, roots)
        member = cut_lineage(member.join(roots.withColumnRenamed("pid", "bearer").hint("merge"), "bearer", "left").select("pid", F.coalesce("root", "bearer").alias("bearer")))
    return rows.join(member.hint("merge"), "pid").select("id", "list_type", "bearer")


def variant_pairs(people: DataFrame, *, least: float = L.LEAST_CONFIDENCE, weights: L.Weights = L.WEIGHTS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the rows of one list that mean the same person or organisation.

    Every pair of a larger group is given, identical spellings included.  A repeated id is paired
    with itself never and with others once.  Rows without an id or any name match nothing; null lists are one list of
    their own; columns that are not read are ignored.
    """
    own = resolve(people, least=least, weights=weights).distinct()
    a, b = own.alias("a"), own.alias("b")
    return a.join(b.hint("merge"), ["bearer", "list_type"]).where("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
