"""Candidate pairs of names and list entries.

A pair is a candidate if a token of any variant of the name and one of any variant of the entry begin with
the same two characters.  Both sides are exploded to keys and joined on them; a pair with several
common keys is kept under the smallest one alone, so no distinct and no shuffle of the pairs follows.
Names without keys, and names with no candidate in the lists they ask for, are compared with every entry.
Screening looks keys up in its cells (``functions.cells``) and asks here only which names those are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asks_for(lists: Column, list_type: Column) -> Column:
    """Whether a list is among those asked for; none named means all."""
    return (F.size(F.coalesce(lists, F.array().cast("array<string>"))) == 0) | F.array_contains(lists, list_type)


def keyed_candidates(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, entry) of pairs with a common key, within the lists asked for.

    ``queries`` has (qid, keys, lists), ``entries`` (entry, keys, list_type); keys are arrays without repetition.
    """
    q = queries.select("qid", "lists", F.col("keys").alias("q_keys"), F.explode("keys").alias("key"))
    e = entries.select("entry", "list_type", F.col("keys").alias("e_keys"), F.explode("keys").alias("key"))
    smallest = F.array_min(F.array_intersect("q_keys", "e_keys")) == F.col("key")
    return q.join(e, "key").where(asks_for(F.col("lists"), F.col("list_type")) & smallest).select("qid", "entry")


def scanning(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """The queries that are compared with all entries: no text, no keys, or no entry has a key of theirs.

    Whether an entry has it is asked of the keys of each list, a small table, not of the pairs.
    """
    held = entries.select("list_type", F.explode("keys").alias("key")).groupBy("key").agg(F.collect_set("list_type").alias("in_lists"))
    some = queries.where("base <> ''").select("qid", "lists", F.explode("keys").alias("key")).join(held, "key")
    found = some.where((F.size(F.coalesce("lists", F.array().cast("array<string>"))) == 0) | F.arrays_overlap("lists", "in_lists")).select("qid").distinct()
    return queries.join(found, "qid", "left_anti")
