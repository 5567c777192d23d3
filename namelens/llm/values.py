"""The name and alias values of a watchlist, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alias_array(aliases: Column) -> Column:
    """The array in a JSON text of aliases; null, '', JSON ``null`` and unreadable texts give the empty array."""
    return F.coalesce(F.from_json(aliases, "array<string>"), F.array().cast("array<string>"))


def name_values(people: DataFrame) -> DataFrame:
    """(id, alias_index, value): index -1 for the name, else the place in ``aliases``; null values are left out."""
    every = F.concat(F.array("name"), alias_array(F.col("aliases")))
    return people.select("id", F.posexplode(every).alias("pos", "value")).where("value IS NOT NULL").select("id", (F.col("pos") - 1).alias("alias_index"), "value")
