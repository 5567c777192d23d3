"""Counts of lists and of matches, and the responses of single and batch screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.schema import DEFAULT_LISTS


def list_counts(people: DataFrame, lists: Sequence[str] = DEFAULT_LISTS) -> DataFrame:
    """(list, count) of each named list, 0 for one without rows."""
    names = people.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(lists)], "list string")
    counted = people.where(F.col("list_type").isin(*lists)).groupBy(F.col("list_type").alias("list")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "list", "left").select("list", F.coalesce("n", F.lit(0)).alias("count"))


def match_counts(inputs: DataFrame, matches: DataFrame) -> DataFrame:
    """(input_id, count) of each input, 0 for one without matches."""
    return with_zeros(inputs, matches.groupBy("input_id").agg(F.count(F.lit(1)).alias("n")))


def with_zeros(inputs: DataFrame, counted: DataFrame) -> DataFrame:
    """(input_id, count) of each input from (input_id, n) of those that have matches."""
    return inputs.select("input_id").distinct().join(counted, "input_id", "left").select("input_id", F.coalesce("n", F.lit(0)).alias("count"))


def total_matches(matches: DataFrame) -> DataFrame:
    """(total_matches): how many matches there are over all inputs."""
    return matches.agg(F.count(F.lit(1)).alias("total_matches"))


def projected(matches: DataFrame) -> DataFrame:
    """Matches as they are answered: without the explanation."""
    return matches.select("input_id", "input_name", "rank", "person_id", "name", "score", "match_type", "list", "nationality")


def batch_response(inputs: DataFrame, matches: DataFrame) -> DataFrame:
    """(input_id, input_name, count, matches) of every input, its matches in their order as an array."""
    row = F.struct("rank", "person_id", "name", "score", "match_type", "list", "nationality")
    listed = matches.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda m: m.dropFields("rank")).alias("found"))
    kind = "array<struct<person_id:string,name:string,score:double,match_type:string,list:string,nationality:string>>"
    rows = inputs.select("input_id", F.coalesce("name", F.lit("")).alias("input_name")).join(listed, "input_id", "left")
    found = F.coalesce(F.col("found").cast(kind), F.array().cast(kind))
    return rows.select("input_id", "input_name", F.size(found).alias("count"), found.alias("matches"))
