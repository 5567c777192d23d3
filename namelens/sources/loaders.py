"""Readers of watchlists and of bulk names: CSV, JSON arrays, entity JSON lines, person JSON.

Every reader gives the columns of ``schema.PERSON``.  Null texts become '', null lists empty ones, so
that no later step meets three-valued logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.schema import PERSON

FORMATS = ("csv", "json", "jsonl")
#: First cells that mark the first row of a bulk file as a header.
HEADERS = ("name", "full_name", "fullname", "entity_name")

_NONE = "array<string>"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def _as_people(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PERSON.fields])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header: id, name and nationality, trimmed; a missing column is ''.  The list is always OFAC.

    Ragged rows fail the load, as does a file without rows.
    """
    raw = spark.read.option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path, header=True, enforceSchema=False)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if not raw.columns or raw.isEmpty():
        raise ValueError("empty csv")
    part = lambda c: _trimmed(_text(f"`{c}`")) if c in raw.columns else F.lit("")
    none = F.array().cast(_NONE)
    return _as_people(raw.select(part("id").alias("id"), part("name").alias("name"), none.alias("aliases"), F.lit(None).alias("dob"), part("nationality").alias("nationality"), F.lit("OFAC").alias("list_type"), none.alias("roles")))


def _first_character(spark: SparkSession, path: str) -> str:
    """The first character of a text that is not white space, '' if there is none."""
    line = spark.read.text(path).where(F.col("value").rlike(r"(?U)\S")).first()
    return line.value.strip()[0] if line else ""


def read_entries(spark: SparkSession, path: str, default_list: str = "EU") -> DataFrame:
    """A JSON array of simple entries; the key ``list`` overrides the default, ``programs`` may be one text or an array."""
    schema = "id string, name string, aliases array<string>, nationality string, list string, type string, programs string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    many = F.from_json("programs", _NONE)
    roles = F.when(F.col("programs").isNull(), F.array().cast(_NONE)).when(F.ltrim("programs").startswith("["), many).otherwise(F.array("programs"))
    chosen = F.when(_text("list") == "", F.lit(default_list)).otherwise(F.col("list"))
    return _as_people(raw.select(_text("id").alias("id"), _text("name").alias("name"), _array(F.col("aliases")).alias("aliases"), F.lit(None).alias("dob"), _text("nationality").alias("nationality"), chosen.alias("list_type"), _array(roles).alias("roles")))


def read_entities(spark: SparkSession, path: str, default_list: str = "EU") -> DataFrame:
    """JSON lines of entities: persons and organisations that have a name; blank and unreadable lines are skipped."""
    schema = "id string, schema string, properties struct<name:array<string>,alias:array<string>,country:array<string>,birthDate:array<string>,programId:array<string>>, _corrupt string"
    lines = spark.read.text(path).where(F.col("value").rlike(r"(?U)\S"))
    read = lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    read = read.where("_corrupt IS NULL AND schema IN ('Person', 'Organization')")
    first = lambda c: F.get(f"properties.{c}", F.lit(0))
    filled = lambda c: F.filter(_array(F.col(f"properties.{c}")), lambda x: F.coalesce(x, F.lit("")) != "")
    country = F.when(F.coalesce(first("country"), F.lit("")) == "", "unknown").otherwise(F.upper(first("country")))
    dob = F.when(first("birthDate").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(first("birthDate"), "yyyy-MM-dd"))
    kind = F.when(F.col("schema") == "Person", "individual").otherwise("entity")
    named = read.where(F.coalesce(first("name"), F.lit("")) != "")
    return _as_people(
        named.select(_text("id").alias("id"), first("name").alias("name"), filled("alias").alias("aliases"), dob.alias("dob"), country.alias("nationality"), F.lit(default_list).alias("list_type"), F.concat(filled("programId"), F.array(kind)).alias("roles"))
    )


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of persons in the engine's own layout; any error fails the load."""
    schema = "id string, name string, aliases array<string>, dob string, nationality string, list_type string, roles array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _as_people(raw.select(_text("id").alias("id"), _text("name").alias("name"), _array(F.col("aliases")).alias("aliases"), F.to_date(F.substring("dob", 1, 10)).alias("dob"), _text("nationality").alias("nationality"), _text("list_type").alias("list_type"), _array(F.col("roles")).alias("roles")))


def load_watchlist(spark: SparkSession, path: str, fmt: str, default_list: str = "EU") -> DataFrame:
    """A watchlist in one of ``FORMATS``.  JSON and JSON lines are told apart by their first character."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if fmt == "csv":
        return read_csv(spark, path)
    first = _first_character(spark, path)
    if not first:
        raise ValueError("empty data")
    return read_entries(spark, path, default_list) if first == "[" else read_entities(spark, path, default_list)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(input_id, name): the first column of a CSV of names in file order, without its header row if it has one."""
    raw = spark.read.option("multiLine", True).option("escape", '"').option("quote", '"').csv(path, header=False)
    cell = F.coalesce(F.col(raw.columns[0]), F.lit(""))
    rows = raw.select(cell.alias("name"), F.monotonically_increasing_id().alias("input_id"))
    header = F.lower(_trimmed(F.col("name"))).isin(*HEADERS) & (F.col("input_id") == 0)
    return rows.where(~header).select("input_id", "name")



def stored_people(table: DataFrame) -> DataFrame:
    """Rows of a store table, with JSON texts for aliases and roles and '' for no date, as persons.

    JSON ``null``, '' and unreadable texts give no aliases or roles; a date in another notation is none.
    """
    listed = lambda c: _array(F.from_json(c, _NONE))
    dob = F.when(F.col("dob").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("dob", "yyyy-MM-dd"))
    return _as_people(table.select(_text("id").alias("id"), _text("name").alias("name"), listed("aliases").alias("aliases"), dob.alias("dob"), _text("nationality").alias("nationality"), _text("list_type").alias("list_type"), listed("roles").alias("roles")))
