"""Schemas that drift between the files of a feed.

``file_fields`` finds which fields each file has and of what type; ``schema_changes`` compares each
file with the one before it in its feed; ``schema_versions`` numbers the distinct schemas of a feed by
their fingerprints; ``migration_rules`` chains the changes into the place where each canonical field
is found; ``consistent_records`` routes every record through its feed's rules into one table.

Records are parsed into VARIANT values on the JVM, and their fields written down once.  Only schema-level tables (files times
fields) are grouped by feed; records are shuffled by (feed, id) for the rename check alone, and there
only the fields that appeared or vanished.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.session import cut_lineage

#: List numbers of the feeds.
LIST_NUMBERS = {"1": "OFAC", "2": "EU", "3": "UN", "4": "HMT", "5": "SECO"}

#: Where a first file has each canonical field, by file format.
BASE_PATHS = {
    "jsonl": {"name": "properties.name", "aliases": "properties.alias", "nationality": "properties.country", "dob": "properties.birthDate", "programs": "properties.programId", "kind": "schema"},
    "json": {"name": "name", "aliases": "aliases", "nationality": "nationality", "list": "list", "kind": "type", "programs": "programs"},
}

#: A file has a field if at least this share of its readable records hold it.
PRESENCE = 0.2

#: A vanished and a new field are one if this share of the ids that go on hold the same content.
SAME_CONTENT = 0.5


def feed_files(files: DataFrame) -> DataFrame:
    """One row for each file of a feed: (feed_id, file_seq, file_name, file_format, default_list).

    A file sent twice counts once.  If a place in a feed has two names the one delivered last counts.
    """
    return (
        files.where("feed_id IS NOT NULL AND file_seq IS NOT NULL AND file_name IS NOT NULL")
        .groupBy("feed_id", "file_seq")
        .agg(F.max(F.struct("delivered_at", "file_name", "file_format", "default_list")).alias("f"))
        .select("feed_id", "file_seq", "f.file_name", "f.file_format", "f.default_list")
    )


def readable(records: DataFrame) -> DataFrame:
    """The records that are JSON objects: (file_name, line_no, id, value)."""
    parsed = records.select("file_name", "line_no", F.try_parse_json("raw_line").alias("value"))
    return parsed.where("value IS NOT NULL AND startswith(schema_of_variant(value), 'OBJECT')").select("file_name", "line_no", F.try_variant_get("value", "$.id", "string").alias("id"), "value")


def fields_of(parsed: DataFrame) -> DataFrame:
    """One row for each non-null field of a readable record: (file_name, line_no, id, path, type, json)."""
    top = parsed.select("file_name", "line_no", "id", F.explode(F.col("value").cast("map<string,variant>")).alias("key", "field"))
    nested = F.expr("if(key = 'properties' AND startswith(schema_of_variant(field), 'OBJECT'), cast(field AS map<string,variant>), map(key, field))")
    paths = top.withColumn("inner", nested).select("file_name", "line_no", "id", "key", F.explode("inner").alias("sub", "field"))
    path = F.when((F.col("key") == "properties") & (F.col("sub") != "properties"), F.concat(F.lit("properties."), "sub")).otherwise(F.col("sub"))
    return (
        paths.where("key <> 'properties' OR NOT startswith(schema_of_variant(field), 'OBJECT') OR sub <> 'properties'")
        .select("file_name", "line_no", "id", path.alias("path"), json_type(F.expr("schema_of_variant(field)")).alias("type"), F.to_json("field").alias("json"))
        .where("type <> 'null'")
    )


def json_type(schema: Column) -> Column:
    """The JSON type of a VARIANT schema text; of an array together with that of its elements."""

    def scalar(of: Column) -> Column:
        return (
            F.when(of.startswith("OBJECT"), "object")
            .when(of.startswith("STRING"), "string")
            .when(of.startswith("BOOLEAN"), "boolean")
            .when(of.startswith("ARRAY"), "array")
            .when(of.startswith("VOID"), "null")
            .when(of.startswith("VARIANT"), "mixed")
            .otherwise("number")
        )

    return F.when(schema.startswith("ARRAY<"), F.concat(F.lit("array of "), scalar(F.substring(schema, 7, 1 << 30)))).otherwise(scalar(schema))


def file_fields(fields: DataFrame, parsed: DataFrame) -> DataFrame:
    """The fields that each file has: (file_name, path, type).

    A file has a field if at least a fifth of its readable records hold a non-null value of it; its
    type is that of most values, arrays without elements counting only where there is nothing else,
    ties going to the first type by name.
    """
    counts = fields.groupBy("file_name", "path", "type").agg(F.countDistinct("line_no").alias("n"))
    empty = F.col("type") == "array of null"
    by_path = counts.groupBy("file_name", "path").agg(F.sum("n").alias("held"), F.min(F.struct(empty, -F.col("n"), "type")).getField("type").alias("type"))
    totals = parsed.groupBy("file_name").agg(F.countDistinct("line_no").alias("readable"))
    return by_path.join(totals, "file_name").where(F.col("held") >= PRESENCE * F.col("readable")).select("file_name", "path", "type")


def content(json: Column) -> Column:
    """The distinct values written in a JSON text, whatever its structure: strings, numbers, and keys."""
    parts = F.split(F.lower(json), r'["\[\]{}:,;|\\]+')
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def program_map(programs: DataFrame) -> Column:
    """Programme numbers to codes, as a map column.  The programme table is fixed (60 rows)."""
    rows = programs.where("program_no IS NOT NULL AND program_code IS NOT NULL").select(F.col("program_no").cast("string").alias("n"), "program_code").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the programme table is a fixed small table")
    entries = [F.lit(x) for r in rows for x in (r.n, r.program_code)]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def _consecutive(files: DataFrame) -> DataFrame:
    """The files whose schema is another than that of the file ``before`` in their feed."""
    feed = Window.partitionBy("feed_id").orderBy("file_seq")
    both = files.withColumn("before", F.lag("file_name").over(feed)).withColumn("print_before", F.lag("fingerprint").over(feed))
    return both.where("before IS NOT NULL AND fingerprint <> print_before").select("feed_id", "file_seq", "file_name", "before")


def read_once(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, fields): the readable records as (file_name, line_no, id), and their fields, both written down once."""
    parsed = readable(records)
    return cut_lineage(parsed.select("file_name", "line_no", "id")), cut_lineage(fields_of(parsed))


def fingerprints(has: DataFrame) -> DataFrame:
    """(file_name, fingerprint) of the files that have fields: a hash of their sorted (path, type) pairs."""
    return has.groupBy("file_name").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "type")))), 256).alias("fingerprint"))


def with_fingerprints(feed: DataFrame, has: DataFrame) -> DataFrame:
    """The files of feeds with the fingerprint of their schema; one without readable records has that of no fields."""
    return feed.join(fingerprints(has), "file_name", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.sha2(F.lit("[]"), 256)))


def schema_changes(files: DataFrame, records: DataFrame, programs: DataFrame, *, list_numbers: Mapping[str, str] = LIST_NUMBERS) -> DataFrame:
    """Each change between a file and the one before it in its feed.

    (feed_id, file_seq, file_name, change_kind, from_path, to_path, from_type, to_type), with the kinds
    ``added``, ``removed``, ``renamed`` and ``retyped``.  A field is renamed if its path vanished, another
    appeared, and at least half of the ids that go on hold overlapping values in both; each field is
    renamed at most once, the pair with most such ids first.  A file without readable records has no
    fields; a file named by no row of ``files`` is ignored.  Content is compared as the set of values
    written, so that a change of type, of separators, or from codes to numbers does not hide a rename.
    """
    parsed, fields = read_once(records)
    return changes_between(feed_files(files), parsed, fields, programs, list_numbers=list_numbers)


def changes_between(feed: DataFrame, parsed: DataFrame, fields: DataFrame, programs: DataFrame, *, list_numbers: Mapping[str, str] = LIST_NUMBERS) -> DataFrame:
    """``schema_changes`` from files, readable records and their fields: the migration steps between schema versions.

    A file with the fingerprint of the one before it in its feed is of the same version and has no step; only the
    others are compared field by field.

    What is written in between has a row for each field of a file, or for each id and vanished or new
    field of a file pair in which fields of both kinds occur.
    """
    has = cut_lineage(file_fields(fields, parsed))
    pairs = cut_lineage(_consecutive(with_fingerprints(feed, has)))
    new = pairs.join(has, "file_name").select("feed_id", "file_seq", "file_name", "before", "path", F.col("type").alias("to_type"))
    old = pairs.join(has.withColumnRenamed("file_name", "before"), "before").select("feed_id", "file_seq", "file_name", "before", "path", F.col("type").alias("from_type"))
    both = cut_lineage(old.join(new, ["feed_id", "file_seq", "file_name", "before", "path"], "full_outer"))
    gone, come = both.where("to_type IS NULL"), both.where("from_type IS NULL")
    at = ["feed_id", "file_seq", "file_name", "before"]
    # values of vanished fields in the old file, and of new fields in the new one, by id
    numbers = program_map(programs)
    lists = F.create_map(*[F.lit(x.lower()) for kv in list_numbers.items() for x in kv])
    known = lambda t: F.coalesce(F.lower(numbers[t]), lists[t], t)
    open_pairs = gone.select(*at).distinct().join(come.select(*at).distinct(), at)
    vanished = gone.join(open_pairs, at, "left_semi").select(*at, "path")
    appeared = come.join(open_pairs, at, "left_semi").select(*at, "path")
    asked_for = vanished.select(F.col("before").alias("file_name"), "path").union(appeared.select("file_name", "path")).distinct()
    values = fields.where("id IS NOT NULL").join(asked_for, ["file_name", "path"], "left_semi").groupBy("file_name", "path", "id").agg(F.min(F.struct("line_no", "json")).getField("json").alias("json"))
    values = cut_lineage(values.select("file_name", "path", "id", F.transform(content("json"), known).alias("held")))
    before = vanished.join(values.withColumnRenamed("file_name", "before"), ["before", "path"]).select(*at, "id", F.col("path").alias("from_path"), F.col("held").alias("was"))
    after = appeared.join(values, ["file_name", "path"]).select(*at, "id", F.col("path").alias("to_path"), F.col("held").alias("now"))
    goes_on = parsed.where("id IS NOT NULL").join(open_pairs.select("file_name"), "file_name", "left_semi").select("file_name", "id").distinct()
    asked = before.join(goes_on, ["file_name", "id"], "left_semi").groupBy(*at, "from_path").agg(F.count(F.lit(1)).alias("asked"))
    same = before.join(after, [*at, "id"]).where(F.arrays_overlap("was", "now")).groupBy(*at, "from_path", "to_path").agg(F.count(F.lit(1)).alias("same"))
    likely = same.join(asked, [*at, "from_path"]).where(F.col("same") >= SAME_CONTENT * F.col("asked"))
    rank = lambda by, other: F.row_number().over(Window.partitionBy(*at, by).orderBy(F.desc("same"), other))
    renamed = cut_lineage(likely.select(*at, "from_path", "to_path", rank("from_path", "to_path").alias("r1"), rank("to_path", "from_path").alias("r2")).where("r1 = 1 AND r2 = 1").drop("r1", "r2"))
    moved = (
        renamed.join(gone.select(*at, F.col("path").alias("from_path"), "from_type"), [*at, "from_path"])
        .join(come.select(*at, F.col("path").alias("to_path"), "to_type"), [*at, "to_path"])
        .select(*at, "from_path", "to_path", "from_type", "to_type")
    )
    stayed = both.where("from_type IS NOT NULL AND to_type IS NOT NULL").select(*at, F.col("path").alias("from_path"), F.col("path").alias("to_path"), "from_type", "to_type")
    left = gone.join(renamed.select(*at, F.col("from_path").alias("path")), [*at, "path"], "left_anti").select(*at, F.col("path").alias("from_path"), F.lit(None).cast("string").alias("to_path"), "from_type", "to_type")
    new_ones = come.join(renamed.select(*at, F.col("to_path").alias("path")), [*at, "path"], "left_anti").select(*at, F.lit(None).cast("string").alias("from_path"), F.col("path").alias("to_path"), "from_type", "to_type")
    every = moved.unionByName(stayed).unionByName(left).unionByName(new_ones)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("to_path").isNull(), "removed"),
            F.when(F.col("from_path").isNull(), "added"),
            F.when(F.col("from_path") != F.col("to_path"), "renamed"),
            F.when(F.col("from_type") != F.col("to_type"), "retyped"),
        )
    )
    return every.withColumn("change_kind", F.explode(kinds)).select("feed_id", "file_seq", "file_name", "change_kind", "from_path", "to_path", "from_type", "to_type")


def found_changes(changes: DataFrame) -> DataFrame:
    """``schema_changes`` as (file_name, field_path, change_kind): new fields under their new path, others under the old."""
    return changes.select("file_name", F.coalesce("from_path", "to_path").alias("field_path"), "change_kind")


def schema_versions(files: DataFrame, records: DataFrame) -> DataFrame:
    """(feed_id, file_seq, file_name, fingerprint, version): a version goes up where the fingerprint changes.

    The fingerprint hashes the sorted (path, type) pairs that the file has; a file without readable
    records has that of no fields.
    """
    parsed, fields = read_once(records)
    feed = Window.partitionBy("feed_id").orderBy("file_seq")
    rows = with_fingerprints(feed_files(files), file_fields(fields, parsed))
    step = F.when(F.lag("fingerprint").over(feed).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return rows.withColumn("step", step).select("feed_id", "file_seq", "file_name", "fingerprint", F.sum("step").over(feed).cast("int").alias("version"))


def spelling(path: Column) -> Column:
    """The form in which a single record's departing field names equal those of its file."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"^properties\.", ""), "_+$", ""))


def migration_rules(feed: DataFrame, changes: DataFrame, fields: DataFrame, programs: DataFrame, *, list_numbers: Mapping[str, str] = LIST_NUMBERS, base_paths: Mapping[str, Mapping[str, str]] = BASE_PATHS) -> DataFrame:
    """(feed_id, spelling, target): which field names of a feed hold which canonical field.

    Starting at the first file's layout, every rename step passes a field's target on to its new path.
    A field that appears anew, or that a feed's first file already has under another path, has its
    target by content: programme codes or numbers, or list names.
    """
    base = [F.struct(F.lit(f).alias("file_format"), F.lit(t).alias("target"), F.lit(p).alias("path")) for f, paths in base_paths.items() for t, p in paths.items()]
    start = feed.select("feed_id", "file_format").distinct().withColumn("b", F.explode(F.array(*base))).where("b.file_format = file_format").select("feed_id", "b.path", "b.target", F.lit(0).alias("way"))
    steps = changes.where("change_kind = 'renamed'").select("feed_id", "file_seq", "from_path", "to_path")

    def chained(key, own_start, own_steps):
        import pandas as pd

        target = dict(zip(own_start["path"], own_start["target"]))
        for r in own_steps.sort_values(["file_seq", "from_path"]).itertuples():
            if r.from_path in target:
                target.setdefault(r.to_path, target[r.from_path])
        return pd.DataFrame({"feed_id": key[0], "path": list(target), "target": list(target.values()), "way": 0})

    chain = start.groupBy("feed_id").cogroup(steps.groupBy("feed_id")).applyInPandas(chained, "feed_id long, path string, target string, way int")
    codes = F.map_values(program_map(programs))
    numbers = F.map_keys(program_map(programs))
    vocabulary = F.transform(F.concat(codes, numbers), lambda x: F.lower(x))
    names = F.array(*[F.lit(v.lower()) for v in list_numbers.values()])
    held = content("json")
    like = F.when(F.exists(held, lambda x: F.array_contains(vocabulary, x)), "programs").when(F.exists(held, lambda x: F.array_contains(names, x)), "list")
    guessed = (
        fields.join(feed.select("feed_id", "file_name"), "file_name")
        .withColumn("target", like)
        .groupBy("feed_id", "path")
        .agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("k"), F.mode("target", True).alias("target"))
        .where("k >= 0.8 * n AND path NOT IN ('id', 'schema')")
        .select("feed_id", "path", "target", F.lit(1).alias("way"))
    )
    rules = chain.unionByName(guessed).withColumn("spelling", spelling(F.col("path")))
    return rules.groupBy("feed_id", "spelling").agg(F.min(F.struct("way", "path", "target")).getField("target").alias("target"))


def consistent_records(files: DataFrame, records: DataFrame, programs: DataFrame, *, list_numbers: Mapping[str, str] = LIST_NUMBERS, base_paths: Mapping[str, Mapping[str, str]] = BASE_PATHS) -> DataFrame:
    """All readable records in one table: (feed_id, file_seq, file_name, line_no, id, name, aliases, nationality, dob, list, programs).

    Each file goes through its feed's chain of renames, then defaults (a missing list is the file's
    default list), then casts: names and dates to text, aliases and programmes to arrays whatever
    their notation, numbers of programmes and lists to codes, countries to upper case.  A record
    sent twice in a file is one row for each of its lines; a file sent twice counts once.  Fields that
    a record lacks are null, or empty arrays.
    """
    parsed, fields = read_once(records)
    feed = feed_files(files)
    changes = cut_lineage(changes_between(feed, parsed, fields, programs, list_numbers=list_numbers))
    rules = cut_lineage(migration_rules(feed, changes, fields, programs, list_numbers=list_numbers, base_paths=base_paths))
    numbers = program_map(programs)
    lists = F.create_map(*[F.lit(x) for kv in list_numbers.items() for x in kv])
    lines = parsed.groupBy("file_name", "line_no").agg(F.max("id").alias("id"))
    held = (
        fields.join(feed, "file_name")
        .withColumn("spelling", spelling(F.col("path")))
        .join(rules, ["feed_id", "spelling"])
        .groupBy("file_name", "line_no")
        .agg(*[F.min(F.when(F.col("target") == t, F.col("json"))).alias(t) for t in ("name", "aliases", "nationality", "dob", "list", "programs")])
    )
    # JSON text to a list of its values: objects give their "code", or their keys
    coded = lambda j: F.from_json(j, "array<struct<code:string>>").getField("code")
    listed = lambda j, cut: (
        F.when(j.rlike(r'^\[\s*\{'), coded(j))
        .when(j.startswith("["), F.from_json(j, "array<string>"))
        .when(j.startswith("{"), F.coalesce(F.array_compact(F.array(F.get_json_object(j, "$.code"))), F.array().cast("array<string>")))
        .otherwise(F.transform(F.split(F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"), cut), lambda x: F.trim(x)))
    )
    keys = lambda j: F.when(j.startswith("{") & F.get_json_object(j, "$.code").isNull(), F.map_keys(F.from_json(j, "map<string,string>")))
    several = lambda c, cut: F.filter(F.coalesce(keys(F.col(c)), listed(F.col(c), cut), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    one = lambda c: F.get(several(c, r"\u0000"), F.lit(0))
    rows = lines.join(held, ["file_name", "line_no"], "left").join(feed, "file_name")
    return rows.select(
        "feed_id",
        "file_seq",
        "file_name",
        "line_no",
        "id",
        one("name").alias("name"),
        several("aliases", r"\|").alias("aliases"),
        F.upper(one("nationality")).alias("nationality"),
        one("dob").alias("dob"),
        F.coalesce(lists[one("list")], one("list"), "default_list").alias("list"),
        F.transform(several("programs", "[;,|]"), lambda x: F.coalesce(numbers[x], x)).alias("programs"),
    )
