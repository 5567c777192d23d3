"""Queries of the name-screening engine, with SQL for those that SQL can express."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.functions import normalize as N
from namelens.functions.similarity import token_pairs
from namelens.operators import aggregates, screening
from namelens.operators.blocking import keyed_candidates
from namelens.sources.loaders import stored_people
from namelens.sources.store import last_of_each_id, replaced
from namelens.session import cut_lineage, table


def _names(spark: SparkSession, d: str) -> DataFrame:
    """All names of the star schema, distinct."""
    parts = [table(spark, d, t).select(F.col(c).alias("name")) for t, c in (("supplier", "s_name"), ("customer", "c_name"), ("nation", "n_name"), ("part", "p_name"))]
    names = parts[0]
    for p in parts[1:]:
        names = names.union(p)
    return names.where("name IS NOT NULL").distinct()


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    """The two punctuation variants of every name."""
    fold = _names(spark, d).withColumn("fold", N.folded(F.col("name")))
    return fold.select("name", N.base_text(F.col("fold")).alias("base"), N.compact_text(F.col("fold")).alias("no_punct"))


def variants_exploded(spark: SparkSession, d: str) -> DataFrame:
    """Every search variant of every name."""
    found = N.with_variants(_names(spark, d), "name", "v").select("name", F.explode("v").alias("v"))
    return found.select("name", "v.pos", "v.text", "v.label", F.size("v.tokens").alias("n_tokens"))


def list_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every search variant of every watchlist name, in all scripts."""
    found = N.with_variants(table(spark, d, "sanctions_list").select("id", "name"), "name", "v").select("id", F.explode("v").alias("v"))
    return found.select("id", "v.pos", "v.text", "v.label")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(name, token, key): the tokens of part names and the keys they are blocked by."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", F.explode(N.tokenize(N.base_text(N.folded(F.col("name"))))).alias("token")).select("name", "token", F.substring("token", 1, 2).alias("key"))


def initials(spark: SparkSession, d: str) -> DataFrame:
    """The initials of part names and their variant by initials."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", N.initials(F.col("name")).alias("initials"), N.initials_variant(F.col("name")).alias("short"))


def transliterate(spark: SparkSession, d: str) -> DataFrame:
    """Cyrillic names in Latin letters by both schemes."""
    names = spark.createDataFrame([("Владимир Путин",), ("Юрий",), ("Харьков",), ("Южный",), ("Євген",), ("Їжак",), ("Ґрунт",), ("объект",), ("Smith",)], "name string")
    return names.select("name", F.posexplode(N.transliterate(F.col("name"))).alias("pos", "latin"))


def _part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("name")).distinct()


def _pairs(names: DataFrame, letters: int) -> DataFrame:
    """Pairs of names of which words begin with the same letters."""
    keyed = names.select("name", F.explode(F.array_distinct(F.transform(F.split("name", " "), lambda x: F.left(x, F.lit(letters))))).alias("key"))
    return keyed.select(F.col("name").alias("a"), "key").join(keyed.select(F.col("name").alias("b"), "key"), "key").select("a", "b").distinct()


def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler of each pair of part names that share a key."""
    return _pairs(_part_names(spark, d), 2).select("a", "b", F.round(screening.jaro_winkler_column("a", "b"), 6).alias("score"))


@F.pandas_udf(T.DoubleType())
def _token_pair(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(token_pairs(left.tolist(), right.tolist()))


def token_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of each pair of words of part names that begin with the same letter."""
    words = _part_names(spark, d).select(F.explode(F.split("name", " ")).alias("name")).distinct()
    return _pairs(words, 1).select("a", "b", F.round(_token_pair("a", "b"), 6).alias("score"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of part names and brands or types of parts that share a key."""
    keyed = lambda df, to: N.with_variants(df, "name", "v").select(F.col("name").alias(to), N.prefix_keys(F.col("v")).alias("keys"))
    queries = keyed(_part_names(spark, d), "qid").withColumn("lists", F.array().cast("array<string>"))
    entries = keyed(table(spark, d, "part").select(F.col("p_brand").alias("name")).union(table(spark, d, "part").select("p_type")).where("name IS NOT NULL").distinct(), "entry").withColumn("list_type", F.lit("X"))
    return keyed_candidates(queries, entries).select(F.col("qid").alias("name"), F.col("entry").alias("other"))


def _part_list(spark: SparkSession, d: str) -> DataFrame:
    """Part names as a watchlist, each with its words reversed as an alias."""
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    people = _part_names(spark, d).select(F.col("name").alias("id"), "name", F.array(turned).alias("aliases"), F.lit("").alias("nationality"), F.lit("OFAC").alias("list_type"))
    return cut_lineage(screening.prepare_watchlist(people))


def screen_alias(spark: SparkSession, d: str) -> DataFrame:
    """Reversed part names against the list at a threshold that aliases reach."""
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    inputs = _part_names(spark, d).select(F.xxhash64("name").alias("input_id"), turned.alias("name"))
    return screening.screen(inputs, _part_list(spark, d), 0.95).where("match_type IN ('exact', 'alias')").select("input_name", "person_id", "score", "match_type")


def screen_alias_gated(spark: SparkSession, d: str) -> DataFrame:
    """The same at a threshold above aliases: what is left are equal names and equal words in another order."""
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    inputs = _part_names(spark, d).select(F.xxhash64("name").alias("input_id"), turned.alias("name"))
    return screening.screen(inputs, _part_list(spark, d), 1.0).select("input_name", "person_id", "score", "match_type")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "screen_request").select(F.col("request_id").alias("input_id"), "name", "threshold", "lists")


def _watchlist(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(screening.prepare_watchlist(stored_people(table(spark, d, "sanctions_list"))))


def screen_requests(spark: SparkSession, d: str) -> DataFrame:
    """All screening requests against the stored watchlist."""
    found = screening.screen(_requests(spark, d), _watchlist(spark, d), full=False)
    return found.select("input_id", "input_name", "rank", "person_id", "name", F.round("score", 6).alias("score"), "match_type", "list", "nationality", F.col("explain.method").alias("method"))


def request_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many entries of the stored watchlist each screening request matches, zeros included."""
    requests = _requests(spark, d).distinct()  # a request that was sent twice counts once
    return aggregates.with_zeros(requests, screening.counted(requests, _watchlist(spark, d)))


def list_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each list, one unknown list among them."""
    return aggregates.list_counts(stored_people(table(spark, d, "sanctions_list")), ["OFAC", "EU", "UN", "HMT", "SECO", "NONE"])


def replace_by_list(spark: SparkSession, d: str) -> DataFrame:
    """The first snapshot after the lists UN and EU of the second were imported over it."""
    rows = table(spark, d, "list_snapshot").select("snapshot_no", "row_no", F.upper(F.trim("id")).alias("id"), "name", "list_type")
    stored = last_of_each_id(rows.where("snapshot_no = 1").select("id", "name", "list_type", F.col("row_no").alias("_order")))
    batch = last_of_each_id(rows.where("snapshot_no = 2 AND list_type IN ('UN', 'EU')").select("id", "name", "list_type", F.col("row_no").alias("_order")))
    return replaced(stored, batch)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_names, variants_exploded, list_variants, tokens, initials, transliterate, jaro_winkler_pairs, token_pair_scores, candidate_pairs, screen_alias, screen_alias_gated, screen_requests,
        request_counts, list_counts, replace_by_list,
    )
}

_ALL_NAMES = """names AS (SELECT DISTINCT name FROM (SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_name FROM part) WHERE name IS NOT NULL)"""
_BASE = r"trim(regexp_replace(regexp_replace(lower(name), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'))"
_COMPACT = r"trim(regexp_replace(regexp_replace(lower(name), '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g'))"
_WINKLER = """CASE WHEN a = b THEN 1.0 ELSE jaro_similarity(a, b) + 0.1 * (CASE WHEN left(a, 4) = left(b, 4) AND least(length(a), length(b)) >= 4 THEN 4 WHEN left(a, 3) = left(b, 3) AND least(length(a), length(b)) >= 3 THEN 3 WHEN left(a, 2) = left(b, 2) AND least(length(a), length(b)) >= 2 THEN 2 WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END) * (1 - jaro_similarity(a, b)) END"""

ORACLE_SQL = {
    "normalize_names": f"WITH {_ALL_NAMES} SELECT name, {_BASE} AS base, {_COMPACT} AS no_punct FROM names",
    "variants_exploded": f"""WITH {_ALL_NAMES}, v AS (SELECT name, {_BASE} AS base, {_COMPACT} AS compact FROM names), e AS (
SELECT name, 0 AS pos, base AS text, 'base' AS label FROM v UNION ALL SELECT name, 1, compact, 'no_punct' FROM v WHERE compact <> base)
SELECT name, CAST(pos AS INTEGER) AS pos, text, label, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens FROM e""",
    "tokens": "WITH t AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(string_split(lower(name), ' ')) AS token FROM t) SELECT name, token, left(token, 2) AS key FROM w",
    "initials": "SELECT DISTINCT p_name AS name, left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1) AS initials, left(split_part(p_name, ' ', 1), 1) || ' ' || split_part(p_name, ' ', 2) AS short FROM part",
    "transliterate": """SELECT name, CAST(pos AS INTEGER) AS pos, latin FROM (VALUES
('Владимир Путин', 0, 'vladimir putin'), ('Владимир Путин', 1, 'vladymyr putyn'), ('Юрий', 0, 'yuriy'), ('Юрий', 1, 'iuryy'), ('Харьков', 0, 'kharkov'), ('Харьков', 1, 'harkov'),
('Южный', 0, 'yuzhnyy'), ('Южный', 1, 'iuzhnyy'), ('Євген', 0, 'yevgen'), ('Євген', 1, 'ievgen'), ('Їжак', 0, 'yizhak'), ('Їжак', 1, 'jizhak'), ('Ґрунт', 0, 'grunt'), ('объект', 0, 'obekt')) t(name, pos, latin)""",
    "jaro_winkler_pairs": f"WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL), k AS (SELECT name, left(unnest(string_split(name, ' ')), 2) AS k FROM n), p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM k x JOIN k y USING (k)) SELECT a, b, round({_WINKLER}, 6) AS score FROM p",
    "token_pair_scores": f"""WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part WHERE p_name IS NOT NULL), p AS (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON left(x.name, 1) = left(y.name, 1))
SELECT a, b, round(CASE WHEN a = b THEN 1.0 WHEN starts_with(a, b) OR starts_with(b, a) THEN (CASE WHEN length(a) = 1 OR length(b) = 1 THEN 0.85 ELSE 0.9 END) ELSE {_WINKLER} END, 6) AS score FROM p""",
    "candidate_pairs": f"""WITH q AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL), o AS (SELECT DISTINCT name FROM (SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part) WHERE name IS NOT NULL),
qk AS (SELECT DISTINCT name, left(unnest(string_split({_BASE}, ' ') || string_split({_COMPACT}, ' ')), 2) AS k FROM q), ok AS (SELECT DISTINCT name, left(unnest(string_split({_BASE}, ' ') || string_split({_COMPACT}, ' ')), 2) AS k FROM o)
SELECT DISTINCT qk.name AS name, ok.name AS other FROM qk JOIN ok USING (k)""",
    "screen_alias": """WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS turned FROM part WHERE p_name IS NOT NULL)
SELECT i.turned AS input_name, e.name AS person_id, CAST(CASE WHEN i.turned = e.name THEN 1.0 ELSE 0.95 END AS DOUBLE) AS score, CASE WHEN i.turned = e.name THEN 'exact' ELSE 'alias' END AS match_type FROM n i JOIN n e ON i.turned = e.name OR i.turned = e.turned""",
    "screen_alias_gated": """WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS turned FROM part WHERE p_name IS NOT NULL)
SELECT i.turned AS input_name, e.name AS person_id, CAST(1.0 AS DOUBLE) AS score, CASE WHEN i.turned = e.name THEN 'exact' ELSE 'fuzzy' END AS match_type FROM n i JOIN n e ON i.turned = e.name OR i.turned = e.turned""",
    "list_counts": "SELECT l.list, count(s.id) AS count FROM (VALUES ('OFAC'), ('EU'), ('UN'), ('HMT'), ('SECO'), ('NONE')) l(list) LEFT JOIN sanctions_list s ON s.list_type = l.list GROUP BY 1",
    "replace_by_list": """WITH r AS (SELECT *, upper(trim(id)) AS nid FROM list_snapshot), s AS (SELECT nid AS id, name, list_type FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY row_no DESC) AS k FROM r WHERE snapshot_no = 1) WHERE k = 1),
b AS (SELECT nid AS id, name, list_type FROM (SELECT *, row_number() OVER (PARTITION BY nid ORDER BY row_no DESC) AS k FROM r WHERE snapshot_no = 2 AND list_type IN ('UN', 'EU')) WHERE k = 1)
SELECT * FROM s WHERE list_type NOT IN (SELECT list_type FROM b) AND id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b""",
}
