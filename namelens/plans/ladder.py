"""Queries for the rungs of matching, the readers and the store, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions import normalize as N
from namelens.operators import aggregates, blocking, screening
from namelens.session import cut_lineage, shared_folder, table
from namelens.sources import loaders
from namelens.sources.loaders import stored_people
from namelens.sources.store import last_of_each_id, replaced

_PERSON = "id string, name string, aliases array<string>, nationality string, list_type string"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_name IS NOT NULL").select(F.col("p_name").alias("name")).distinct()


def _listed(names: DataFrame, list_type: str = "OFAC") -> DataFrame:
    """Names as a watchlist, each its own id."""
    return cut_lineage(screening.prepare_watchlist(names.select(F.col("name").alias("id"), "name", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("nationality"), F.lit(list_type).alias("list_type"))))


def _asked(names: DataFrame) -> DataFrame:
    return names.select(F.xxhash64("name").alias("input_id"), "name")


def token_match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The order-independent similarity of each pair of part names of which words begin with the same two letters."""
    keyed = _parts(spark, d).select("name", F.explode(F.array_distinct(F.transform(F.split("name", " "), lambda x: F.left(x, F.lit(2))))).alias("key"))
    pairs = keyed.select(F.col("name").alias("a"), "key").join(keyed.select(F.col("name").alias("b"), "key"), "key").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(screening.token_match_column("a", "b"), 6).alias("score"))


def fallback_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Nations that no part name shares a key with: they are compared with the whole list."""
    nations = table(spark, d, "nation").select(F.col("n_name").alias("qid")).where("qid IS NOT NULL").distinct()
    spelt = N.with_variants(nations, "qid", "v", query=True)
    queries = spelt.select("qid", F.array().cast("array<string>").alias("lists"), F.get("v", F.lit(0))["text"].alias("base"), N.prefix_keys(F.col("v")).alias("keys"))
    return blocking.scanning(queries, _listed(_parts(spark, d))).select(F.col("qid").alias("name"))


def screen_exact(spark: SparkSession, d: str) -> DataFrame:
    """Part names in upper case with other punctuation against the part names, at the highest threshold."""
    inputs = _parts(spark, d).select(F.xxhash64("name").alias("input_id"), F.upper(F.replace("name", F.lit(" "), F.lit("-"))).alias("name"))
    return screening.screen(inputs, _listed(_parts(spark, d)), 1.0).select("input_name", "person_id", "score", "match_type", F.col("explain.method").alias("method"))


def screen_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Part names without their last letter against the part names: the better of token and string scores that reach 0.8."""
    inputs = _parts(spark, d).select(F.xxhash64("name").alias("input_id"), F.expr("left(name, length(name) - 1)").alias("name"))
    return screening.screen(inputs, _listed(_parts(spark, d)), 0.8).select("input_name", "person_id", F.round("score", 6).alias("score"), "match_type")


def screen_initials(spark: SparkSession, d: str) -> DataFrame:
    """The initials of part names against the part names, at a threshold that initials reach."""
    inputs = _parts(spark, d).select(N.initials(F.col("name")).alias("name")).distinct()
    return screening.screen(_asked(inputs), _listed(_parts(spark, d)), 0.3).select("input_name", "person_id", F.round("score", 6).alias("score"), "match_type")


def screen_translit_exact(spark: SparkSession, d: str) -> DataFrame:
    """Names across scripts, in both directions."""
    people = spark.createDataFrame([("A", "Владимир Путин", [], "RU", "EU"), ("B", "Vladimir Putin", [], "RU", "OFAC"), ("C", "Юрий", ["Yurii"], "UA", "UN")], _PERSON)
    inputs = spark.createDataFrame([(1, "Vladimir Putin"), (2, "Владимир Путин"), (3, "Yurii")], "input_id long, name string")
    found = screening.screen(inputs, cut_lineage(screening.prepare_watchlist(people)), 0.95)
    return found.select("input_id", "person_id", "score", "match_type", F.col("explain.method").alias("method"), F.col("explain.is_translit").alias("is_translit"))


def screen_batch(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations asked for in one batch against the nations: how many matches each has, and their ids in order."""
    asked = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name")).where("name IS NOT NULL").distinct()
    inputs = _asked(asked)
    matches = screening.screen(inputs, _listed(table(spark, d, "nation").select(F.col("n_name").alias("name")).where("name IS NOT NULL").distinct()), 1.0)
    answer = aggregates.batch_response(inputs, matches)
    return answer.select("input_name", F.col("count").cast("long").alias("count"), F.array_join(F.transform("matches", lambda m: m["person_id"]), ",").alias("ids"))


def batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many suppliers each supplier's name matches at the highest threshold, all suppliers being listed."""
    suppliers = table(spark, d, "supplier")
    inputs = suppliers.select(F.col("s_suppkey").alias("input_id"), F.col("s_name").alias("name"))
    people = suppliers.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("nationality"), F.lit("EU").alias("list_type"))
    return aggregates.with_zeros(inputs, screening.counted(inputs, cut_lineage(screening.prepare_watchlist(people)), 1.0))


def total_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many matches all suppliers' names have among the suppliers and nations, at the highest threshold."""
    listed = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(table(spark, d, "nation").select("n_name")).where("name IS NOT NULL").distinct()
    inputs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("input_id"), F.col("s_name").alias("name"))
    return screening.counted(inputs, _listed(listed), 1.0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))


def normalize_diacritics(spark: SparkSession, d: str) -> DataFrame:
    """The folded form of every watchlist name that is written in Latin letters with marks."""
    names = table(spark, d, "sanctions_list").select("name").where(F.col("name").rlike(r"^[A-Za-zÀ-ÖØ-öø-ÿŁłŚśŠšŽžĞğŞşİ .,'&()-]*\z")).distinct()
    return names.select("name", N.base_text(N.folded(F.col("name"))).alias("base"))


def blank_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names of requests hold no letter."""
    return table(spark, d, "screen_request").where("name IS NOT NULL").select("name").distinct().select("name", N.is_blank_name(F.col("name")).alias("blank"))


def missing_list_zero(spark: SparkSession, d: str) -> DataFrame:
    """The counts of two lists that nobody is on and of one that exists."""
    return aggregates.list_counts(stored_people(table(spark, d, "sanctions_list")), ["NONE", "ofac", "SECO"])


def list_filter(spark: SparkSession, d: str) -> DataFrame:
    """Nations asked for in one of two lists that both hold them."""
    nations = table(spark, d, "nation").select(F.col("n_name").alias("name")).where("name IS NOT NULL").distinct()
    people = nations.select("name", F.explode(F.array(F.lit("EU"), F.lit("UN"))).alias("list_type")).select(F.concat("list_type", F.lit(" "), "name").alias("id"), "name", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("nationality"), "list_type")
    return screening.screen(_asked(nations), cut_lineage(screening.prepare_watchlist(people)), 1.0, ["UN", "NONE"]).select("input_name", "person_id", F.col("list"))


def _snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "list_snapshot")
    return rows.select("snapshot_no", "row_no", F.upper(F.trim("id")).alias("id"), "name", "list_type", F.format_string("%06d %012d", "snapshot_no", "row_no").alias("_order"))


def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each id over all snapshots."""
    return last_of_each_id(_snapshot_rows(spark, d).where("id IS NOT NULL")).select("id", "snapshot_no", "row_no", "name", "list_type")


def cross_list_move(spark: SparkSession, d: str) -> DataFrame:
    """Ids that another list brings with it when the last snapshot is imported over all that came before."""
    rows = _snapshot_rows(spark, d).where("id IS NOT NULL")
    stored = last_of_each_id(rows.where("snapshot_no < 10").select("id", "name", "list_type", "_order"))
    batch = last_of_each_id(rows.where("snapshot_no = 10").select("id", "name", "list_type", "_order"))
    after = replaced(stored, batch)
    return after.join(stored.select("id", F.col("list_type").alias("from_list")), "id").where("list_type <> from_list").select("id", "from_list", F.col("list_type").alias("to_list"))


def _written(spark: SparkSession, text: str) -> str:
    """The path of a text file with these lines in the folder that all executors share."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _shown(people: DataFrame) -> DataFrame:
    return people.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.coalesce(F.col("dob").cast("string"), F.lit("")).alias("dob"), "nationality", "list_type", F.array_join("roles", "|").alias("roles"))


def load_csv(spark: SparkSession, d: str) -> DataFrame:
    """A list in CSV: cells trimmed, quotes and blanks within, the list always the same."""
    text = 'id,name,nationality,more\nC-1, Ann Bell ,SY,x\nC-2,"Bell, ""Ann""",CN,y\nC-3,,,z'
    return _shown(loaders.load_watchlist(spark, _written(spark, text), "csv", "UN"))


def load_json(spark: SparkSession, d: str) -> DataFrame:
    """A list as a JSON array: the list of an entry, else the default; programmes as one text or an array."""
    text = '[{"id":"J-1","name":"Ann Bell","aliases":["A. Bell","Anna"],"list":"OFAC","programs":"P-1","nationality":"SY"},{"id":"J-2","name":"","programs":["P-1","P-2"]},{"id":"J-3","name":"Cy","list":"","aliases":null}]'
    return _shown(loaders.load_watchlist(spark, _written(spark, text), "json", "UN"))


def load_ftm_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A list as JSON lines: persons and organisations with a name; other, blank and unreadable lines are skipped."""
    lines = [
        '{"id":"F-1","schema":"Person","properties":{"name":["Ann Bell","Anna"],"alias":["","A. B."],"country":["ru","ua"],"birthDate":["1960-01-02"],"programId":["P-1",""]}}',
        "", "   ", '{"id":"F-2","schema":"Company","properties":{"name":["Other"]}}', "{broken",
        '{"id":"F-3","schema":"Organization","properties":{"name":["Cy Ltd"],"birthDate":["1960"]}}',
        '{"id":"F-4","schema":"Person","properties":{"name":[]}}', '{"id":"F-5","schema":"Person","properties":{"name":"Not an array"}}',
        '{"id":"F-6","schema":"Person","properties":{"name":["Dee"],"birthDate":["2024-02-30"],"country":[""]}}',
    ]
    return _shown(loaders.load_watchlist(spark, _written(spark, "\n".join(lines)), "jsonl", "UN"))


QUERIES = {
    f.__name__: f
    for f in (
        token_match_pairs, fallback_inputs, screen_exact, screen_fuzzy, screen_initials, screen_translit_exact, screen_batch, batch_counts, total_matches, normalize_diacritics, blank_names,
        missing_list_zero, list_filter, dedupe_last_wins, cross_list_move, load_csv, load_json, load_ftm_jsonl,
    )
}


def _jaro_winkler(a: str, b: str) -> str:
    same = " ".join(f"WHEN left({a}, {n}) = left({b}, {n}) AND least(length({a}), length({b})) >= {n} THEN {n}" for n in (4, 3, 2, 1))
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_similarity({a}, {b}) + 0.1 * (CASE {same} ELSE 0 END) * (1 - jaro_similarity({a}, {b})) END)"


def _pair(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN starts_with({a}, {b}) OR starts_with({b}, {a}) THEN (CASE WHEN length({a}) = 1 OR length({b}) = 1 THEN 0.85 ELSE 0.9 END) ELSE {_jaro_winkler(a, b)} END)"


def _one(a: str, b: str) -> str:
    """Whether names of a word and a number, as WORD_1 or Word#1, reach the threshold 1: the boost of the last words may lift them there."""
    word, number, joined = (lambda c: f"lower(regexp_extract({c}, '^[A-Za-z]+'))"), (lambda c: f"regexp_extract({c}, '[0-9]+$')"), (lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')")
    return f"({joined(a)} = {joined(b)} OR {_pair(joined(a), joined(b))} + 0.05 >= 1 OR ({word(a)} = {word(b)} AND {_pair(number(a), number(b))} + 0.05 >= 1))"


#: Two words against two, in closed form: the columns s11 to s22 are the scores of words, the last pair with its boost.
_TWO = """(CASE WHEN greatest(s11, s12) > 0
 THEN greatest((greatest(s11, s12) + CASE WHEN s12 > s11 THEN s21 ELSE s22 END) / 2 - (CASE WHEN (CASE WHEN s12 > s11 THEN s21 ELSE s22 END) > 0 THEN 0 ELSE 0.3 END), 0)
 WHEN greatest(s21, s22) > 0 THEN greatest(greatest(s21, s22) / 2 - 0.3, 0) ELSE 0 END)"""
_PARTS = "n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part WHERE p_name IS NOT NULL)"
_WORDS = f"{_pair('q1', 't1')} AS s11, {_pair('q1', 't2')} AS s12, {_pair('q2', 't1')} AS s21, least({_pair('q2', 't2')} + 0.05, 1.0) AS s22"

ORACLE_SQL = {
    "token_match_pairs": f"""WITH {_PARTS}, k AS (SELECT name, w1, w2, left(unnest([w1, w2]), 2) AS k FROM n),
p AS (SELECT DISTINCT x.name AS a, y.name AS b, x.w1 AS q1, x.w2 AS q2, y.w1 AS t1, y.w2 AS t2 FROM k x JOIN k y USING (k)), s AS (SELECT a, b, {_WORDS} FROM p)
SELECT a, b, CAST(round({_TWO}, 6) AS DOUBLE) AS score FROM s""",
    "fallback_inputs": f"""WITH {_PARTS}, k AS (SELECT DISTINCT left(unnest([w1, w2]), 2) AS k FROM n), m AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_name IS NOT NULL),
mk AS (SELECT name, left(unnest(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]', ' ', 'g')), ' ') || [regexp_replace(lower(name), '[^a-z0-9]', '', 'g')]), 2) AS k FROM m)
SELECT name FROM m WHERE name NOT IN (SELECT mk.name FROM mk JOIN k USING (k))""",
    "screen_exact": f"""WITH {_PARTS} SELECT upper(x.w1 || '-' || x.w2) AS input_name, y.name AS person_id, CAST(1.0 AS DOUBLE) AS score, CASE WHEN x.name = y.name THEN 'exact' ELSE 'fuzzy' END AS match_type,
CASE WHEN x.name = y.name THEN 'exact_primary' ELSE 'token' END AS method FROM n x JOIN n y ON x.name = y.name OR (x.w1 = y.w2 AND x.w2 = y.w1)""",
    "screen_fuzzy": f"""WITH {_PARTS}, q AS (SELECT left(name, length(name) - 1) AS input_name, w1 AS q1, left(w2, length(w2) - 1) AS q2 FROM n),
v AS (SELECT input_name, input_name AS text, q1, q2 FROM q UNION ALL SELECT input_name, left(q1, 1) || ' ' || q2, left(q1, 1), q2 FROM q),
p AS (SELECT v.*, n.name AS person_id, n.w1 AS t1, n.w2 AS t2, {_jaro_winkler('v.text', 'n.name')} AS string FROM v JOIN n ON EXISTS (
  SELECT 1 FROM q JOIN (SELECT unnest([left(n.w1, 2), left(n.w2, 2)]) AS k) e ON e.k IN (left(q.q1, 2), left(q.q2, 2), left(q.q1, 1)) WHERE q.input_name = v.input_name)),
s AS (SELECT input_name, person_id, text, string, {_WORDS} FROM p), t AS (SELECT input_name, person_id, text, string, {_TWO} AS token FROM s),
r AS (SELECT input_name, person_id, text = person_id AS same, CASE WHEN token >= 0.8 THEN token WHEN string >= 0.8 THEN string END AS score FROM t)
SELECT input_name, person_id, CAST(round(max(score), 6) AS DOUBLE) AS score, CASE WHEN bool_or(same) THEN 'exact' ELSE 'fuzzy' END AS match_type FROM r WHERE score IS NOT NULL GROUP BY 1, 2""",
    "screen_initials": f"""WITH {_PARTS}, q AS (SELECT DISTINCT left(w1, 1) || left(w2, 1) AS text FROM n), k AS (SELECT text, name FROM q JOIN n ON left(text, 2) IN (left(w1, 2), left(w2, 2))),
c AS (SELECT q.text, n.* FROM q JOIN n ON (q.text, n.name) IN (SELECT (text, name) FROM k) OR q.text NOT IN (SELECT text FROM k)),
s AS (SELECT text, name, {_jaro_winkler('text', 'name')} AS string, text = left(w1, 1) || left(w2, 1) AS fits, greatest({_pair('text', 'w1')}, least({_pair('text', 'w2')} + 0.05, 1.0)) AS word FROM c),
t AS (SELECT text, name, string, fits, CASE WHEN word > 0 THEN greatest(word / 2 - 0.15, 0) ELSE 0 END AS token FROM s),
r AS (SELECT text, name, CASE WHEN token >= 0.3 THEN token WHEN string >= 0.3 THEN string END AS fuzzy, CASE WHEN fits AND string >= 0.3 THEN string END AS initial FROM t)
SELECT text AS input_name, name AS person_id, CAST(round(CASE WHEN initial > coalesce(fuzzy, 0) THEN initial ELSE fuzzy END, 6) AS DOUBLE) AS score, CASE WHEN initial > coalesce(fuzzy, 0) THEN 'initial' ELSE 'fuzzy' END AS match_type
FROM r WHERE fuzzy IS NOT NULL OR initial IS NOT NULL""",
    "screen_translit_exact": """SELECT CAST(a AS BIGINT) AS input_id, b AS person_id, CAST(c AS DOUBLE) AS score, d AS match_type, e AS method, f AS is_translit FROM (VALUES
(1, 'A', 1.0, 'fuzzy', 'transliterated_exact', true), (1, 'B', 1.0, 'exact', 'exact_primary', false), (2, 'A', 1.0, 'exact', 'exact_primary', false), (2, 'B', 1.0, 'fuzzy', 'transliterated_exact', true),
(3, 'C', 0.95, 'alias', 'exact_alias', false)) t(a, b, c, d, e, f)""",
    "screen_batch": """WITH m AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_name IS NOT NULL), q AS (SELECT name FROM m UNION SELECT r_name FROM region WHERE r_name IS NOT NULL)
SELECT q.name AS input_name, count(m.name) AS count, coalesce(string_agg(m.name, ',' ORDER BY m.name), '') AS ids FROM q LEFT JOIN m ON """ + _one("q.name", "m.name") + " GROUP BY 1",
    "batch_counts": "SELECT a.s_suppkey AS input_id, count(b.s_suppkey) AS count FROM supplier a LEFT JOIN supplier b ON " + _one("a.s_name", "b.s_name") + " GROUP BY 1",
    "total_matches": "SELECT count(*) AS total_matches FROM supplier a JOIN (SELECT DISTINCT s_name AS name FROM supplier UNION SELECT n_name FROM nation) b ON " + _one("a.s_name", "b.name"),
    "normalize_diacritics": r"""SELECT DISTINCT name, trim(regexp_replace(regexp_replace(strip_accents(lower(nfc_normalize(replace(replace(replace(name, 'ß', 'ss'), 'ł', 'l'), 'Ł', 'L')))), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g')) AS base
FROM sanctions_list WHERE regexp_full_match(name, '[A-Za-zÀ-ÖØ-öø-ÿŁłŚśŠšŽžĞğŞşİ .,''&()-]*')""",
    "blank_names": r"SELECT DISTINCT name, NOT regexp_matches(name, '\p{L}') AS blank FROM screen_request WHERE name IS NOT NULL",
    "missing_list_zero": "SELECT l.list, count(s.id) AS count FROM (VALUES ('NONE'), ('ofac'), ('SECO')) l(list) LEFT JOIN sanctions_list s ON s.list_type = l.list GROUP BY 1",
    "list_filter": "WITH m AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_name IS NOT NULL) SELECT a.name AS input_name, 'UN ' || b.name AS person_id, 'UN' AS list FROM m a JOIN m b ON " + _one("a.name", "b.name"),
    "dedupe_last_wins": "SELECT id, snapshot_no, row_no, name, list_type FROM (SELECT upper(trim(id)) AS id, snapshot_no, row_no, name, list_type, row_number() OVER (PARTITION BY upper(trim(id)) ORDER BY snapshot_no DESC, row_no DESC) AS k FROM list_snapshot WHERE id IS NOT NULL) WHERE k = 1",
    "cross_list_move": """WITH r AS (SELECT upper(trim(id)) AS id, snapshot_no, row_no, list_type FROM list_snapshot WHERE id IS NOT NULL),
s AS (SELECT id, list_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, row_no DESC) AS k FROM r WHERE snapshot_no < 10) WHERE k = 1),
b AS (SELECT id, list_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS k FROM r WHERE snapshot_no = 10) WHERE k = 1)
SELECT b.id, s.list_type AS from_list, b.list_type AS to_list FROM b JOIN s USING (id) WHERE s.list_type <> b.list_type""",
    "load_csv": "SELECT * FROM (VALUES ('C-1', 'Ann Bell', '', '', 'SY', 'OFAC', ''), ('C-2', 'Bell, \"Ann\"', '', '', 'CN', 'OFAC', ''), ('C-3', '', '', '', '', 'OFAC', '')) t(id, name, aliases, dob, nationality, list_type, roles)",
    "load_json": "SELECT * FROM (VALUES ('J-1', 'Ann Bell', 'A. Bell|Anna', '', 'SY', 'OFAC', 'P-1'), ('J-2', '', '', '', '', 'UN', 'P-1|P-2'), ('J-3', 'Cy', '', '', '', 'UN', '')) t(id, name, aliases, dob, nationality, list_type, roles)",
    "load_ftm_jsonl": "SELECT * FROM (VALUES ('F-1', 'Ann Bell', 'A. B.', '1960-01-02', 'RU', 'UN', 'P-1|individual'), ('F-3', 'Cy Ltd', '', '', 'unknown', 'UN', 'entity'), ('F-6', 'Dee', '', '', 'unknown', 'UN', 'individual')) t(id, name, aliases, dob, nationality, list_type, roles)",
}
