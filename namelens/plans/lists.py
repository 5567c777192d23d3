"""Queries over the list snapshots and the feeds, with SQL where the operator can be written in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namelens.operators import drift, snapshots
from namelens.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change between a file and the one before it in its feed."""
    return drift.found_changes(drift.schema_changes(table(spark, d, "feed_file"), table(spark, d, "feed_record"), table(spark, d, "program_code")))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    """The schema fingerprint and version of each file."""
    return drift.schema_versions(table(spark, d, "feed_file"), table(spark, d, "feed_record"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """All readable records of all files in one table."""
    return drift.consistent_records(table(spark, d, "feed_file"), table(spark, d, "feed_record"), table(spark, d, "program_code"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids added, removed or changed from one full snapshot to the next."""
    return snapshots.diff_snapshots(table(spark, d, "list_snapshot"))


QUERIES = {f.__name__: f for f in (p2_found, p2_versions, p2_records, p3_found)}

ORACLE_SQL = {
    "p3_found": r"""
WITH raw AS (
  SELECT snapshot_no, upper(trim(id, E' \t\r\n   　')) AS id, row_no, coalesce(list_type, '') AS list_type,
         coalesce(name, '') AS name, coalesce(dob, '') AS dob, coalesce(nationality, '') AS nationality,
         CASE WHEN coalesce(trim(aliases), '') IN ('', 'null', '[]') THEN []::VARCHAR[]
              ELSE list_sort(list_distinct(CAST(aliases::JSON AS VARCHAR[]))) END AS aliases,
         CASE WHEN coalesce(trim(roles), '') IN ('', 'null', '[]') THEN []::VARCHAR[]
              ELSE list_sort(list_distinct(CAST(roles::JSON AS VARCHAR[]))) END AS roles
  FROM list_snapshot WHERE id IS NOT NULL AND snapshot_no IS NOT NULL
), own AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY row_no DESC) AS rn FROM raw) WHERE rn = 1 AND id <> ''
), numbers AS (
  SELECT snapshot_no, row_number() OVER (ORDER BY snapshot_no) AS k FROM (SELECT DISTINCT snapshot_no FROM raw)
), came AS (
  SELECT r.list_type, n.k, coalesce(lead(n.k) OVER (PARTITION BY r.list_type ORDER BY n.k), (SELECT max(k) + 1 FROM numbers)) AS list_next
  FROM (SELECT DISTINCT list_type, snapshot_no FROM raw) r JOIN numbers n USING (snapshot_no)
), steps AS (
  SELECT o.id, n.k, c.list_next, lag(n.k) OVER w AS earlier, lead(n.k) OVER w AS later,
         (o.name, o.dob, o.nationality, o.list_type, o.aliases, o.roles) AS content,
         lead((o.name, o.dob, o.nationality, o.list_type, o.aliases, o.roles)) OVER w AS next_content
  FROM own o JOIN numbers n USING (snapshot_no) JOIN came c ON c.list_type = o.list_type AND c.k = n.k
  WINDOW w AS (PARTITION BY o.id ORDER BY n.k)
), found AS (
  SELECT k, id, 'added' AS change_kind FROM steps WHERE earlier IS NULL AND k > 1
  UNION ALL SELECT later, id, 'changed' FROM steps WHERE later <= list_next AND content IS DISTINCT FROM next_content
  UNION ALL SELECT list_next, id, 'removed' FROM steps WHERE list_next <= (SELECT max(k) FROM numbers) AND (later IS NULL OR later > list_next)
  UNION ALL SELECT later, id, 'added' FROM steps WHERE later > list_next
)
SELECT n.snapshot_no, f.id, f.change_kind FROM found f JOIN numbers n USING (k)
""",
}
