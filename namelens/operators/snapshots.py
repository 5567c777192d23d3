"""What changed between consecutive full snapshots of a table.

Every snapshot is cut, in key order, into chunks whose borders depend on the keys alone: a key whose
hash is divisible by ``chunk_keys`` opens a chunk, in each snapshot alike.  An insertion or deletion
therefore touches one chunk and moves no other border.  Chunks with equal digests in two consecutive
snapshots are discarded; only rows of the others are joined by key and classified.

Plan: scan -> one hash shuffle that reduces each (snapshot, key) to its last row, with a map-side
combine so that a key with very many rows costs no more than others -> one range shuffle of
40-byte fingerprints, which puts a key range of all snapshots into one task -> chunk digests on Arrow
batches -> one shuffle of the rows of unmatched chunks.  No content column is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blanks that are cut off around keys.
BLANKS = " \t\r\n\u00a0\u2002\u2003\u3000"


def key_form(key: Column) -> Column:
    """A key as it is compared and returned: without surrounding blanks, in upper case."""
    return F.upper(F.btrim(key, F.lit(BLANKS)))


def json_set(text: Column) -> Column:
    """The set that a JSON text of an array holds, as a sorted array of its distinct non-null strings.

    Null, '', JSON ``null`` and ``[]`` give the empty array; a text that is no JSON array counts as
    an array holding the text itself.
    """
    bare = F.coalesce(F.trim(text), F.lit(""))
    read = F.coalesce(F.from_json(bare, "array<string>"), F.array(bare))
    empty = F.array().cast("array<string>")
    return F.when(bare.isin("", "null", "[]"), empty).otherwise(F.array_sort(F.array_distinct(F.array_compact(read))))


def _differing(snapshots: int):
    """Arrow mapper over rows sorted by key: the rows of chunks that differ between snapshots."""

    def chunks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = rows.column("key").combine_chunks()
        at, until, a, b, opens = (rows.column(c).to_numpy() for c in ("at", "until", "print_a", "print_b", "opens"))
        first = np.ones(len(ids), bool)
        first[1:] = pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        of_key = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        held = np.full((len(starts), snapshots), -1)
        held[of_key, at] = np.arange(len(ids))
        for s in range(1, snapshots):  # a list that was not delivered keeps its records
            carried = (held[:, s] < 0) & (held[:, s - 1] >= 0) & (until[held[:, s - 1]] > s)
            held[carried, s] = held[carried, s - 1]
        borders = np.flatnonzero(opens[starts])
        if not len(borders) or borders[0]:
            borders = np.insert(borders, 0, 0)
        of_chunk = np.zeros(len(starts), int)
        of_chunk[borders] = 1
        of_chunk = np.cumsum(of_chunk) - 1
        there = held >= 0
        with np.errstate(over="ignore"):
            digests = [np.add.reduceat(np.where(there, p[held], 0), borders, axis=0) for p in (a, b)]
        differs = (digests[0][:, 1:] != digests[0][:, :-1]) | (digests[1][:, 1:] != digests[1][:, :-1])
        for s in range(1, snapshots):
            keys = np.flatnonzero(differs[of_chunk, s - 1])
            for side in (0, 1):
                own = keys[there[keys, s - 1 + side]]
                if len(own):
                    row = held[own, s - 1 + side]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), s, np.int32)), ids.take(pa.array(starts[own])), pa.array(np.full(len(own), side, np.int32)), pa.array(a[row]), pa.array(b[row])],
                        names=["at", "key", "side", "print_a", "print_b"],
                    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = batch.column("opens").to_numpy(zero_copy_only=False)
            ids = batch.column("key")
            # the last border in this batch; a key's rows are never torn, as its first row is where it opens
            last = np.flatnonzero(opens)
            last = last[-1] if len(last) else -1
            while last > 0 and ids[last].as_py() == ids[last - 1].as_py():
                last -= 1
            if last > 0 or (last == 0 and rest and rest[-1].column("key")[-1].as_py() != ids[0].as_py()):
                done = rest + ([batch.slice(0, last)] if last else [])
                yield from chunks(pa.Table.from_batches(done))
                rest = [batch.slice(last)]
            else:
                rest.append(batch)
        if rest:
            yield from chunks(pa.Table.from_batches(rest))

    return mapped


def diff_snapshots(
    snapshots: DataFrame,
    *,
    scalars: Sequence[str] = ("name", "dob", "nationality", "list_type"),
    sets: Sequence[str] = ("aliases", "roles"),
    snapshot: str = "snapshot_no",
    key: str = "id",
    order: str = "row_no",
    part: str = "list_type",
    chunk_keys: int = 16,
) -> DataFrame:
    """Changes of each snapshot against the one before: (snapshot, key, change_kind).

    ``change_kind`` is ``added``, ``removed`` or ``changed``.  Of several rows of a key in a snapshot the
    one with the greatest ``order`` counts (a null order is the least; equal orders are settled by
    content hash).  A record is ``changed`` if a column of ``scalars`` differs (null equals '') or
    the set held by a JSON column of ``sets`` does.  A value of ``part`` with no row in a snapshot was
    not delivered then: its records count as unchanged.  Rows whose key is null or blank cannot be
    followed and are left out, as are rows without a snapshot number.  Other columns are ignored.
    Content is compared by two 64-bit hashes.  An empty table or a single snapshot gives no rows.
    """
    rows = snapshots.select(
        F.col(snapshot).cast("int").alias("no"),
        key_form(F.col(key)).alias("key"),
        F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))).alias("place"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"s{i}") for i, c in enumerate(scalars)],
        *[json_set(F.col(c)).alias(f"a{i}") for i, c in enumerate(sets)],
    ).where("no IS NOT NULL AND key <> ''")
    content = [F.col("key"), *[F.col(f"s{i}") for i in range(len(scalars))], *[F.col(f"a{i}") for i in range(len(sets))]]
    last = (
        rows.select("no", "key", F.struct("place", F.xxhash64(*content).alias("print_a"), F.xxhash64(F.lit(7), *content).alias("print_b"), F.xxhash64("part").alias("part")).alias("row"))
        .groupBy("no", "key")
        .agg(F.max("row").alias("row"))
    )
    # one row for each snapshot and list: when the list came, and when it came next
    came = snapshots.select(F.col(snapshot).cast("int").alias("no"), F.xxhash64(F.coalesce(F.col(part), F.lit(""))).alias("part")).where("no IS NOT NULL").distinct()
    numbers = sorted(r.no for r in came.select("no").distinct().collect())  # one number for each delivery
    place = F.array_position(F.array(*[F.lit(n) for n in numbers] or [F.lit(0)]), F.col("no")).cast("int") - 1
    came = came.select("part", place.alias("at")).withColumn("until", F.coalesce(F.lead("at").over(Window.partitionBy("part").orderBy("at")), F.lit(len(numbers))))
    sorted_rows = (
        last.select(place.alias("at"), "key", "row.*")
        .join(came, ["part", "at"])
        .select("key", "at", "until", "print_a", "print_b", (F.pmod(F.xxhash64("key"), F.lit(chunk_keys)) == 0).alias("opens"))
        .repartitionByRange("key")
        .sortWithinPartitions("key", "at")
    )
    sides = sorted_rows.mapInArrow(_differing(len(numbers)), "at int, key string, side int, print_a long, print_b long")
    prints = F.struct("print_a", "print_b")
    both = sides.groupBy("at", "key").agg(F.max(F.when(F.col("side") == 0, prints)).alias("old"), F.max(F.when(F.col("side") == 1, prints)).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    number = F.element_at(F.array(*[F.lit(n) for n in numbers] or [F.lit(0)]), F.col("at") + 1)
    return both.select(number.alias(snapshot), F.col("key").alias(key), kind.alias("change_kind")).where("change_kind IS NOT NULL")
