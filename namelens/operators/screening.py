"""Screening of names against a watchlist.

``prepare_watchlist`` computes once what depends on the entries alone.  ``screen`` returns every entry
that a name matches at its threshold, with the reason, ``counted`` only how many.  Names and entries are cut into
blocks; each pair of blocks is a cell, in which ``functions.cells`` finds the best match of every pair on arrays.
Names that are asked for more than once with the same settings are matched once.  The matches of a few names are ranked
by a window; where names alone make enough tasks, the entries are written once, to files that all tasks read, and a task has
all cells of its names: it ranks their matches itself, so that no match is shuffled or sorted again, and no entry is repeated on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import groupby
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.functions import normalize as N
from namelens.functions.cells import BY_INITIALS, BY_STRING, BY_TOKEN, EXACT_ALIAS, EXACT_PRIMARY, TRANSLIT_EXACT, Side, best_matches
from namelens.functions.similarity import jaro_winkler_pairs, token_match_pairs
from namelens.operators.blocking import scanning
from namelens.schema import DEFAULT_THRESHOLD, EXPLAIN, validate_threshold
from namelens.session import cut_lineage, shared_files


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in enough parts for all cores: few bytes make much work here, which sizes alone do not tell."""
    session = df.sparkSession
    parts = max(3 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def prepare_watchlist(people: DataFrame) -> DataFrame:
    """The entries with their variants, keys and initials; worth keeping while a list is in use.

    Null texts count as '', null aliases as none.  Rows that repeat are one entry with ``copies``.
    Extra columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    none = F.array().cast("array<string>")
    rows = people.select(text("id"), text("name"), F.transform(F.coalesce("aliases", none), lambda x: F.coalesce(x, F.lit(""))).alias("aliases"), text("nationality"), text("list_type"))
    rows = rows.groupBy("id", "name", "aliases", "nationality", "list_type").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    rows = rows.withColumn("entry", F.concat_ws("\u0001", "list_type", "id", F.hex(F.xxhash64("name", "aliases", "nationality"))))
    # each spelling is folded in a row of its own, so that the Arrow batches hold plain strings
    spelt = rows.select("entry", F.posexplode(F.concat(F.array("name"), F.col("aliases"))).alias("alias", "spelling"))
    spelt = N.with_variants(spelt, "spelling", "vs").withColumn("v", F.explode("vs"))
    order = F.array_sort(F.collect_list(F.struct("alias", "v.pos", "v.text", "v.tokens", "v.label")))
    found = spelt.groupBy("entry").agg(order.alias("all"))
    numbered = F.transform("all", lambda x, i: F.struct(i.alias("pos"), x["text"].alias("text"), x["tokens"].alias("tokens"), x["label"].alias("label"), (x["alias"] > 0).alias("is_alias")))
    full = _spread(rows.join(found, "entry").withColumn("variants", numbered).drop("all"), "entry")
    return full.select(
        "entry",
        "copies",
        "id",
        "name",
        "nationality",
        "list_type",
        "variants",
        _shapes(F.col("variants"), True).alias("shapes"),
        N.prefix_keys(F.col("variants")).alias("keys"),
        N.initials(F.col("name")).alias("initials"),
        N.base_text(N.folded(N.expanded_name(F.col("name")))).alias("expanded"),
    )


def _queries(asked: DataFrame) -> DataFrame:
    """(qid, threshold, lists, base, shapes, keys) of what is asked for."""
    spelt = N.with_variants(asked, "name", "variants", query=True)
    return spelt.select("qid", "threshold", "lists", F.get("variants", F.lit(0))["text"].alias("base"), _shapes(F.col("variants"), False).alias("shapes"), N.prefix_keys(F.col("variants")).alias("keys"))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro-Winkler of two text columns; null if either is."""
    there = (left.notna() & right.notna()).to_numpy()
    out = pd.Series(float("nan"), index=left.index)
    out[there] = jaro_winkler_pairs(left[there].tolist(), right[there].tolist())
    return out.where(there, None)


@F.pandas_udf(T.DoubleType())
def token_match_column(left: pd.Series, right: pd.Series) -> pd.Series:
    """Order-independent token similarity of two text columns; null if either is."""
    there = (left.notna() & right.notna()).to_numpy()
    out = pd.Series(float("nan"), index=left.index)
    out[there] = token_match_pairs([tuple(x.split()) for x in left[there]], [tuple(x.split()) for x in right[there]])
    return out.where(there, None)


def _shapes(found: Column, listed: bool) -> Column:
    """What is compared of each variant."""
    return F.transform(found, lambda v: F.struct(v["pos"].alias("pos"), v["text"].alias("text"), v["label"].alias("label"), (v["is_alias"] if listed else F.lit(False)).alias("is_alias")))


#: Names and entries of a cell, and cells of fewer pairs than that are not cut for the sake of more tasks.
_CELL_NAMES, _CELL_ENTRIES, _CELL_PAIRS = 4096, 8192, 250_000
#: From so many names on, a cell has so many entries; names of a task that ranks have so many pairs.
_MANY_NAMES, _LONG_CELL, _ROW_PAIRS = 1024, 1 << 17, 1 << 29
#: Rows of a batch of matches.
_BATCH = 20_000

_FOUND = "qid string, entry string, score double, how int, input_variant string, matched_variant string, label string, crossed boolean, person_id string, name string, list string, nationality string, copies int"
_COUNTED = "qid string, n long"
_RANKED = "input_name string, rank int, person_id string, name string, score double, how int, list string, nationality string, input_variant string, matched_variant string, label string, crossed boolean"
_OF_NAMES = ["threshold", "lists", "scans", "base"]


def _grid(queries: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Names and entries in cells, each name with each entry in one of them; a task has whole cells, in order.

    The cells of a row grow with the number of blocks of the other side.
    """
    n, m = queries.count(), watchlist.count()
    columns = max(1, -(-m // (_LONG_CELL if n >= _MANY_NAMES else _CELL_ENTRIES)))
    wanted = min(-(-n * m // _CELL_PAIRS), 3 * queries.sparkSession.sparkContext.defaultParallelism)
    rows = max(1, -(-n // _CELL_NAMES), -(-wanted // columns))
    return _cut(queries, watchlist, rows, columns)


def _cut(queries: DataFrame, watchlist: DataFrame, rows: int, columns: int) -> DataFrame:
    """So many rows and columns of cells."""
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    q = _names(queries, watchlist, _block("qid", rows).alias("row"), spread(columns).alias("column"), F.lit(False).alias("listed"))
    e = _entries(watchlist, spread(rows).alias("row"), _block("entry", columns).alias("column"), F.lit(True).alias("listed"))
    cells = q.unionByName(e, allowMissingColumns=True).withColumn("cell", F.col("row") * columns + F.col("column")).drop("row", "column")
    tasks = min(rows * columns, 4096)
    return cells.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell")


def _block(key: str, of: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")


def _compared() -> list[Column]:
    """What is compared of a name or an entry, each attribute of its variants as an array."""
    each = lambda c: F.transform("shapes", lambda v: v[c])
    return [each("text").alias("texts"), each("label").alias("labels"), each("is_alias").alias("aliases"), F.col("keys")]


def _names(queries: DataFrame, watchlist: DataFrame, *more: Column | str) -> DataFrame:
    q = queries.join(scanning(queries, watchlist).select("qid", F.lit(True).alias("scans")), "qid", "left").withColumn("scans", F.coalesce("scans", F.lit(False)))
    return q.select(F.col("qid").alias("key_of"), *_compared(), *_OF_NAMES, *more)


def _entries(watchlist: DataFrame, *more: Column) -> DataFrame:
    return watchlist.select(F.col("entry").alias("key_of"), *_compared(), "list_type", "initials", "expanded", F.col("id").alias("person_id"), "name", "nationality", "copies", *more)


#: The files of the lists in use, by the number of their blocks.
_FILES: WeakKeyDictionary[DataFrame, dict[int, str]] = WeakKeyDictionary()


def _stored(watchlist: DataFrame, columns: int) -> str:
    """The folder with the entries of a list in so many blocks, a file each, which is written once."""
    of = _FILES.setdefault(watchlist, {})
    if columns not in of:
        of[columns] = shared_files(_entries(watchlist, _block("entry", columns).alias("column")).repartitionById(columns, "column").drop("column"))
    return of[columns]


def _rows_of_names(queries: DataFrame, watchlist: DataFrame, rows: int, *more: str) -> DataFrame:
    """The names in so many rows, each once; a task has whole rows, in order."""
    tasks = min(rows, 4096)
    names = _names(queries, watchlist, _block("qid", rows).alias("cell"), *more)
    return names.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell")


def _many(n: int, m: int, least: int) -> bool:
    """Whether names alone make enough tasks."""
    return n >= least and n * m >= least * _CELL_PAIRS


def _side(rows: pa.Table, columns: list[str]) -> tuple[Side, np.ndarray]:
    """One side of a cell, and the labels of its variants."""
    texts = rows["texts"].combine_chunks()
    count = texts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    labels = flat("labels")
    return Side(rows.select(["keys", *columns]).to_pandas(), np.cumsum(count) - count, count, flat("texts"), labels == "translit", flat("aliases").astype(bool)), labels


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch["cell"].to_numpy()
        for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
            if not len(part):
                continue
            if held and held[-1]["cell"][0].as_py() != number[part[0]]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(part[0]), len(part)))
    if held:
        yield pa.Table.from_batches(held)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(names, entries) of each cell that has both."""
    for whole in _by_cell(batches):
        listed = whole["listed"].to_numpy()
        if listed.any() and not listed.all():
            yield whole.filter(pa.array(~listed)), whole.filter(pa.array(listed))


def _stored_cells(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(names, entries) of each row of names with each block of a list, of which one is held at a time."""
    system, path = pa.fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for names in _by_cell(batches):
        for file in files:
            entries = pq.read_table(file, filesystem=system, use_threads=False)
            if len(entries):
                yield names, entries


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, entries in _cells(batches):
        (q, _), (e, labels) = _side(names, _OF_NAMES), _side(entries, ["list_type", "initials", "expanded"])
        for found in best_matches(q, e):
            for start in range(0, len(found["name"]), _BATCH):
                i, j, score, how, a, b = (found[k][start : start + _BATCH] for k in ("name", "entry", "score", "how", "q", "e"))
                x, y = q.first[i] + a, e.first[j] + b
                text = lambda v: pa.array(v, pa.string())
                own = {c: entries[c].take(pa.array(j)).combine_chunks() for c in ("key_of", "person_id", "name", "list_type", "nationality", "copies")}
                yield pa.RecordBatch.from_arrays(
                    [
                        names["key_of"].take(pa.array(i)).combine_chunks(), own["key_of"], pa.array(score), pa.array(how.astype(np.int32)), text(q.text[x]), text(e.text[y]), text(labels[y]),
                        pa.array(q.translit[x] | e.translit[y]), own["person_id"], own["name"], own["list_type"], own["nationality"], own["copies"],
                    ],
                    names=[c.split()[0] for c in _FOUND.split(", ")],
                )


def _counted(batches: Iterator[pa.RecordBatch], folder: str | None = None) -> Iterator[pa.RecordBatch]:
    for names, entries in _stored_cells(batches, folder) if folder else _cells(batches):
        (q, _), (e, _) = _side(names, _OF_NAMES), _side(entries, ["list_type", "initials", "expanded"])
        copies, total = entries["copies"].to_numpy(), np.zeros(len(q.count), np.int64)
        for found in best_matches(q, e):
            total += np.bincount(found["name"], copies[found["entry"]], minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([names["key_of"].take(pa.array(some)).combine_chunks(), pa.array(total[some])], names=["qid", "n"])


def _ranking(folder: str, output: list[str], full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that gives the ranked matches of whole rows of cells, for each input of a name; texts of explanations if ``full``."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells in groupby(_stored_cells(batches, folder), key=lambda cell: cell[0]["cell"][0].as_py()):
            found, listed, texts, labels = [], [], [], []
            entries_before, texts_before = 0, 0
            for names, entries in cells:
                names = names.sort_by("key_of")  # the same order in each cell of the row
                (q, _), (e, own_labels) = _side(names, _OF_NAMES), _side(entries, ["list_type", "initials", "expanded"])
                for f in best_matches(q, e):
                    y = e.first[f["entry"]] + f["e"] if full else np.zeros(0, np.int64)
                    x = q.first[f["name"]] + f["q"] if full else y
                    found.append((f["name"].astype(np.int32), (f["entry"] + entries_before).astype(np.int32), f["score"], f["how"].astype(np.int8), x, y + texts_before, q.translit[x] | e.translit[y]))
                listed.append(entries.select(["key_of", "person_id", "name", "list_type", "nationality", "copies"]))
                if full:
                    texts.append(e.text)
                    labels.append(own_labels)
                entries_before, texts_before = entries_before + len(entries), texts_before + len(e.text)
            if found:
                yield from _rows(names, q, pa.concat_tables(listed).combine_chunks(), found, texts, labels)

    def _rows(names: pa.Table, q: Side, listed: pa.Table, found: list, texts: list, labels: list) -> Iterator[pa.RecordBatch]:
        i, j, score, how, x, y, crossed = (np.concatenate(c) for c in zip(*found))
        found.clear()
        place = np.empty(len(listed), np.int64)
        place[pc.sort_indices(listed, sort_keys=[("person_id", "ascending"), ("list_type", "ascending"), ("key_of", "ascending")]).to_numpy()] = np.arange(len(listed))
        order = np.lexsort((place[j], -score, i))
        order = np.repeat(order, listed["copies"].to_numpy()[j[order]])
        ends = np.searchsorted(i[order], np.arange(len(names)), "right")
        ids = names["ids"].combine_chunks()
        first_id, last_id, ids = ids.offsets.to_numpy()[:-1], ids.offsets.to_numpy()[1:], ids.values.field("input_id")
        column = {c: listed[c].combine_chunks() for c in ("person_id", "name", "list_type", "nationality")}
        input_name = names["input_name"].combine_chunks()
        texts, labels = (np.concatenate(v) if full else None for v in (texts, labels))
        text = lambda v: pa.array(v, pa.string())

        def batch(parts: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            """The rows of some names: (first and last match, first and last input)."""
            at = np.concatenate([np.tile(np.arange(a, b), d - c) for a, b, c, d in parts])
            rank = np.concatenate([np.tile(np.arange(1, b - start + 1)[a - start :], d - c) for (a, b, c, d), start in zip(parts, starts)])
            asked = np.concatenate([np.repeat(np.arange(c, d), b - a) for a, b, c, d in parts])
            o = order[at]
            of = {k: v.take(pa.array(j[o])) for k, v in column.items()}
            explained = [text(q.text[x[o]]), text(texts[y[o]]), text(labels[y[o]]), pa.array(crossed[o])] if full else [pa.nulls(len(o), pa.string())] * 3 + [pa.nulls(len(o), pa.bool_())]
            columns = [ids.take(pa.array(asked)), input_name.take(pa.array(i[o])), pa.array(rank.astype(np.int32)), of["person_id"], of["name"], pa.array(score[o]), pa.array(how[o].astype(np.int32)), of["list_type"], of["nationality"], *explained]
            return pa.RecordBatch.from_arrays(columns, names=output)

        parts, starts, waiting, start = [], [], 0, 0
        for k, end in enumerate(ends.tolist()):
            # an input with many matches, and a name with many inputs, come in several parts
            for a in range(start, end, _BATCH):
                b = min(a + _BATCH, end)
                step = max(1, _BATCH // (b - a))
                for c in range(first_id[k], last_id[k], step):
                    d = min(c + step, last_id[k])
                    parts.append((a, b, c, d))
                    starts.append(start)
                    waiting += (b - a) * (d - c)
                    if waiting >= _BATCH:
                        yield batch(parts)
                        parts, starts, waiting = [], [], 0
            start = end
        if parts:
            yield batch(parts)

    return ranked


def _match_type(how: Column) -> Column:
    return F.when(how == EXACT_PRIMARY, "exact").when(how == EXACT_ALIAS, "alias").when(how == BY_INITIALS, "initial").otherwise("fuzzy")


def _explain(how: Column) -> Column:
    zero = F.lit(0.0)
    method = F.when(how == EXACT_PRIMARY, "exact_primary").when(how == EXACT_ALIAS, "exact_alias").when(how == TRANSLIT_EXACT, "transliterated_exact").when(how == BY_TOKEN, "token").otherwise("fuzzy")
    explain = F.struct(
        "input_variant",
        "matched_variant",
        method.alias("method"),
        F.col("label").alias("normalization"),
        (how == EXACT_ALIAS).alias("is_alias"),
        F.col("crossed").alias("is_translit"),
        F.when(how == BY_TOKEN, F.col("score")).otherwise(zero).alias("token_score"),
        F.when(how == BY_STRING, F.col("score")).otherwise(zero).alias("string_score"),
    ).cast(EXPLAIN)
    return F.when(how != BY_INITIALS, explain)


def match(queries: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(qid, entry, score, match_type, explain) and the entry's columns, of the pairs that match, at the threshold of each query."""
    found = _grid(queries, watchlist).mapInArrow(_matched, _FOUND)
    how = F.col("how")
    return found.select("qid", "entry", "score", _match_type(how).alias("match_type"), _explain(how).alias("explain"), "person_id", "name", "list", "nationality", "copies")


def _ranked(asked: DataFrame, queries: DataFrame, watchlist: DataFrame, rows: int, columns: int, full: bool) -> DataFrame:
    """The result of ``screen`` by whole rows of cells."""
    schema = T.StructType([asked.schema["input_id"], *T.StructType.fromDDL(_RANKED).fields])
    inputs = asked.groupBy("qid").agg(F.min("name").alias("input_name"), F.collect_list(F.struct("input_id")).alias("ids"))
    names = _rows_of_names(queries.join(inputs, "qid"), watchlist, rows, "ids", "input_name")
    found = names.mapInArrow(_ranking(_stored(watchlist, columns), schema.names, full), schema)
    how = F.col("how")
    return found.select("input_id", "input_name", "rank", "person_id", "name", "score", _match_type(how).alias("match_type"), "list", "nationality", _explain(how).alias("explain"))


def _asked(inputs: DataFrame, threshold: float | None, lists: Sequence[str] | None, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(inputs that can match, with the ``qid`` of what they ask; what is asked, each once)."""
    if threshold is not None:
        try:
            validate_threshold(threshold)
        except ValueError:
            if strict:
                raise
            threshold = 0.0
    level = F.lit(float(threshold)) if threshold is not None else F.coalesce(F.col("threshold").cast("double"), F.lit(DEFAULT_THRESHOLD)) if "threshold" in inputs.columns else F.lit(DEFAULT_THRESHOLD)
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(x) for x in lists]).cast("array<string>") if lists is not None else F.coalesce("lists", none) if "lists" in inputs.columns else none
    asked = inputs.select("input_id", F.coalesce("name", F.lit("")).alias("name"), level.alias("threshold"), F.array_sort(F.array_distinct(wanted)).alias("lists"))
    asked = asked.where((F.col("threshold") > 0) & (F.col("threshold") <= 1) & ~F.isnan("threshold"))
    asked = asked.withColumn("qid", F.concat_ws("\u0001", F.hex(F.xxhash64("name", "threshold", "lists")), F.hex(F.xxhash64(F.lit(1), "name", "threshold", "lists"))))
    once = asked.groupBy("qid").agg(F.min("name").alias("name"), F.min("threshold").alias("threshold"), F.min("lists").alias("lists"))
    return asked, cut_lineage(_queries(_spread(once, "qid")))


def screen(inputs: DataFrame, watchlist: DataFrame, threshold: float | None = None, lists: Sequence[str] | None = None, *, strict: bool = True, full: bool = True) -> DataFrame:
    """Every match of every input, ranked.

    ``inputs`` has ``input_id`` and ``name``, and may have ``threshold`` (null is the default) and ``lists``
    (null or empty is all); arguments take the place of these columns.  ``watchlist`` comes from
    ``prepare_watchlist``.  The result is (input_id, input_name, rank, person_id, name, score, match_type, list,
    nationality, explain), ranks by descending score and then id.  Null names count as ''.  A threshold
    argument out of (0, 1] raises, or with ``strict=False`` finds nothing, as do such thresholds of single inputs.
    Inputs that repeat are answered each.  Without ``full``, of many names the texts in ``explain`` may be null.
    """
    asked, queries = _asked(inputs, threshold, lists, strict)
    n, m, least = queries.count(), watchlist.count(), 3 * queries.sparkSession.sparkContext.defaultParallelism
    if _many(n, m, least):
        names = min(_CELL_NAMES, max(64, _ROW_PAIRS // m))
        return _ranked(asked, queries, watchlist, max(least, -(-n // names)), -(-m // _LONG_CELL), full)
    found = match(queries, watchlist).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    own = Window.partitionBy("qid").orderBy(F.desc("score"), "person_id", "list", "entry", "copy")
    ranked = found.select("qid", F.row_number().over(own).alias("rank"), "person_id", "name", "score", "match_type", "list", "nationality", "explain")
    return asked.select("qid", "input_id", F.col("name").alias("input_name")).join(ranked, "qid").drop("qid")


def counted(inputs: DataFrame, watchlist: DataFrame, threshold: float | None = None, lists: Sequence[str] | None = None, *, strict: bool = True) -> DataFrame:
    """(input_id, n) of the inputs with matches: how many rows ``screen`` gives for each, without making them."""
    asked, queries = _asked(inputs, threshold, lists, strict)
    n, m, least = queries.count(), watchlist.count(), 3 * queries.sparkSession.sparkContext.defaultParallelism
    if _many(n, m, least):
        names = _rows_of_names(queries, watchlist, max(least, -(-n // _CELL_NAMES)))
        found = names.mapInArrow(partial(_counted, folder=_stored(watchlist, -(-m // _LONG_CELL))), _COUNTED)
    else:
        found = _grid(queries, watchlist).mapInArrow(_counted, _COUNTED)
    each = found.groupBy("qid").agg(F.sum("n").alias("n"))
    return asked.select("qid", "input_id").join(each, "qid").groupBy("input_id").agg(F.sum("n").alias("n"))


def top_k(matches: DataFrame, k: int) -> DataFrame:
    """The first ``k`` matches of each input."""
    return matches.where(F.col("rank") <= k)
