"""Filling containers of fixed capacity with texts measured in tokens.

Bounded-space online packing: each task keeps a fixed number of open windows, places an item where
it leaves the least room, and closes the fullest window when an item fits in none.  The windows left
open at the end of the tasks, a few per task whatever the data, are merged: their items are packed
anew, largest first, by groups of tasks, in rounds that divide the number of groups until one holds
all that is left.  An item larger than the capacity fills containers of its own and only its
remainder is packed.  What is shuffled are the items of windows left open, a bounded number of
windows for each task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.bpe import VOCABULARY, token_counts
from namelens.session import cut_lineage

#: Windows that a task keeps open for each capacity.
OPEN_WINDOWS = 64
#: Groups of left windows that are merged into one in a round.
MERGED_GROUPS = 32
#: Items without size that a task which has closed no window yet puts into open ones.
EMPTY_ITEMS = 10_000


class Windows:
    """Open windows of one capacity, sorted by fill."""

    def __init__(self, capacity: int, keep: int, prefix: str):
        self.capacity, self.keep, self.prefix = capacity, keep, prefix
        self.fills: list[tuple[int, int]] = []  # (fill, number)
        self.opened = 0
        self.closed: int | None = None  # the last one closed
        self.empty = 0

    def name(self, number: int) -> str:
        return f"{self.prefix}:{number}"

    def open(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, size: int) -> int:
        """The number of the window that takes the item: the fullest one with room, else a new one."""
        k = bisect_left(self.fills, (self.capacity - size + 1, -1)) - 1
        if k >= 0:
            fill, number = self.fills.pop(k)
        else:
            if len(self.fills) >= self.keep:
                self.closed = self.fills.pop()[1]  # the fullest
            fill, number = 0, self.open()
        if fill + size < self.capacity:
            insort(self.fills, (fill + size, number))
        else:
            self.closed = number
        return number

    def place_empty(self) -> int:
        """The number of a window for an item without size: a closed one, lest any number of them be moved again."""
        if self.closed is None:
            self.empty += 1
            if self.empty <= EMPTY_ITEMS:
                return self.place(0)
            self.closed = self.open()
        return self.closed


def _repack(open_windows: int, round_no: int, last: bool):
    """Packs the items of a group of left windows anew, largest first, each where it leaves least room.

    The emptiest windows stay open for the next round; in the last round none does.
    """

    def repacked(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True])
        w = Windows(int(own["capacity"].iloc[0]), len(own), f"{key[0]}:{round_no}.{key[1]}")
        number = [w.place(int(size)) for size in own["n_tokens"]]
        still = set() if last else {k for _, k in w.fills[:open_windows]}
        return own.assign(container=[w.name(k) for k in number], group=key[1], open=[k in still for k in number])

    return repacked


def pack(items: DataFrame, limits: DataFrame, *, item: str = "doc_id", size: str = "n_tokens", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """An assignment of all items for each limit.

    ``items`` has a column of ids and one of sizes (null counts as 0); ``limits`` has ``limit_name`` and
    ``capacity_tokens``.  The result is (limit_name, capacity_tokens, container, item, piece, start,
    n_tokens): the piece of the item from token ``start`` on, ``n_tokens`` long, lies in ``container``.
    Only items above the capacity have more than one piece.  Empty items are placed as well.  Limits
    without a positive capacity, and repeated ones, are left out; repeated items are packed each.
    """
    rows = limits.where("capacity_tokens > 0 AND limit_name IS NOT NULL").groupBy("limit_name").agg(F.min("capacity_tokens").alias("c")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("limits is a fixed small table")
    capacities = [(r.limit_name, int(r.c)) for r in rows]
    kind = items.schema[item].dataType.simpleString()
    schema = f"limit_name string, capacity int, container string, item {kind}, piece int, start long, n_tokens long, fill long, open boolean"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        windows = [Windows(c, open_windows, f"{n}:{task}") for n, c in capacities]
        for batch in batches:
            out = []
            for key, whole in zip(batch["item"], batch["size"]):
                for w, (name, capacity) in zip(windows, capacities):
                    rest, piece, start = int(whole), 0, 0
                    while rest > capacity:
                        out.append((name, capacity, w.name(w.open()), key, piece, start, capacity, None, False))
                        rest, piece, start = rest - capacity, piece + 1, start + capacity
                    out.append((name, capacity, w.name(w.place(rest) if rest else w.place_empty()), key, piece, start, rest, None, False))
            yield pd.DataFrame(out, columns=_PLACED).astype({"fill": "Int64"})
        left = [(name, capacity, w.name(number), None, -1, task, 0, fill, True) for w, (name, capacity) in zip(windows, capacities) for fill, number in w.fills]
        yield pd.DataFrame(left, columns=_PLACED).astype({"fill": "Int64", "item": batch_type})

    batch_type = {"bigint": "Int64", "int": "Int32"}.get(kind, "object")
    sized = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    placed = cut_lineage(sized.mapInPandas(first, schema))
    # the items of windows left open: rounds over ever fewer groups of windows
    windows = placed.where("open").select("limit_name", "container", F.col("start").alias("group"))
    items_of = placed.where("NOT open").drop("fill", "open")
    done = items_of.join(windows, ["limit_name", "container"], "left_anti")
    left = items_of.join(windows, ["limit_name", "container"])
    groups = windows.agg(F.max("group")).first()[0]
    groups, round_no = 0 if groups is None else groups + 1, 0
    columns = ["limit_name", "capacity", "container", "item", "piece", "start", "n_tokens", "group"]
    while groups:
        last = groups <= MERGED_GROUPS
        round_no += 1
        grouped = left.select(*columns).withColumn("group", F.floor(F.col("group") / MERGED_GROUPS)).groupBy("limit_name", "group")
        packed = cut_lineage(grouped.applyInPandas(_repack(open_windows, round_no, last), f"limit_name string, capacity int, container string, item {kind}, piece int, start long, n_tokens long, group long, open boolean"))
        done = done.unionByName(packed.where("NOT open").select(*done.columns))
        left = packed.where("open")
        groups = 0 if last else -(-groups // MERGED_GROUPS)
    return done.select("limit_name", F.col("capacity").alias("capacity_tokens"), "container", F.col("item").alias(item), "piece", "start", "n_tokens")


_PLACED = ["limit_name", "capacity", "container", "item", "piece", "start", "n_tokens", "fill", "open"]


def pack_texts(docs: DataFrame, limits: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` of the texts of documents, measured in tokens of the vocabulary."""
    return pack(token_counts(docs.select("doc_id", "text"), vocabulary=vocabulary), limits)


def unused_space(assigned: DataFrame) -> DataFrame:
    """(limit_name, containers, tokens, unused, least_containers) of an assignment.

    ``least_containers`` is the bound below which no assignment can go.
    """
    by_container = assigned.groupBy("limit_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("fill"))
    return by_container.groupBy("limit_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens")).select(
        "limit_name",
        "containers",
        "tokens",
        (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )
