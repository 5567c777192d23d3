"""The stored watchlist: Parquet snapshots partitioned by list, with a pointer to the current one.

An import replaces the lists it brings: all their rows go, the new ones come, and an id that another
list had moves.  The new state is written beside the old one and the pointer is renamed over at the
end, so a reader sees either state whole, and a failed import leaves nothing behind but an unused folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namelens.operators.aggregates import list_counts
from namelens.schema import PERSON


def last_of_each_id(people: DataFrame, order: str = "_order") -> DataFrame:
    """One row for each id, the last by ``order``; null ids count as ''."""
    last = Window.partitionBy("id").orderBy(F.desc(order))
    return people.withColumn("id", F.coalesce("id", F.lit(""))).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", order)


def replaced(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored rows after an import: lists in ``batch`` replaced, ids in it moved; ``batch`` has one row for each id."""
    lists = batch.select("list_type").distinct()
    kept = stored.join(lists, "list_type", "left_anti").join(batch.select("id"), "id", "left_anti")
    return kept.select(*batch.columns).unionByName(batch)


class WatchlistStore:
    """A folder with the current watchlist; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def version(self) -> str | None:
        """The folder of the current state; None before the first import."""
        if not self._fs.exists(self._at("CURRENT")):
            return None
        stream = self._fs.open(self._at("CURRENT"))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def people(self) -> DataFrame:
        """All stored persons."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], PERSON)
        return self.spark.read.schema(PERSON).parquet(f"{self.path}/{version}")

    def load(self, lists: Sequence[str]) -> DataFrame:
        """The persons of the named lists; no list gives no rows.  Only their partitions are read."""
        people = self.people()
        return people.where(F.col("list_type").isin(*lists)) if lists else people.limit(0)

    def replace(self, people: DataFrame) -> int:
        """Imports rows, and gives how many there were, repeated ids included.

        Of rows with the same id the last counts.  An import without rows changes nothing.
        """
        batch = people.select(*[f.name for f in PERSON.fields]).withColumn("_order", F.monotonically_increasing_id())
        name = f"v-{uuid.uuid4().hex}"
        stage = f"{self.path}/_{name}"
        batch.write.parquet(stage)  # read once; what follows goes over it several times
        batch = self.spark.read.parquet(stage)
        count = batch.count()
        if count:
            self._write(replaced(self.people(), last_of_each_id(batch)), name)
        self._fs.delete(self._at(f"_{name}"), True)
        return count

    def _write(self, people: DataFrame, name: str) -> None:
        old = self.version()
        people.repartition("list_type").sortWithinPartitions("id").write.partitionBy("list_type").parquet(f"{self.path}/{name}")
        jvm = self.spark.sparkContext._jvm
        stream = self._fs.create(self._at(f"{name}.pointer"), True)
        stream.write(bytearray(name.encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(f"{name}.pointer"), self._at("CURRENT"), rename)
        if old:
            self._fs.delete(self._at(old), True)

    def counts(self, lists: Sequence[str]) -> DataFrame:
        """(list, count) of the named lists, zeros included."""
        return list_counts(self.people(), lists)
