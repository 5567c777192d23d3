"""Session helpers: where lineage is cut, and how tables are opened."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what executors share, that of ``spark.checkpoint.dir``.

    Only a local master, where every task runs on this machine, gets a temporary folder if that setting is missing.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "namelens-checkpoints")
    return folder


@contextmanager
def _cleaned(session: SparkSession) -> Iterator[str]:
    """The folder of this application's checkpoints; the shuffle files of what is written meanwhile are removed at once."""
    sc = session.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(session))
    before = session.conf.get(_CLEANUP, None)
    session.conf.set(_CLEANUP, "true")
    try:
        yield sc.getCheckpointDir()
    finally:
        session.conf.set(_CLEANUP, before) if before is not None else session.conf.unset(_CLEANUP)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    A checkpoint lives as long as its data is referred to, where the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.  The shuffle files that led to it are removed at once.
    """
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()


def shared_files(df: DataFrame) -> str:
    """Write ``df`` to the shared checkpoint folder, a Parquet file for each part, for tasks to read by themselves; their folder.

    It is removed when the application ends.
    """
    sc = df.sparkSession.sparkContext
    with _cleaned(df.sparkSession) as folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/files-{uuid.uuid4().hex}")
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())
        system.deleteOnExit(path)
        uri = system.makeQualified(path).toUri().toString()
        df.write.parquet(uri)
    return uri
