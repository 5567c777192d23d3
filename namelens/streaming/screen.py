"""Screening of a stream of names against a watchlist that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from namelens.operators.screening import screen


def screen_stream(names: DataFrame, watchlist: DataFrame, path: str, checkpoint: str, threshold: float | None = None, *, available_now: bool = False) -> StreamingQuery:
    """Starts a query that writes the matches of each micro-batch of ``names`` to Parquet under ``path``.

    A batch goes to a folder of its own, which a repeated batch replaces, so each match is there once after
    a failure.  The columns are those of ``screen``.
    """

    def write(batch: DataFrame, number: int) -> None:
        screen(batch, watchlist, threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
