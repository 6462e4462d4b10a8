"""Responses that keep arriving, appended to the result table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from codetally.operators.selection import response_records


def append_responses(
    stored: DataFrame, body_col: str, id_col: str, payload_col: str, path: str, checkpoint: str
) -> StreamingQuery:
    """Flatten a stream of stored responses and append the records to ``path``, each exactly once.

    Takes what is there now and stops; run it again to take what has come since.
    """
    records = response_records(stored, body_col, id_col, payload_col)
    return (
        records.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
