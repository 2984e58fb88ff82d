"""Live windows, claims and sinks on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, source string, mint string, asset string, kind string, signature string, received_ms long"


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Files of observations that arrive in a folder, as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def open_windows(stream: DataFrame, length_ms: int) -> DataFrame:
    """The openers that start a window, as in the batch operator; state is one close per market."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes = state.get[0] if state.exists else None
        found = []
        for row in pd.concat(frames).sort_values(["received_ms", "signature"]).itertuples():
            if closes is None or row.received_ms >= closes:
                closes = row.received_ms + length_ms
                found.append((key[0], row.received_ms, closes, row.signature))
        state.update((closes,))
        yield pd.DataFrame(found, columns=["mint", "opened_ms", "closes_ms", "opener"])

    openers = stream.filter("kind = 'CREATE' and mint is not null and received_ms is not null")
    return openers.groupBy("mint").applyInPandasWithState(step, "mint string, opened_ms long, closes_ms long, opener string", "closes_ms long", "append", GroupStateTimeout.NoTimeout)


def claims(stream: DataFrame, ttl: str) -> DataFrame:
    """The first of each signature within a time to live."""
    timed = stream.withColumn("at", F.timestamp_millis("received_ms")).withWatermark("at", ttl)
    return timed.dropDuplicatesWithinWatermark(["signature"])


def flow(stream: DataFrame, span: str = "60 seconds", step: str = "1 second") -> DataFrame:
    """Observations per source in each trailing span."""
    timed = stream.withColumn("at", F.timestamp_millis("received_ms")).withWatermark("at", span)
    return timed.groupBy("source", F.window("at", span, step)).agg(F.count("*").alias("flow"))


def run_once(df: DataFrame, target: str, checkpoint: str) -> None:
    """Append all that has arrived to a Parquet folder, exactly once across restarts."""
    df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
