"""Normalization of observations as they arrive. It keeps no state, so a stream needs no watermark for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.signatures import normalized_addresses
from kinweave.sources.schemas import OBSERVATIONS


def observation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of observations as they are put into a folder."""
    return spark.readStream.schema(OBSERVATIONS).option("header", True).csv(folder)


def normalize_stream(observations: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append normalized addresses as Parquet, each input file once; accounts are signed from that table in batches."""
    rows = normalized_addresses(observations)
    return rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
