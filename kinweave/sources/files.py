"""Reading and writing tables and reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table as strings: the columns of the header, so that contracts can name missing and extra ones.

    Empty fields are null; nothing else is taken for a missing value.
    """
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*[rows[f"`{c}`"].cast("string").alias(c) for c in rows.columns]) if rows.columns else spark.createDataFrame([], schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """One sorted CSV part for a report; a table without order is written by all tasks."""
    out = df.orderBy(*order).coalesce(1) if order else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report, written to whatever file system the path names, as tables are."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_json(spark: SparkSession, values: dict[str, Any], path: str) -> None:
    write_text(spark, json.dumps(values, indent=2, sort_keys=True), path)
