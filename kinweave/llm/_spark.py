"""Small helpers shared by the operators: materialising, sized broadcasts, partition counts."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. One of its own is made only in local mode (tests); elsewhere it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="kinweave-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage; a lost executor loses nothing of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def part_bits(spark: SparkSession, least: int = 6) -> int:
    """log2 of the number of hash ranges: at least the session's shuffle partitions, so that ranges shrink as it grows."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, (max(1, partitions) - 1).bit_length())


def deal(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """One partition for each value 0..partitions-1 of the column."""
    return df.repartitionById(partitions, F.col(column).cast("int"))


#: A side of a join is broadcast only after its rows were counted and found no more than this.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, row_bytes: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the counted rows allow it; otherwise the join shuffles. ``df`` should be materialised.

    The count shrinks with the width of a row, so that at most about 16 MB are broadcast.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit * 16 else df


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    return df.select(*[F.col(quoted(n)) for n in names])


def map_arrow(df: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: they go through as numbers, and the result gets the schema's names."""
    fields = [T.StructField(f"_{i}", f.dataType) for i, f in enumerate(schema.fields)]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=[f.name for f in fields])

    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(numbered, T.StructType(fields)).toDF(*schema.names)


def row_key(df: DataFrame, id_: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit columns, _k1 and _k2, that name a row by its id and text; equal rows share them, and are judged alike.

    The key depends on content alone, so a task that runs again makes the same ones.
    """
    own = [F.col(quoted(id_)).isNull(), F.col(quoted(id_)), F.col(quoted(text)).isNull(), F.col(quoted(text))]
    return [F.xxhash64(F.lit(seed), *own).alias(name) for seed, name in ((1, "_k1"), (2, "_k2"))]


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to differ from every column of the table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
