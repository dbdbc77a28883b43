"""Cutting lineage safely."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def materialize(df: DataFrame) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and go on from there. A folder of its own is made in local mode only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-"))
    return df.checkpoint(eager=True)
