"""What operators ask of their inputs before they join them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """A table that an operator cannot be applied to."""


def require(df: DataFrame, what: str, columns: tuple[str, ...] | list[str], *key: str) -> None:
    """The columns must be there and, with a key, no two rows may share it: a join on it must not multiply rows."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise InputError(f"{what}: columns {lacking} are not there")
    if key and not df.groupBy(*key).agg(F.count("*").alias("_rows")).filter("_rows > 1").isEmpty():
        raise InputError(f"{what}: several rows for one {' and '.join(key)}")
