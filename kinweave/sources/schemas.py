"""Schemas of the input tables. Values are read as strings: type inference would turn '0012' into 12 and 'NA' into null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ADDRESS = ("city", "street", "building", "unit", "postcode", "family_token")
LOCATION = ("city", "street", "building", "postcode")
OBSERVATIONS = _strings("order_id", "account_id", *ADDRESS, "order_date")
TRUTH = _strings("account_id", "true_group_id", "true_relation_type", "building_id", "unit_id", "noise_level", "split")
GUARDRAIL = _strings("account_ref_a", "account_ref_b", "guardrail_decision")
FEEDBACK = _strings("account_ref_a", "account_ref_b", "review_outcome")
#: Labels that must not be among observations.
FORBIDDEN = {"true_group_id", "true_relation_type", "building_id", "unit_id", "split", "noise_level", "is_related"}
SPLITS = ("train", "validation", "test")
NOISE_LEVELS = ("clean", "moderate", "heavy")
_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "MM/dd/yyyy HH:mm:ss")


def parsed_date(column: str) -> Column:
    """The UTC time of a timestamp, date or date text in any supported format; null if it is none."""
    value = F.col(column)
    return F.coalesce(F.try_to_timestamp(value.cast("string")), *[F.try_to_timestamp(value.cast("string"), F.lit(f)) for f in _FORMATS])
