"""Evidence of candidate pairs, its weighted score, and (for evaluation only) their labels."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.contracts import require
from kinweave.sources.schemas import NOISE_LEVELS

# The weight of each kind of evidence, in the order in which they are summed.
WEIGHTS = {"street_similarity": 0.45, "unit_match": 0.35, "postcode_match": 0.15, "family_token_match": 0.05}
FEATURES = ("city_match", "street_similarity", "building_match", "unit_match", "postcode_match", "family_token_match")


@lru_cache(maxsize=100_000)
def _ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio()


@F.pandas_udf(T.DoubleType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else _ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def street_similarity(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts, 0 if one is empty. Equal texts, most pairs of a block, never leave the JVM."""
    differ = (a != "") & (b != "") & (a != b)
    ratio = _similar(F.when(differ, a), F.when(differ, b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(ratio)


def pair_features(candidates: DataFrame, signed: DataFrame, check: bool = True) -> DataFrame:
    """Features, availability, relation_score and baseline_match of each candidate pair; no truth comes near it."""
    fields = ["city_norm", "street_norm", "building_norm", "unit_norm", "postcode_norm", "family_token_norm", "exact_address_key"]
    require(candidates, "Candidates", ["account_a", "account_b", "blocking_strategies", "blocking_passes"], *(["account_a", "account_b"] if check else []))
    require(signed, "Signatures", ["account_id", *fields], *(["account_id"] if check else []))
    side = lambda s: signed.select(F.col("account_id").alias(f"account_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in fields])
    joined = candidates.join(side("a"), "account_a", "left").join(side("b"), "account_b", "left")
    a, b = (lambda c, s=s: F.col(f"{c}_{s}") for s in ("a", "b"))
    equal = lambda c: a(c) == b(c)
    known = lambda c: (a(c) != "") & (b(c) != "")
    double = lambda x: x.cast("double")
    rows = joined.select(
        "account_a",
        "account_b",
        "blocking_strategies",
        "blocking_passes",
        double(equal("city_norm")).alias("city_match"),
        street_similarity(a("street_norm"), b("street_norm")).alias("street_similarity"),
        double(equal("building_norm")).alias("building_match"),
        double(known("unit_norm") & equal("unit_norm")).alias("unit_match"),
        double(known("postcode_norm") & equal("postcode_norm")).alias("postcode_match"),
        double(known("family_token_norm") & equal("family_token_norm")).alias("family_token_match"),
        known("postcode_norm").alias("postcode_available"),
        known("family_token_norm").alias("family_token_available"),
        ((a("exact_address_key") != "") & equal("exact_address_key")).cast("int").alias("baseline_match"),
    )
    total = weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + F.col(name) * w
        there = {"postcode_match": "postcode_available", "family_token_match": "family_token_available"}.get(name)
        weight = weight + (double(F.col(there)) * w if there else F.lit(w))
    scored = rows.withColumn("relation_score", F.coalesce(total / weight, F.lit(0.0)))
    return scored.select("account_a", "account_b", "blocking_strategies", "blocking_passes", *FEATURES, "postcode_available", "family_token_available", "relation_score", "baseline_match")


def with_labels(pairs: DataFrame, truth: DataFrame, check: bool = True) -> DataFrame:
    """Pairs within one split, with its name, building, noise and whether the accounts are related."""
    require(truth, "Truth", ["account_id", "true_group_id", "split", "building_id", "noise_level"], *(["account_id"] if check else []))
    rank = F.array_position(F.array(*[F.lit(n) for n in NOISE_LEVELS]), F.col("noise_level"))
    side = lambda s: truth.select(F.col("account_id").alias(f"account_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("true_group_id", "split")], rank.alias(f"noise_{s}"), F.col("building_id").alias(f"building_{s}"))
    joined = pairs.join(side("a"), "account_a", "left").join(side("b"), "account_b", "left")
    lacking = F.raise_error(F.lit("Every candidate account must exist in ground truth"))
    split = F.when(F.col("split_a").isNull() | F.col("split_b").isNull(), lacking).otherwise(F.col("split_a"))
    worst = F.element_at(F.array(*[F.lit(n) for n in NOISE_LEVELS]), F.greatest("noise_a", "noise_b").cast("int"))
    checked = F.when(F.least("noise_a", "noise_b") > 0, worst).otherwise(F.raise_error(F.lit("Unsupported noise level")))
    rows = joined.withColumn("split", split).filter("split = split_b")
    return rows.select(
        "account_a", "account_b", "split", F.col("building_a").alias("building_id"), checked.alias("pair_noise_level"), *[c for c in pairs.columns if c not in ("account_a", "account_b")],
        ((F.col("true_group_id_a") == F.col("true_group_id_b")) & (F.col("account_a") != F.col("account_b"))).cast("int").alias("is_related"),
    )


def true_pairs(truth: DataFrame, split: str) -> DataFrame:
    """Every pair of related accounts of a split; groups are households, so pairs stay few."""
    own = truth.filter(F.col("split") == split).select("account_id", "true_group_id")
    other = own.select(F.col("account_id").alias("account_b"), "true_group_id")
    return own.join(other, "true_group_id").filter("account_id < account_b").select(F.col("account_id").alias("account_a"), "account_b")
