"""Candidate pairs from several blocking passes, with an audit of every block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.contracts import require

PASSES = {"city_building": ("city_norm", "building_norm"), "postcode": ("postcode_norm",), "city_street": ("city_norm", "street_norm")}

BLOCKED = sorted({field for fields in PASSES.values() for field in fields})


def block_members(signed: DataFrame) -> DataFrame:
    """(blocking_strategy, k1, k2, account_id): where each account stands; a pass needs all of its fields."""
    parts = []
    for name, fields in PASSES.items():
        second = F.col(fields[1]) if len(fields) > 1 else F.lit("")
        parts.append(F.when(F.expr(" AND ".join(f"{c} <> ''" for c in fields)), F.struct(F.lit(name).alias("s"), F.col(fields[0]).alias("k1"), second.alias("k2"))))
    placed = signed.select("account_id", F.explode(F.array_compact(F.array(*parts))).alias("b"))
    return placed.select(F.col("b.s").alias("blocking_strategy"), "b.k1", "b.k2", "account_id")


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("blocking_strategy", "k1", "k2").agg(F.count("*").alias("block_size")).filter("block_size > 1")


def block_audit(signed: DataFrame, max_block_size: int = 250) -> DataFrame:
    """A row for each block of two accounts or more; raw keys are only shown as hashes."""
    _check(max_block_size)
    sizes = _sizes(block_members(signed))
    key = F.when(F.col("blocking_strategy") == "postcode", F.concat_ws("|", "blocking_strategy", "k1")).otherwise(F.concat_ws("|", "blocking_strategy", "k1", "k2"))
    large = F.col("block_size") > max_block_size
    return sizes.select(
        "blocking_strategy",
        F.substring(F.sha2(key, 256), 1, 16).alias("block_key_hash"),
        "block_size",
        F.when(large, F.lit(0)).otherwise((F.col("block_size") * (F.col("block_size") - 1) / 2)).cast("long").alias("generated_pairs"),
        F.when(large, F.lit("deferred_oversized")).otherwise(F.lit("accepted")).alias("block_decision"),
    )


def _check(max_block_size: int) -> None:
    if max_block_size < 2:
        raise ValueError("max_block_size must be at least two")


def candidate_pairs(signed: DataFrame, max_block_size: int = 250, check: bool = True) -> DataFrame:
    """Distinct pairs (account_a < account_b) of all passes, and which passes gave them.

    Blocks above the cap are deferred, as the audit says, before any pair is made: sizes are counted with partial
    aggregation and joined back, so an oversized block never reaches the pairing. Within a block each account meets the
    accounts before it, gathered by a window of at most ``max_block_size`` rows. ``check=False`` is for signatures that
    are known to have one row for each account.
    """
    _check(max_block_size)
    require(signed, "Signatures", ["account_id", *BLOCKED], *(["account_id"] if check else []))
    members = block_members(signed)
    key = ["blocking_strategy", "k1", "k2"]
    allowed = _sizes(members).filter(F.col("block_size") <= max_block_size).select(*key)
    within = Window.partitionBy(*key).orderBy("account_id").rowsBetween(Window.unboundedPreceding, -1)
    met = members.join(allowed, key, "left_semi").withColumn("before", F.collect_list("account_id").over(within))
    pairs = met.select(F.explode("before").alias("account_a"), F.col("account_id").alias("account_b"), "blocking_strategy")
    return pairs.groupBy("account_a", "account_b").agg(
        F.array_join(F.array_sort(F.collect_set("blocking_strategy")), "+").alias("blocking_strategies"),
        F.count("*").cast("int").alias("blocking_passes"),
    )
