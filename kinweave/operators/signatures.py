"""One recent, really observed address for each account."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import normalize_text, number_field, postcode
from kinweave.sources.schemas import parsed_date

TUPLE = ("city_norm", "street_norm", "building_norm", "unit_norm", "postcode_norm")


def normalized_addresses(orders: DataFrame) -> DataFrame:
    """account_id, order_id, observed_at and the normalized fields of every observation."""
    text = {c: normalize_text(c) for c in ("city", "street", "building", "unit", "postcode", "family_token")}
    words = orders.select("order_id", F.col("account_id").cast("string").alias("account_id"), parsed_date("order_date").alias("observed_at"), *[t.alias(c) for c, t in text.items()])
    return words.select(
        "order_id",
        "account_id",
        "observed_at",
        F.col("city").alias("city_norm"),
        F.col("street").alias("street_norm"),
        number_field(F.col("building"), "building").alias("building_norm"),
        number_field(F.col("unit"), "unit").alias("unit_norm"),
        postcode(F.col("postcode")).alias("postcode_norm"),
        F.col("family_token").alias("family_token_norm"),
    )


def recent(orders: DataFrame, snapshot_date: str | None = None, history_days: int = 365) -> DataFrame:
    """Observations up to the snapshot and inside each account's window, which ends at its own latest one."""
    if history_days < 1:
        raise ValueError("history_days must be positive")
    dated = orders.withColumn("_at", parsed_date("order_date"))
    if snapshot_date is not None:
        dated = dated.filter(F.col("_at") <= F.to_timestamp(F.lit(str(snapshot_date))))
    latest = F.max("_at").over(Window.partitionBy("account_id"))
    return dated.withColumn("_latest", latest).filter(F.col("_at") >= F.col("_latest") - F.make_dt_interval(F.lit(history_days))).drop("_at", "_latest")


def signatures(orders: DataFrame, snapshot_date: str | None = None, history_days: int = 365) -> DataFrame:
    """A row for each account: its most frequent, then most recent, then least address tuple, and what is known of it.

    The family token is the most frequent one among the tuple's observations, the least of equals. Everything keeps
    the shuffle by account: tuples are counted, ranked and summed within it.
    """
    rows = normalized_addresses(recent(orders, snapshot_date, history_days))
    tuples = rows.groupBy("account_id", *TUPLE).agg(
        F.count_distinct("order_id").alias("address_observations"),
        F.max("observed_at").alias("_last"),
        F.mode("family_token_norm", True).alias("family_token_norm"),
    )
    account = Window.partitionBy("account_id")
    order = account.orderBy(F.desc("address_observations"), F.desc("_last"), *TUPLE)
    ranked = tuples.select(
        "*",
        F.row_number().over(order).alias("_rank"),
        F.count("*").over(account).alias("address_history_count"),
        F.sum("address_observations").over(account).alias("observed_orders"),
    )
    complete = F.expr(" AND ".join(f"{c} <> ''" for c in TUPLE))
    return ranked.filter("_rank = 1").select(
        "account_id",
        *TUPLE,
        "family_token_norm",
        "observed_orders",
        "address_observations",
        "address_history_count",
        F.date_format("_last", "yyyy-MM-dd").alias("address_as_of_date"),
        F.when(complete, F.concat_ws("|", *TUPLE)).otherwise(F.lit("")).alias("exact_address_key"),
    )


def exact_key_groups(signed: DataFrame) -> DataFrame:
    """Accounts that share a complete normalized address."""
    return signed.filter("exact_address_key <> ''").groupBy("exact_address_key").agg(F.count("*").alias("accounts"), F.min("account_id").alias("first_account")).filter("accounts > 1")
