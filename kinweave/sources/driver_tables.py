"""Observations, truth and reviewers' answers derived from the driver's order tables, in SQL that Spark and DuckDB share.

Eight customers share a building and two a unit; every eleventh order went to the building next door. A third of
accounts write their address cleanly, half with abbreviations and Persian digits, the rest with typos and gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DIGITS = "'0123456789', '۰۱۲۳۴۵۶۷۸۹'"

BASE = """
SELECT o_orderkey, o_orderdate, o_custkey AS k,
       CAST(floor(o_custkey / 8) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS b,
       CAST(floor((o_custkey % 8) / 2) AS BIGINT) + 1 AS u,
       CASE WHEN o_custkey % 10 < 3 THEN 'clean' WHEN o_custkey % 10 < 8 THEN 'moderate' ELSE 'heavy' END AS noise
FROM orders
"""

PLACED = f"""
SELECT base.*, n_name AS town, CAST(b AS STRING) AS bs, CAST(u AS STRING) AS us,
       concat(CASE WHEN b % 6 = 0 THEN 'Cedar' WHEN b % 6 = 1 THEN 'Maple' WHEN b % 6 = 2 THEN 'Willow' WHEN b % 6 = 3 THEN 'Oakley' WHEN b % 6 = 4 THEN 'Pines' ELSE 'Elmwood' END, ' Street ', CAST(b AS STRING)) AS road,
       concat('PC-', CAST(b % 3 + 1 AS STRING), '-', lpad(CAST(b AS STRING), 8, '0')) AS code
FROM ({BASE}) base JOIN nation ON n_nationkey = b % 25
"""

OBSERVATIONS = f"""
SELECT concat('ORD-', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS order_id,
       concat('ACC-', lpad(CAST(k AS STRING), 10, '0')) AS account_id,
       CASE WHEN noise = 'moderate' THEN concat(' ', town, '. ') ELSE town END AS city,
       CASE WHEN noise = 'clean' THEN road WHEN noise = 'moderate' THEN replace(road, 'Street', 'St.') ELSE concat(substr(road, 1, 1), substr(replace(road, 'Street', 'St'), 3)) END AS street,
       CASE WHEN noise = 'clean' THEN concat('Building ', bs) WHEN noise = 'moderate' THEN concat('Bldg-', bs) ELSE concat('B ', translate(bs, {_DIGITS})) END AS building,
       CASE WHEN noise = 'clean' THEN concat('Unit ', us) WHEN noise = 'moderate' THEN concat('Apt ', translate(us, {_DIGITS})) WHEN k % 3 = 0 THEN '' ELSE translate(us, {_DIGITS}) END AS unit,
       CASE WHEN noise = 'clean' THEN code WHEN noise = 'moderate' THEN replace(code, '-', ' ') WHEN k % 4 < 2 THEN '' ELSE replace(code, '-', '') END AS postcode,
       CASE WHEN (k + u) % 3 = 0 THEN concat('FAM-X-', CAST(k AS STRING)) ELSE concat('FAM-', CAST(CAST(floor(k / 8) AS BIGINT) AS STRING), '-', us) END AS family_token,
       o_orderdate AS order_date
FROM ({PLACED}) placed
"""

TRUTH = f"""
SELECT DISTINCT concat('ACC-', lpad(CAST(k AS STRING), 10, '0')) AS account_id,
       concat('REL-', CAST(CAST(floor(k / 8) AS BIGINT) AS STRING), '-', CAST(u AS STRING)) AS true_group_id,
       'shared_residence' AS true_relation_type, CAST(floor(k / 8) AS BIGINT) AS building_id, u AS unit_id, noise AS noise_level,
       CASE WHEN CAST(floor(k / 8) AS BIGINT) % 5 = 0 THEN 'validation' WHEN CAST(floor(k / 8) AS BIGINT) % 5 = 1 THEN 'test' ELSE 'train' END AS split
FROM ({BASE}) base
"""


def _tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    orders, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "nation"))
    return spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("JOIN nation", "JOIN {nation}"), orders=orders, nation=nation) if "JOIN nation" in sql else spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, OBSERVATIONS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir, TRUTH)
