"""A synthetic benchmark: noisy addresses of accounts, and the truth behind them.

``generate`` follows one seeded stream of draws, so that a seed always gives the same tables; ``spread`` gives tables
of any size on the executors, with noise drawn from hashes instead.
"""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The generator's names and shares.
CITIES = ("North City", "Central City", "South City")
STREETS = ("Cedar", "Maple", "Willow", "Oak", "Pine", "Elm")
UNIT_SIZES, UNIT_SHARES = (1, 2, 3, 4, 6), (0.44, 0.26, 0.16, 0.10, 0.04)
NOISE, NOISE_SHARES = ("clean", "moderate", "heavy"), (0.30, 0.48, 0.22)
HOUSEHOLD_SHARE, TOKEN_SHARE = 0.65, 0.82
BLANK_UNIT, WRONG_UNIT, BLANK_POSTCODE = 0.18, 0.36, 0.65
FIRST_DAY, DAYS = datetime(2025, 1, 1), 365
DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ORDERS = "order_id string, account_id string, city string, street string, building string, unit string, postcode string, family_token string, order_date timestamp"
TRUTHS = "account_id string, true_group_id string, true_relation_type string, building_id int, unit_id int, noise_level string, split string"


def _persian(n: int) -> str:
    return "".join(DIGITS[int(d)] for d in str(n))


class _Stream:
    """The draws of one seed, in their fixed order."""

    def __init__(self, seed: int) -> None:
        self.draw = np.random.default_rng(seed)

    def splits(self, buildings: int, validation: float, test: float) -> dict[int, str]:
        order = self.draw.permutation(np.arange(1, buildings + 1)).tolist()
        v, t = round(buildings * validation), round(buildings * test)
        return {b: "validation" if i < v else "test" if i < v + t else "train" for i, b in enumerate(order)}

    def household(self) -> tuple[int, str]:
        size = int(self.draw.choice(UNIT_SIZES, p=UNIT_SHARES))
        if size == 1:
            return size, "singleton"
        if size >= 6:
            return size, "shared_location"
        return size, "household_signal" if self.draw.random() < HOUSEHOLD_SHARE else "shared_residence"

    def noise(self) -> str:
        return str(self.draw.choice(NOISE, p=NOISE_SHARES))

    def heavy(self, place: dict, unit: int) -> dict[str, str]:
        chance = self.draw.random()
        shown = "" if chance < BLANK_UNIT else _persian(unit + 1) if chance < WRONG_UNIT else _persian(unit)
        street = place["street"].replace("Street", "St")
        gone = int(self.draw.choice([i for i, c in enumerate(street) if c.isascii() and c.isalpha()]))
        code = "" if self.draw.random() < BLANK_POSTCODE else place["postcode"].replace("-", "")
        return {"city": place["city"], "street": street[:gone] + street[gone + 1 :], "building": f"B {_persian(place['number'])}", "unit": shown, "postcode": code}


def _address(stream: _Stream, place: dict, unit: int, noise: str) -> dict[str, str]:
    if noise == "heavy":
        return stream.heavy(place, unit)
    if noise == "clean":
        return {"city": place["city"], "street": place["street"], "building": f"Building {place['number']}", "unit": f"Unit {unit}", "postcode": place["postcode"]}
    return {"city": place["city"].upper(), "street": place["street"].replace("Street", "St."), "building": f"Bldg-{place['number']}", "unit": f"Apt {_persian(unit)}", "postcode": place["postcode"].replace("-", " ")}


def rows(seed: int = 42, buildings: int = 180, units_per_building: int = 4, validation_share: float = 0.2, test_share: float = 0.2) -> tuple[list[tuple], list[tuple]]:
    """(orders, truth) as rows in the order of ORDERS and TRUTHS."""
    stream = _Stream(seed)
    split = stream.splits(buildings, validation_share, test_share)
    orders: list[tuple] = []
    truth: list[tuple] = []
    for group in range(buildings * units_per_building):
        number, unit = group // units_per_building + 1, group % units_per_building + 1
        place = {"number": number, "city": CITIES[(number - 1) % 3], "street": f"{STREETS[(number - 1) % 6]} Street {(number - 1) // 6 + 1}", "postcode": f"PC-{(number - 1) % 3 + 1}-{number:04d}"}
        size, relation = stream.household()
        for _ in range(size):
            account = f"ACC-{len(truth) + 1:06d}"
            noise = stream.noise()
            address = _address(stream, place, unit, noise)
            shared = relation == "household_signal" and stream.draw.random() < TOKEN_SHARE
            token = f"FAM-{group + 1:05d}" if shared else f"FAM-X-{len(truth) + 1:06d}"
            truth.append((account, f"REL-{group + 1:05d}", relation, number, unit, noise, split[number]))
            for _ in range(int(stream.draw.integers(2, 6))):
                day = FIRST_DAY + timedelta(days=int(stream.draw.integers(0, DAYS)))
                orders.append((f"ORD-{len(orders) + 1:07d}", account, *address.values(), token, day))
    return orders, truth


def generate(spark: SparkSession, **shape: float) -> tuple[DataFrame, DataFrame]:
    orders, truth = rows(**shape)
    return spark.createDataFrame(orders, ORDERS), spark.createDataFrame(truth, TRUTHS)


def spread(spark: SparkSession, accounts: int, orders_per_account: int = 3) -> DataFrame:
    """Observations for load tests, made where they are used; eight accounts a building, two a unit."""
    n = F.col("id")
    account = F.expr(f"id div {orders_per_account}")
    building, unit = F.expr(f"id div {8 * orders_per_account}"), F.expr(f"(id div {2 * orders_per_account}) % 4 + 1")
    street = F.concat(F.element_at(F.array(*[F.lit(s) for s in STREETS]), (building % 6 + 1).cast("int")), F.lit(" Street "), building.cast("string"))
    heavy = F.pmod(F.xxhash64(account), F.lit(100)) < 22
    return spark.range(accounts * orders_per_account).select(
        F.format_string("ORD-%012d", n).alias("order_id"),
        F.format_string("ACC-%010d", account).alias("account_id"),
        F.element_at(F.array(*[F.lit(c) for c in CITIES]), (building % 3 + 1).cast("int")).alias("city"),
        F.when(heavy, F.regexp_replace(street, "Street", "St")).otherwise(street).alias("street"),
        F.concat(F.lit("Building "), building.cast("string")).alias("building"),
        F.when(heavy & (F.pmod(F.xxhash64(account, F.lit(1)), F.lit(100)) < 18), F.lit("")).otherwise(F.concat(F.lit("Unit "), unit.cast("string"))).alias("unit"),
        F.concat(F.lit("PC-"), building.cast("string")).alias("postcode"),
        F.concat(F.lit("FAM-"), building.cast("string"), F.lit("-"), unit.cast("string")).alias("family_token"),
        F.expr("timestamp'2025-01-01' + make_dt_interval(cast(pmod(xxhash64(id), 365) as int))").alias("order_date"),
    )
