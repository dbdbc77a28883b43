"""Choosing a threshold and a size cap on validation data."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scores import close, confusion, harmonic, pairs_of, share
from kinweave.operators.graph import merge_under_cap, rooted_edges
from kinweave.sources.config import Settings


class PolicyError(ValueError):
    """No policy meets the precision floor."""


def grid(low: float, high: float, step: float) -> list[float]:
    """The thresholds as floats that scores are compared with; reports round them to ten places."""
    return np.arange(low, high + step / 2, step).tolist()


def threshold_curve(pairs: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """Pair quality at each threshold of a short fixed grid."""
    grid_rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(round(t, 10)).alias("threshold")) for t in grid(low, high, step)])
    every = pairs.select("is_related", "relation_score", F.explode(grid_rows).alias("g"))
    return every.select("is_related", (F.col("relation_score") >= F.col("g.t")).cast("int").alias("p"), "g.threshold").groupBy("threshold").agg(*confusion("is_related", "p"))


def select_threshold(curve: DataFrame) -> float:
    """Highest f1, then highest precision, then highest threshold; within float tolerance."""
    best = curve.agg(F.max("f1")).first()[0]
    tied = curve.filter(close(F.col("f1"), F.lit(best)))
    precise = tied.agg(F.max("precision")).first()[0]
    return float(tied.filter(close(F.col("precision"), F.lit(precise))).agg(F.max("threshold")).first()[0])


def policy_curve(pairs: DataFrame, truth: DataFrame, settings: Settings) -> DataFrame:
    """Group quality for each threshold and cap.

    Edges are rooted once, at the lowest threshold: no grouping ever crosses those components. Each is worked on in one
    task over the whole grid and gives sums that add up over components; accounts without edges add a constant.
    """
    thresholds = grid(settings.threshold_min, settings.threshold_max, settings.threshold_step)
    caps = list(settings.component_size_candidates)
    sized = truth.groupBy("true_group_id").agg(F.count("*").alias("n_true"))
    members = truth.select("account_id", "true_group_id").join(sized, "true_group_id")
    active = pairs.withColumn("_on", (F.col("relation_score") >= thresholds[0]).cast("int"))
    edges = rooted_edges(active, "_on", "relation_score")
    nodes = edges.select("root", F.explode(F.array("a", "b")).alias("account_id")).distinct()
    known = nodes.join(members, "account_id")
    rows = edges.select("root", "a", "b", "score", F.lit(None).cast("string").alias("true_group_id"), F.lit(0).cast("long").alias("n_true"))
    rows = rows.unionByName(known.select("root", F.col("account_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"), "true_group_id", "n_true"))
    names = ["threshold", "max_component_size", "both", "predicted", "bp", "br", "deferred"]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["b"].isna()]
        truth_of = dict(zip(own["a"], own["true_group_id"], strict=True))
        true_size = dict(zip(own["a"], own["n_true"].astype(int), strict=True))
        edge = group[group["b"].notna()]
        found = list(zip(edge["a"], edge["b"], edge["score"], strict=True))
        out = []
        for t in thresholds:
            strong = [e for e in found if e[2] >= t]
            for cap in caps:
                roots, told = merge_under_cap(strong, cap)
                cells = Counter((roots.get(x, x), g) for x, g in truth_of.items())
                sizes = Counter(roots.get(x, x) for x in truth_of)
                size_of = {g: true_size[x] for x, g in truth_of.items()}
                out.append((
                    round(t, 10), cap,
                    sum(n * (n - 1) // 2 for n in cells.values()), sum(n * (n - 1) // 2 for n in sizes.values()),
                    sum(n * n / sizes[r] for (r, _), n in cells.items()), sum(n * n / size_of[g] for (_, g), n in cells.items()),
                    sum(d[6] == "deferred_component_cap" for d in told),
                ))
        return pd.DataFrame(out, columns=names)

    parts = rows.groupBy("root").applyInPandas(work, "threshold double, max_component_size int, both long, predicted long, bp double, br double, deferred long")
    zero = F.array(*[F.struct(F.lit(round(t, 10)).alias("threshold"), F.lit(c).alias("max_component_size")) for t in thresholds for c in caps])
    alone = members.join(nodes, "account_id", "left_anti").agg(F.count("*").alias("n"), F.coalesce(F.sum(1 / F.col("n_true")), F.lit(0.0)).alias("b"))
    lone = alone.select(F.explode(zero).alias("g"), "n", "b").select("g.*", F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("predicted"), F.col("n").cast("double").alias("bp"), F.col("b").alias("br"), F.lit(0).cast("long").alias("deferred"))
    sums = parts.unionByName(lone).groupBy("threshold", "max_component_size").agg(*[F.sum(c).alias(c) for c in names[2:]])
    actual = sized.agg(F.sum(pairs_of(F.col("n_true"))).alias("actual"), F.sum("n_true").alias("accounts"))
    every = sums.crossJoin(F.broadcast(actual))  # one row beside the grid's rows
    both, predicted = F.col("both"), F.col("predicted")
    p, r = share(both, predicted), share(both, F.col("actual"))
    bp, br = F.col("bp") / F.col("accounts"), F.col("br") / F.col("accounts")
    cost = settings.false_merge_cost * (predicted - both) + settings.false_split_cost * (F.col("actual") - both)
    return every.select(
        "threshold", "max_component_size", p.alias("component_precision"), r.alias("component_recall"), harmonic(p, r).alias("component_f1"),
        (predicted - both).alias("false_merges"), (F.col("actual") - both).alias("false_splits"),
        bp.alias("bcubed_precision"), br.alias("bcubed_recall"), harmonic(bp, br).alias("bcubed_f1"),
        cost.cast("double").alias("weighted_error_cost"), F.col("deferred").alias("deferred_edges"), (p >= settings.precision_floor).alias("meets_precision_floor"),
    )


def best_policy(curve: DataFrame) -> DataFrame:
    """The cheapest policy above the floor; then the best f1, the highest threshold, the least cap."""
    order = ["weighted_error_cost", F.desc("component_f1"), F.desc("threshold"), "max_component_size"]
    return curve.filter("meets_precision_floor").orderBy(*order).limit(1)


def select_policy(curve: DataFrame) -> tuple[float, int]:
    row = best_policy(curve).first()
    if row is None:
        raise PolicyError("No component policy meets the configured precision floor")
    return row["threshold"], row["max_component_size"]


def mark_selected(curve: DataFrame, threshold: float, cap: int) -> DataFrame:
    return curve.withColumn("selected", close(F.col("threshold"), F.lit(threshold)) & (F.col("max_component_size") == cap))


def best_by_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest cap at each threshold, for plots."""
    value = F.struct("weighted_error_cost", -F.col("component_f1"), "max_component_size")
    rest = [c for c in curve.columns if c != "threshold"]
    best = curve.groupBy("threshold").agg(F.min_by(F.struct(*rest), value).alias("r")).select("threshold", "r.*")
    return best.withColumnsRenamed({"component_precision": "precision", "component_recall": "recall", "component_f1": "f1"})
