"""Rates and quality measures as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(rate(part, whole), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def confusion(actual: str, predicted: str) -> list[Column]:
    """precision, recall, f1 and the four counts, as aggregates over 0/1 columns."""
    hit = lambda a, p: F.sum(((F.col(actual) == a) & (F.col(predicted) == p)).cast("long"))
    count = lambda a, p: F.coalesce(hit(a, p), F.lit(0))
    tp, fp, fn, tn = count(1, 1), count(0, 1), count(1, 0), count(0, 0)
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    # 2 tp / (2 tp + fp + fn) is the same f1 with one rounding.
    named = {"precision": precision, "recall": recall, "f1": share(2 * tp, 2 * tp + fp + fn), "true_positives": tp, "false_positives": fp, "false_negatives": fn, "true_negatives": tn}
    return [c.alias(n) for n, c in named.items()]


def pairs_of(n: Column) -> Column:
    """How many pairs n things have."""
    return (n * (n - 1) / 2).cast("long")


def close(a: Column, b: Column) -> Column:
    """Equal within the usual float tolerance."""
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
