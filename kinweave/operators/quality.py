"""Quality of pairs and groups against the truth, as aggregates: no pair of members is ever listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scores import confusion, harmonic, pairs_of, share
from kinweave.operators.contracts import require
from kinweave.operators.features import true_pairs
from kinweave.sources.schemas import NOISE_LEVELS

MODELS = {"exact_key_baseline": "baseline_match", "scored_resolution": "enhanced_match", "guarded_resolution": "guardrail_match"}


def with_threshold(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.withColumn("enhanced_match", (F.col("relation_score") >= threshold).cast("int"))


def _by_model(pairs: DataFrame) -> DataFrame:
    """A row for each pair and model, with its prediction."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in MODELS.items() if c in pairs.columns])
    return pairs.select("is_related", "pair_noise_level", F.explode(models).alias("m")).select("is_related", "pair_noise_level", "m.*")


def pair_confusion(pairs: DataFrame) -> DataFrame:
    return _by_model(pairs).groupBy("model").agg(*confusion("is_related", "predicted"))


def errors_by_noise(pairs: DataFrame) -> DataFrame:
    return _by_model(pairs).groupBy(F.col("pair_noise_level").alias("noise_level"), "model").agg(F.count("*").alias("pairs"), *confusion("is_related", "predicted"))


def recall_by_noise(pairs: DataFrame) -> DataFrame:
    own = pairs.filter("is_related = 1").groupBy(F.col("pair_noise_level").alias("noise_level"))
    return own.agg(F.count("*").alias("positive_pairs"), F.avg("baseline_match").alias("baseline_recall"), F.avg("enhanced_match").alias("enhanced_recall"))


def in_noise_order(df: DataFrame, *then: str) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*[F.lit(n) for n in NOISE_LEVELS]), F.col("noise_level")), *then)


def contingency(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """(predicted_group_id, true_group_id, n, n_predicted, n_true): how groups and truth overlap."""
    require(assigned, "Assignments", ["account_id", "predicted_group_id"], "account_id")
    require(truth, "Truth", ["account_id", "true_group_id"], "account_id")
    joined = truth.select("account_id", "true_group_id").join(assigned, "account_id", "left")
    lacking = F.raise_error(F.lit("Assignments must cover every truth account"))
    group = F.coalesce("predicted_group_id", lacking.cast("string")).alias("predicted_group_id")
    cells = joined.groupBy(group, "true_group_id").agg(F.count("*").alias("n"))
    predicted = cells.groupBy("predicted_group_id").agg(F.sum("n").alias("n_predicted"))
    actual = cells.groupBy("true_group_id").agg(F.sum("n").alias("n_true"))
    return cells.join(predicted, "predicted_group_id").join(actual, "true_group_id")


def _totals(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of sums. A marginal total is the sum over cells of n (n_marginal - 1) / 2."""
    n, p, t = F.col("n"), F.col("n_predicted"), F.col("n_true")
    return contingency(assigned, truth).agg(
        F.coalesce(F.sum(pairs_of(n)), F.lit(0)).alias("both"),
        F.coalesce(F.round(F.sum(n * (p - 1)) / 2).cast("long"), F.lit(0)).alias("predicted"),
        F.coalesce(F.round(F.sum(n * (t - 1)) / 2).cast("long"), F.lit(0)).alias("actual"),
        F.sum(n).alias("accounts"),
        (F.sum(n * n / p) / F.sum(n)).alias("bp"),
        (F.sum(n * n / t) / F.sum(n)).alias("br"),
    )


def component_pair_metrics(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    both, predicted, actual = F.col("both"), F.col("predicted"), F.col("actual")
    p, r = share(both, predicted), share(both, actual)
    return _totals(assigned, truth).select(p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"), both.alias("true_positives"), (predicted - both).alias("false_merges"), (actual - both).alias("false_splits"))


def bcubed(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    p, r = F.col("bp"), F.col("br")
    return _totals(assigned, truth).select(p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def adjusted_rand(assigned: DataFrame, truth: DataFrame) -> DataFrame:
    """The adjusted Rand index from pair counts; 1 where groups and truth agree."""
    tp, fp, fn = F.col("both").cast("double"), (F.col("predicted") - F.col("both")).cast("double"), (F.col("actual") - F.col("both")).cast("double")
    tn = F.col("accounts") * (F.col("accounts") - 1) / 2 - tp - fp - fn
    index = F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return _totals(assigned, truth).select(F.when((fp == 0) & (fn == 0), 1.0).otherwise(index).alias("ari"))


def candidate_recall(pairs: DataFrame, truth: DataFrame, split: str) -> DataFrame:
    """The share of a split's true pairs that blocking found; 1 if there are none."""
    expected = true_pairs(truth, split)
    found = pairs.filter(F.col("split") == split).select("account_a", "account_b", F.lit(1).alias("hit"))
    return expected.join(found, ["account_a", "account_b"], "left").agg(F.lit(split).alias("split"), F.count("*").alias("expected_pairs"), F.coalesce(F.try_divide(F.count("hit").cast("double"), F.count("*").cast("double")), F.lit(1.0)).alias("candidate_recall"))
