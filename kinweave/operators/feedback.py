"""Audit of reviewers' answers against the exported edges; only aggregates leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scores import rate
from kinweave.sources.schemas import FEEDBACK, GUARDRAIL

OUTCOMES = ("match", "not_match", "uncertain")
DECISIONS = ("accepted_merge", "accepted_redundant", "deferred_component_cap")
REFERENCE = r"^REF-[0-9a-f]{20}\z"


class FeedbackError(ValueError):
    """Exported edges or answers break the audit's contract."""


def _stripped(column: str) -> F.Column:
    return F.regexp_replace(F.col(column).cast("string"), r"^(?U)\s+|(?U)\s+$", "")


def canonical(frame: DataFrame, value: str, lower: bool = False) -> DataFrame:
    """(pair_left, pair_right, value): trimmed, in order."""
    a, b = _stripped("account_ref_a"), _stripped("account_ref_b")
    own = F.lower(_stripped(value)) if lower else _stripped(value)
    return frame.select(F.least(a, b).alias("pair_left"), F.greatest(a, b).alias("pair_right"), a.alias("a"), b.alias("b"), own.alias(value))


def answer_facts(rows: DataFrame, value: str, allowed: tuple[str, ...]) -> DataFrame:
    """One row with how many canonical rows break each rule, and how many pairs come again."""
    other = F.when(~F.col(value).isin(list(allowed)), F.substring(value, 1, 40))
    broken = lambda c: F.count(F.when(F.coalesce(c, F.lit(True)), 1))
    facts = rows.agg(
        F.count("*").alias("rows"),
        *[broken((F.col(s).isNull()) | (F.col(s) == "")).alias(f"{s}_blank") for s in ("a", "b")],
        *[broken(~F.col(s).rlike(REFERENCE)).alias(f"{s}_form") for s in ("a", "b")],
        broken(F.col("a") == F.col("b")).alias("self"),
        broken(F.col(value).isNull() | (F.col(value) == "")).alias("empty"),
        F.count(other).alias("others"),
        F.min(other).alias("other"),
    )
    pairs = rows.groupBy("pair_left", "pair_right").count().agg(F.count(F.when(F.col("count") > 1, 1)).alias("repeated"))
    return facts.crossJoin(pairs)  # one row and one row


def _check(frame: DataFrame, needed: list[str], value: str, allowed: tuple[str, ...], what: str, lower: bool) -> DataFrame:
    missing = sorted(set(needed) - set(frame.columns))
    if missing:
        raise FeedbackError(f"Missing required columns: {missing}")
    rows = canonical(frame, value, lower)
    facts = answer_facts(rows, value, allowed).first()
    if not facts["rows"]:
        raise FeedbackError("Input must not be empty")
    for s in ("a", "b"):
        if facts[f"{s}_blank"]:
            raise FeedbackError(f"account_ref_{s} must not be null or blank")
        if facts[f"{s}_form"]:
            raise FeedbackError(f"account_ref_{s} must contain pseudonymous references in REF-<20 hex> format")
    if facts["self"]:
        raise FeedbackError("Self-pairs are not allowed")
    if facts["repeated"]:
        raise FeedbackError("Each account pair may appear only once")
    if facts["empty"]:
        raise FeedbackError(f"{value} must not be null or blank")
    if facts["others"]:
        raise FeedbackError(f"Unsupported {what}: {facts['others']} rows, such as {facts['other']!r}")
    return rows.select("pair_left", "pair_right", value)


def unknown_pairs(edges: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.join(edges, ["pair_left", "pair_right"], "left_anti")


def validated(guardrail: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = _check(guardrail, GUARDRAIL.names, "guardrail_decision", DECISIONS, "guardrail decisions", False)
    answers = _check(feedback, FEEDBACK.names, "review_outcome", OUTCOMES, "review outcomes", True)
    if not unknown_pairs(edges, answers).isEmpty():
        raise FeedbackError("Review feedback contains pairs that are not present in the guardrail export")
    return edges, answers


def feedback_summary(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """Counts and rates for all edges, accepted and deferred ones, and each decision: one aggregation, each edge in three scopes."""
    joined = edges.join(answers, ["pair_left", "pair_right"], "left")
    decision = F.col("guardrail_decision")
    kind = F.when(decision.startswith("accepted_"), F.lit("accepted_edges")).otherwise(F.lit("deferred_edges"))
    scoped = joined.select(F.explode(F.array(F.lit("overall"), kind, F.concat(F.lit("decision:"), decision))).alias("scope"), "review_outcome")
    count = lambda *values: F.sum(F.coalesce(F.col("review_outcome").isin(list(values)), F.lit(False)).cast("long"))
    total, reviewed, decisive = F.count("*"), F.count("review_outcome"), count("match", "not_match")
    match, other, open_ = count("match"), count("not_match"), count("uncertain")
    return scoped.groupBy("scope").agg(
        total.alias("total_edges"), reviewed.alias("reviewed_edges"), decisive.alias("decisive_edges"), match.alias("confirmed_matches"), other.alias("confirmed_non_matches"), open_.alias("uncertain_edges"),
        rate(reviewed, total).alias("review_coverage"), rate(decisive, reviewed).alias("decisive_share_of_reviewed"), rate(match, decisive).alias("match_rate_among_decisive"), rate(other, decisive).alias("non_match_rate_among_decisive"),
    )
