"""Audit of reviewers' feedback: aggregates only, as JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from kinweave.operators.feedback import feedback_summary, validated
from kinweave.plans.analysis import fingerprint
from kinweave.sources.files import write_json

# Fixed names: the counts, rates and sections are those that readers of the metrics expect.
EMPTY = {"total_edges": 0, "reviewed_edges": 0, "decisive_edges": 0, "confirmed_matches": 0, "confirmed_non_matches": 0, "uncertain_edges": 0, "review_coverage": None, "decisive_share_of_reviewed": None, "match_rate_among_decisive": None, "non_match_rate_among_decisive": None}


def audit_feedback(guardrail: DataFrame, feedback: DataFrame, output: str | None = None) -> dict[str, Any]:
    edges, answers = validated(guardrail, feedback)
    scopes = {r["scope"]: {k: v for k, v in r.asDict().items() if k != "scope"} for r in feedback_summary(edges, answers).collect()}  # at most six rows
    accepted, deferred = scopes.get("accepted_edges", EMPTY), scopes.get("deferred_edges", EMPTY)
    told = {
        "overall": scopes["overall"],
        "accepted_edges": accepted | {"observed_precision": accepted["match_rate_among_decisive"], "observed_false_merge_rate": accepted["non_match_rate_among_decisive"]},
        "deferred_edges": deferred | {"observed_match_rate": deferred["match_rate_among_decisive"]},
        "by_guardrail_decision": {k.removeprefix("decision:"): v for k, v in scopes.items() if k.startswith("decision:")},
        "artifact_fingerprint": fingerprint(edges, answers),
        "evaluation_boundary": "What reviewers saw: exported edges with high scores. Nothing here tells of recall, of candidates or of whole groups.",
        "privacy": {"raw_account_ids_required": False, "raw_addresses_required": False, "pair_references_exported": False, "aggregate_output_only": True},
    }
    if output:
        write_json(guardrail.sparkSession, told, f"{output}/reports/review_feedback_metrics.json")
    return told
