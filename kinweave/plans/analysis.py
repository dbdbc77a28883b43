"""Operational analysis: unlabelled observations to pseudonymised groups for review."""

from __future__ import annotations

import dataclasses
import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.blocking import block_audit, candidate_pairs
from kinweave.operators.features import pair_features
from kinweave.operators.graph import group_profiles, guarded_assignments, mark_guarded
from kinweave.operators.privacy import account_reference
from kinweave.operators.quality import with_threshold
from kinweave.operators.signatures import signatures
from kinweave.operators.storage import materialize
from kinweave.operators.validation import validate_observations
from kinweave.sources.config import Settings
from kinweave.sources.files import write_csv, write_json


# Fixed names: the sections and keys of the metadata, and the names of the reports, are those that readers expect.
PRIVACY = {
    "raw_addresses_exported": False,
    "raw_account_ids_exported": False,
    "identifier_method": "keyed hash of the id (HMAC, SHA-256), its first 20 hex digits",
    "purpose": "signals that people look at; nothing is decided by them",
    "retention": "inputs and reports are to be removed as the policy of the case says",
    "access": "reviewers with permission only, and never against the persons concerned",
}


@dataclass
class Prepared:
    signed: DataFrame
    pairs: DataFrame
    audit: DataFrame


def prepare(orders: DataFrame, settings: Settings, snapshot_date: str | None = None) -> Prepared:
    signed = materialize(signatures(orders, snapshot_date, settings.address_history_days))
    if signed.isEmpty():
        raise ValueError("No observations are available at the requested snapshot date")
    pairs = materialize(pair_features(candidate_pairs(signed, settings.max_block_size, check=False), signed, check=False))
    return Prepared(signed, pairs, block_audit(signed, settings.max_block_size))


def grouped(ready: Prepared, threshold: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, guardrail audit, profiles) under a frozen policy."""
    scored = with_threshold(ready.pairs, threshold)
    assigned, audit = guarded_assignments(ready.signed.select("account_id"), scored, "enhanced_match", "relation_score", cap, check=False)
    return assigned, audit, group_profiles(assigned, ready.signed, mark_guarded(scored, audit), "guardrail_match")


def fingerprint(*frames: DataFrame) -> str:
    """16 hex digits that follow the rows of tables and not their order: sums of row hashes, so any size will do."""
    parts = []
    for df in frames:
        row = df.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), *df.columns).cast("decimal(38,0)")) for k in (1, 2)]).first()
        parts.append(f"{','.join(df.columns)}|{'|'.join(map(str, row))}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def safe_exports(assigned: DataFrame, audit: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Assignments and edges with references in place of ids."""
    safe = assigned.select(account_reference("account_id", salt).alias("account_ref"), "predicted_group_id")
    rest = [c for c in audit.columns if c not in ("account_a", "account_b")]
    return safe, audit.select(account_reference("account_a", salt).alias("account_ref_a"), account_reference("account_b", salt).alias("account_ref_b"), *rest)


def analyze(orders: DataFrame, output: str, *, identifier_salt: str, settings: Settings | None = None, snapshot_date: str | None = None) -> dict[str, Any]:
    """Validate, group, and write only pseudonymised reports under ``output``/reports; returns the metadata."""
    if len(identifier_salt) < 16:
        raise ValueError("identifier_salt must contain at least 16 characters")
    settings = settings or Settings()
    seen = validate_observations(orders)
    ready = prepare(orders, settings, snapshot_date)
    assigned, audit, profiles = grouped(ready, settings.policy_threshold, settings.policy_max_component_size)
    assigned, profiles, blocks = materialize(assigned), materialize(profiles), materialize(ready.audit)
    safe, edges = safe_exports(assigned, audit, identifier_salt)
    reports = f"{output}/reports"
    write_csv(safe, f"{reports}/predicted_group_assignments.csv", "predicted_group_id", "account_ref")
    write_csv(edges, f"{reports}/component_guardrail.csv", F.desc("relation_score"), "account_ref_a", "account_ref_b")
    write_csv(profiles, f"{reports}/review_groups.csv", "predicted_group_id")
    write_csv(blocks, f"{reports}/candidate_block_audit.csv", "blocking_strategy", "block_key_hash")
    told = {
        "observations": dataclasses.asdict(seen),
        "policy": {"version": settings.policy_version, "threshold": settings.policy_threshold, "max_component_size": settings.policy_max_component_size},
        "blocking": {"candidate_pairs": ready.pairs.count(), "max_block_size": settings.max_block_size, "deferred_oversized_blocks": blocks.filter("block_decision = 'deferred_oversized'").count()},
        "review": {"predicted_groups": profiles.count(), "deferred_component_edges": audit.filter("guardrail_decision = 'deferred_component_cap'").count()},
        "privacy": PRIVACY,
        "artifact_fingerprint": fingerprint(safe, edges, profiles, blocks),
    }
    write_json(orders.sparkSession, told, f"{reports}/analysis_metadata.json")
    return told
