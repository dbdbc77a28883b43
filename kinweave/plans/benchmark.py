"""The synthetic benchmark: choose a policy on validation buildings, judge it on test buildings, and across seeds."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import policy, quality
from kinweave.operators.features import with_labels
from kinweave.operators.graph import component_assignments, group_profiles, guarded_assignments, largest, mark_guarded
from kinweave.operators.storage import materialize
from kinweave.operators.validation import validate_truth
from kinweave.plans.analysis import fingerprint, prepare
from kinweave.sources.config import Settings
from kinweave.sources.files import write_csv, write_json, write_text
from kinweave.sources.synthetic import generate

STABLE = ("guarded_pair_precision", "guarded_pair_recall", "guarded_pair_f1", "guarded_component_precision", "guarded_component_recall", "guarded_component_f1", "guarded_bcubed_f1")


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def _deferred(audit: DataFrame) -> int:
    return audit.filter("guardrail_decision = 'deferred_component_cap'").count()


def stability(spark: SparkSession, settings: Settings) -> list[dict[str, Any]]:
    """The frozen policy on test buildings of each seed: one row a seed."""
    told = []
    for seed in settings.stability_seeds:
        orders, truth = generate(spark, seed=seed, buildings=settings.stability_buildings, units_per_building=settings.units_per_building, validation_share=settings.validation_share, test_share=settings.test_share)
        validate_truth(orders, truth)
        ready = prepare(orders, settings)
        labelled = quality.with_threshold(with_labels(ready.pairs, truth), settings.policy_threshold)
        pairs, own = materialize(labelled.filter("split = 'test'")), truth.filter("split = 'test'")
        accounts = own.select("account_id")
        plain = component_assignments(accounts, pairs, "enhanced_match", check=False)
        guarded, audit = guarded_assignments(accounts, pairs, "enhanced_match", "relation_score", settings.policy_max_component_size, check=False)
        by_model = {r["model"]: r for r in quality.pair_confusion(mark_guarded(pairs, audit)).collect()}  # three rows
        row: dict[str, Any] = {"seed": seed, "accounts": truth.count(), "candidate_pairs": ready.pairs.count(), "test_candidate_recall": _one(quality.candidate_recall(pairs, truth, "test"))["candidate_recall"]}
        for name, model in (("scored", "scored_resolution"), ("guarded", "guarded_resolution")):
            row |= {f"{name}_pair_{m}": by_model[model][m] for m in ("precision", "recall", "f1")}
        for name, groups in (("scored", plain), ("guarded", guarded)):
            found = _one(quality.component_pair_metrics(groups, own))
            row |= {f"{name}_component_{m}": found[m] for m in ("precision", "recall", "f1")}
        told.append(row | {"guarded_bcubed_f1": _one(quality.bcubed(guarded, own))["f1"], "deferred_edges": _deferred(audit)})
    return told


def stability_summary(rows: DataFrame) -> DataFrame:
    """mean, population std, min and max of each stable measure."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in STABLE])).alias("x")).select("x.*")
    return each.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def reproduce(spark: SparkSession, output: str | None = None, settings: Settings | None = None) -> dict[str, Any]:
    """Metrics of the whole benchmark; with ``output``, its reports too."""
    s = settings or Settings()
    orders, truth = generate(spark, seed=s.seed, buildings=s.buildings, units_per_building=s.units_per_building, validation_share=s.validation_share, test_share=s.test_share)
    seen = validate_truth(orders, truth)
    ready = prepare(orders, s)
    pairs = materialize(with_labels(ready.pairs, truth))
    curve = materialize(policy.policy_curve(pairs.filter("split = 'validation'"), truth.filter("split = 'validation'"), s))
    threshold, cap = policy.select_policy(curve)
    curve = policy.mark_selected(curve, threshold, cap)
    scored = quality.with_threshold(pairs, threshold)
    own = truth.filter("split = 'test'")
    accounts = own.select("account_id")
    test = materialize(scored.filter("split = 'test'"))
    guarded, audit = guarded_assignments(accounts, test, "enhanced_match", "relation_score", cap)
    test = materialize(mark_guarded(test, audit))
    groups = {"exact_key_baseline": component_assignments(accounts, test, "baseline_match"), "scored_resolution": component_assignments(accounts, test, "enhanced_match", check=False), "guarded_resolution": guarded}
    groups = {k: materialize(v) for k, v in groups.items()}
    everyone = truth.select("account_id")
    plain_all = component_assignments(everyone, scored, "enhanced_match")
    all_groups, all_audit = guarded_assignments(everyone, scored, "enhanced_match", "relation_score", cap)
    all_groups = materialize(all_groups)
    profiles = group_profiles(all_groups, ready.signed, mark_guarded(scored, all_audit), "guardrail_match")
    seeds = stability(spark, s)
    steady: dict[str, Any] = {"seeds": len(seeds)}
    if seeds:
        rows = spark.createDataFrame(seeds)
        steady |= {"seed_values": list(s.stability_seeds), "buildings_per_seed": s.stability_buildings}
        steady |= {r["metric"]: {k: r[k] for k in ("mean", "std", "min", "max")} for r in stability_summary(rows).collect()}
    chosen = _one(curve.filter("selected"))
    blocks = materialize(ready.audit)
    measures = ("precision", "recall", "f1", "true_positives", "false_positives", "false_negatives", "true_negatives")
    told = {
        "data": dataclasses.asdict(seen),
        "blocking": {
            "strategies": ["city_building", "postcode", "city_street"], "candidate_pairs": ready.pairs.count(), "max_block_size": s.max_block_size,
            "deferred_oversized_blocks": blocks.filter("block_decision = 'deferred_oversized'").count(),
            "candidate_recall": {x: _one(quality.candidate_recall(pairs, truth, x))["candidate_recall"] for x in ("validation", "test")},
        },
        "policy": {
            "version": s.policy_version, "selected_threshold": threshold, "selected_max_component_size": cap, "selection_split": "validation", "precision_floor": s.precision_floor,
            "false_merge_cost": s.false_merge_cost, "false_split_cost": s.false_split_cost, "validation_weighted_error_cost": chosen["weighted_error_cost"],
            "validation_component_precision": chosen["component_precision"], "validation_component_recall": chosen["component_recall"],
        },
        "selected_threshold": threshold,
        "pair_evaluation": {r["model"]: {m: r[m] for m in measures} for r in quality.pair_confusion(test).collect()},
        "cluster_ari": {m: _one(quality.adjusted_rand(g, own))["ari"] for m, g in groups.items()},
        "component_pair_evaluation": {m: _one(quality.component_pair_metrics(g, own)) for m, g in groups.items()},
        "bcubed_evaluation": {m: _one(quality.bcubed(g, own)) for m, g in groups.items()},
        "policy_stability": steady,
        "component_guardrail": {
            "max_component_size": cap, "test_deferred_edges": _deferred(audit), "all_deferred_edges": _deferred(all_audit),
            "largest_test_component_before": largest(groups["scored_resolution"]), "largest_test_component_after": largest(guarded),
            "largest_all_component_before": largest(plain_all), "largest_all_component_after": largest(all_groups), "deferred_edges_are_review_candidates": True,
        },
        "artifact_fingerprint": fingerprint(orders, truth, ready.signed, pairs, blocks, curve, test, all_groups, all_audit, profiles),
        "evaluation_boundary": "Synthetic address observations and held-out buildings only",
    }
    if output:
        out = f"{output}/reports"
        write_csv(orders, f"{output}/data/orders.csv", "order_id")
        write_csv(truth, f"{output}/data/truth.csv", "account_id")
        write_csv(ready.signed, f"{output}/data/account_signatures.csv", "account_id")
        write_csv(curve, f"{out}/component_policy_curve.csv", "threshold", "max_component_size")
        write_csv(policy.best_by_threshold(curve), f"{out}/threshold_curve.csv", "threshold")
        write_csv(blocks, f"{out}/candidate_block_audit.csv", "blocking_strategy", "block_key_hash")
        write_csv(test, f"{out}/test_pairs.csv", "account_a", "account_b")
        write_csv(all_audit, f"{out}/component_guardrail.csv", F.desc("relation_score"), "account_a", "account_b")
        write_csv(quality.in_noise_order(quality.recall_by_noise(test)), f"{out}/noise_recall.csv")
        write_csv(quality.in_noise_order(quality.errors_by_noise(test), "model"), f"{out}/subgroup_errors.csv")
        if seeds:
            write_csv(spark.createDataFrame(seeds), f"{out}/policy_stability.csv", "seed")
        write_csv(all_groups, f"{out}/predicted_group_assignments.csv", "account_id")
        write_csv(profiles, f"{out}/review_groups.csv", "predicted_group_id")
        write_json(spark, told, f"{out}/metrics.json")
        write_text(spark, summary(told), f"{out}/run_summary.md")
    return told


def summary(told: dict[str, Any]) -> str:
    """The headline figures as Markdown."""
    pair, ari, guard = told["pair_evaluation"], told["cluster_ari"], told["component_guardrail"]
    lines = [f"Threshold {told['selected_threshold']:.2f}, component-size cap {told['policy']['selected_max_component_size']} (chosen on validation buildings)"]
    lines += [f"{m}: pair F1 {pair[m]['f1']:.3f}, cluster ARI {ari[m]:.3f} on test buildings" for m in ("exact_key_baseline", "scored_resolution", "guarded_resolution")]
    lines += [f"Guarded B-cubed F1: {told['bcubed_evaluation']['guarded_resolution']['f1']:.3f}", f"Deferred edges: {guard['all_deferred_edges']}; largest component {guard['largest_all_component_before']} before and {guard['largest_all_component_after']} after the guardrail", f"Fingerprint: `{told['artifact_fingerprint']}`"]
    return "# Benchmark summary\n\n" + "\n".join(f"- {x}" for x in lines) + "\n\nSynthetic data. Groups are signals for review, not statements about people.\n"
