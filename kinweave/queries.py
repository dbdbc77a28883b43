"""Queries of the linkage engine over the driver's tables, and DuckDB SQL for each.

Accounts, truth and reviewers' answers come from ``sources.driver_tables``. The SQL is put together from common table
expressions that restate each operator; scores are rounded to nine places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import normalize_text
from kinweave.operators import feedback, policy, quality, validation
from kinweave.operators.blocking import block_audit, candidate_pairs
from kinweave.operators.features import pair_features, true_pairs, with_labels
from kinweave.operators.graph import component_assignments, group_profiles, guarded_assignments, largest, mark_guarded, review_building
from kinweave.operators.privacy import account_reference
from kinweave.operators.signatures import exact_key_groups, normalized_addresses, signatures
from kinweave.operators.storage import materialize
from kinweave.plans.benchmark import STABLE, stability_summary
from kinweave.sources.config import Settings
from kinweave.sources.driver_tables import OBSERVATIONS, TRUTH, observations, truth

SETTINGS = Settings()
SALT = "an-example-salt-for-checks"
SNAPSHOT = "1998-06-30"
THRESHOLD, CAP = SETTINGS.policy_threshold, SETTINGS.policy_max_component_size


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return signatures(observations(spark, d), history_days=SETTINGS.address_history_days)


def _features(spark: SparkSession, d: str, signed: DataFrame | None = None) -> DataFrame:
    signed = signed or materialize(_signed(spark, d))  # one row an account, as they are grouped by it
    return pair_features(candidate_pairs(signed, SETTINGS.max_block_size, check=False), signed, check=False)


def _scored(spark: SparkSession, d: str, signed: DataFrame | None = None) -> DataFrame:
    return materialize(quality.with_threshold(with_labels(_features(spark, d, signed), truth(spark, d), check=False), THRESHOLD))


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select("account_id")


def _guarded(spark: SparkSession, d: str, signed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = _scored(spark, d, signed)
    assigned, audit = guarded_assignments(_accounts(spark, d), pairs, "enhanced_match", "relation_score", CAP)
    return pairs, assigned, audit


def _test(spark: SparkSession, d: str) -> DataFrame:
    pairs, _, audit = _guarded(spark, d)
    return mark_guarded(pairs, audit).filter("split = 'test'")


def _judged(spark: SparkSession, d: str, measure: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A measure of the plain groups of the test split."""
    own = truth(spark, d).filter("split = 'test'")
    pairs = _scored(spark, d).filter("split = 'test'")
    return _rounded(measure(component_assignments(own.select("account_id"), pairs, "enhanced_match"), own))


def _curve(spark: SparkSession, d: str) -> DataFrame:
    pairs = _scored(spark, d).filter("split = 'validation'")
    return policy.policy_curve(pairs, truth(spark, d).filter("split = 'validation'"), SETTINGS)


def _threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    pairs = _scored(spark, d).filter("split = 'validation'")
    return policy.threshold_curve(pairs, SETTINGS.threshold_min, SETTINGS.threshold_max, SETTINGS.threshold_step)


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Exported edges, and answers to most of them in the reverse order."""
    _, _, audit = _guarded(spark, d)
    number = lambda c: F.substring(c, 5, 10).cast("long")
    choice = (number("account_a") + 3 * number("account_b")) % 4
    a, b = account_reference("account_a", SALT), account_reference("account_b", SALT)
    edges = audit.select(a.alias("account_ref_a"), b.alias("account_ref_b"), "guardrail_decision")
    said = F.when(choice == 0, "match").when(choice == 1, " Not_Match ").when(choice == 2, "uncertain")
    answers = audit.select(b.alias("account_ref_a"), a.alias("account_ref_b"), said.alias("review_outcome")).filter("review_outcome IS NOT NULL")
    return materialize(edges), materialize(answers)


def observation_summary(spark: SparkSession, d: str) -> DataFrame:
    return validation.observation_facts(observations(spark, d)).select("orders", "accounts", "first_order_date", "last_order_date")


def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many rows break each rule, on orders of which some are made to: every rule is broken by a known part."""
    number = F.substring("order_id", 5, 12).cast("long")
    own = observations(spark, d).withColumn("n", number)
    nowhere = F.col("n") % 101 == 3
    bad = own.select(
        F.when(F.col("n") % 97 == 1, F.lit(" \t")).when(F.col("n") % 89 == 2, "ORD-TWICE").otherwise(F.col("order_id")).alias("order_id"),
        F.when(F.col("n") % 83 != 4, F.col("account_id")).alias("account_id"),
        *[F.when(nowhere, F.lit(x)).otherwise(F.col(c)).alias(c) for c, x in (("city", " "), ("street", ""), ("building", None), ("postcode", ""))],
        F.repeat("unit", 100).alias("unit"), "family_token",
        F.when(F.col("n") % 79 == 5, "soon").when(F.col("n") % 73 != 6, F.col("order_date").cast("string")).alias("order_date"),
    )
    return validation.observation_facts(bad).select("order_id_blank", "account_id_blank", "order_id_repeated", "nowhere", "longest", "undated")


def crossing_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups that would cross splits if accounts, not buildings, were split."""
    own = truth(spark, d).withColumn("split", F.when(F.substring("account_id", 13, 2).cast("int") % 2 == 0, "train").otherwise("test"))
    return validation.crossing(own, "true_group_id", "split")


def truth_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of truth break each rule, on rows of which some are made to."""
    n = F.substring("account_id", 5, 10).cast("long")
    bad = truth(spark, d).select(
        F.when(n % 31 == 1, F.lit(" \t")).when(n % 29 == 2, "ACC-TWICE").otherwise(F.col("account_id")).alias("account_id"),
        F.when(n % 23 != 3, F.col("true_group_id")).alias("true_group_id"),
        F.when(n % 19 == 4, "").otherwise(F.col("building_id").cast("string")).alias("building_id"),
        F.when(n % 17 == 5, "holdout").when(n % 13 != 6, F.col("split")).alias("split"),
        F.when(n % 11 == 7, "extreme").when(n % 7 != 3, F.col("noise_level")).alias("noise_level"),
    )
    return validation.truth_facts(bad).withColumn("splits", F.size("splits"))


def unmatched_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that only orders or only truth knows, after each lost some."""
    n = F.substring("account_id", 5, 10).cast("long")
    return validation.unmatched_accounts(observations(spark, d).filter(n % 5 != 0), truth(spark, d).filter(n % 7 != 0))


def character_folding(spark: SparkSession, d: str) -> DataFrame:
    """Letters of several code points that are written alike, joiners and digits, around each nation's name."""
    text = F.concat(F.lit(_LETTERS + "\u0640 "), "n_name", F.lit("\u200c\u06f4\u0665 "), F.col("n_nationkey").cast("string"))
    names = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", text.alias("t"))
    return names.select("n_nationkey", normalize_text("t").alias("folded"))


def largest_groups(spark: SparkSession, d: str) -> DataFrame:
    """The size of the largest group without and with the cap."""
    pairs, assigned, _ = _guarded(spark, d)
    return spark.createDataFrame([(largest(component_assignments(_accounts(spark, d), pairs, "enhanced_match")), largest(assigned))], "before_cap long, after_cap long")


def measure_spread(spark: SparkSession, d: str) -> DataFrame:
    """The stability summary, of measures over the policies instead of over seeds."""
    rows = _curve(spark, d).select(*[F.col(c).alias(m) for c, m in zip(_SPREAD, STABLE, strict=True)])
    return _rounded(stability_summary(rows))


def document_normalization(spark: SparkSession, d: str) -> DataFrame:
    text = normalize_text("text")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("normalized_sha256"))


_LETTERS = "يىكةۀؤإأٱ"
_SPREAD = ("component_precision", "component_recall", "component_f1", "bcubed_precision", "bcubed_recall", "bcubed_f1", "weighted_error_cost")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that share an address: groups under the size cap, with their evidence."""
    signed = materialize(_signed(spark, sf_dir))
    pairs, assigned, audit = _guarded(spark, sf_dir, signed)
    return _rounded(group_profiles(assigned, signed, mark_guarded(pairs, audit), "guardrail_match"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "observation_summary": observation_summary,
    "contract_violations": contract_violations,
    "crossing_groups": crossing_groups,
    "document_normalization": document_normalization,
    "normalized_addresses": lambda s, d: normalized_addresses(observations(s, d)).drop("observed_at"),
    "account_signatures": _signed,
    "snapshot_signatures": lambda s, d: signatures(observations(s, d), SNAPSHOT, 180),
    "exact_key_groups": lambda s, d: exact_key_groups(_signed(s, d)),
    "block_audit": lambda s, d: block_audit(_signed(s, d), SETTINGS.max_block_size),
    "candidate_pairs": lambda s, d: candidate_pairs(_signed(s, d), SETTINGS.max_block_size),
    "oversized_blocks": lambda s, d: block_audit(_signed(s, d), 5),
    "oversized_deferral": lambda s, d: candidate_pairs(_signed(s, d), 5),
    "pair_features": lambda s, d: _rounded(_features(s, d)),
    "labelled_pairs": lambda s, d: _scored(s, d).select("account_a", "account_b", "split", "building_id", "pair_noise_level", "is_related", "enhanced_match"),
    "true_pairs": lambda s, d: true_pairs(truth(s, d), "test"),
    "connected_components": lambda s, d: component_assignments(_accounts(s, d), _scored(s, d), "enhanced_match"),
    "guarded_components": lambda s, d: _guarded(s, d)[1],
    "guardrail_audit": lambda s, d: _rounded(_guarded(s, d)[2]),
    "group_profiles": flagship,
    "review_building": lambda s, d: _rounded(review_building(_test(s, d))),
    "pair_confusion": lambda s, d: _rounded(quality.pair_confusion(_test(s, d))),
    "noise_recall": lambda s, d: _rounded(quality.recall_by_noise(_test(s, d))),
    "subgroup_errors": lambda s, d: _rounded(quality.errors_by_noise(_test(s, d))),
    "component_pair_metrics": lambda s, d: _judged(s, d, quality.component_pair_metrics),
    "bcubed": lambda s, d: _judged(s, d, quality.bcubed),
    "adjusted_rand": lambda s, d: _judged(s, d, quality.adjusted_rand),
    "candidate_recall": lambda s, d: _rounded(quality.candidate_recall(_scored(s, d), truth(s, d), "test")),
    "threshold_curve": lambda s, d: _rounded(_threshold_curve(s, d)),
    "policy_curve": lambda s, d: _rounded(_curve(s, d)),
    "selected_policy": lambda s, d: _rounded(policy.best_policy(materialize(_curve(s, d)))),
    "best_by_threshold": lambda s, d: _rounded(policy.best_by_threshold(materialize(_curve(s, d)))),
    "pseudonymized_refs": lambda s, d: _accounts(s, d).select("account_id", account_reference("account_id", SALT).alias("account_ref")),
    "feedback_summary": lambda s, d: _rounded(feedback.feedback_summary(*feedback.validated(*_answers(s, d)))),
    "feedback_unknown_pairs": lambda s, d: _unknown(s, d),
    "feedback_violations": lambda s, d: _broken_answers(s, d),
    "truth_violations": truth_violations,
    "unmatched_accounts": unmatched_accounts,
    "character_folding": character_folding,
    "largest_groups": largest_groups,
    "selected_threshold": lambda s, d: s.createDataFrame([(policy.select_threshold(materialize(_threshold_curve(s, d))),)], "threshold double"),
    "marked_policy": lambda s, d: policy.mark_selected(_curve(s, d), THRESHOLD + 1e-6, CAP).select("threshold", "max_component_size", "selected"),
    "measure_spread": measure_spread,
}


def _unknown(spark: SparkSession, d: str) -> DataFrame:
    """Answers to edges that were accepted, held against an export of the deferred ones."""
    edges, answers = _answers(spark, d)
    deferred = feedback.canonical(edges.filter("guardrail_decision = 'deferred_component_cap'"), "guardrail_decision")
    return feedback.unknown_pairs(deferred, feedback.canonical(answers, "review_outcome", lower=True)).select("pair_left", "pair_right", "review_outcome")


def _broken_answers(spark: SparkSession, d: str) -> DataFrame:
    """How many answers break each rule, on answers of which some are made to, by the first digit of a reference."""
    _, answers = _answers(spark, d)
    digit = F.substring("account_ref_a", 5, 1)
    again = answers.filter(digit == "5").select(F.col("account_ref_b").alias("account_ref_a"), F.col("account_ref_a").alias("account_ref_b"), "review_outcome")
    bad = answers.select(
        F.when(digit == "0", "REF-XYZ").when(digit == "1", " ").otherwise(F.col("account_ref_a")).alias("account_ref_a"),
        F.when(digit == "2", F.col("account_ref_a")).otherwise(F.col("account_ref_b")).alias("account_ref_b"),
        F.when(digit == "3", "maybe").when(digit != "4", F.col("review_outcome")).alias("review_outcome"),
    )
    rows = feedback.canonical(bad.union(again), "review_outcome", lower=True)
    return feedback.answer_facts(rows, "review_outcome", feedback.OUTCOMES).drop("other")


# DuckDB's side.


def _norm(column: str) -> str:
    words = rf"string_split(regexp_replace(lower(translate(coalesce({column}, ''), '۰۱۲۳۴۵۶۷۸۹', '0123456789')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"
    return f"array_to_string(list_transform(list_filter({words}, lambda t: t <> ''), lambda t: CASE t WHEN 'st' THEN 'street' WHEN 'bldg' THEN 'building' WHEN 'apt' THEN 'unit' ELSE t END), ' ')"


def _number(column: str, words: str) -> str:
    only = f"CASE WHEN len(regexp_extract_all({column}, '[0-9]+')) = 1 THEN regexp_extract_all({column}, '[0-9]+')[1] ELSE '' END"
    return rf"regexp_replace(coalesce(nullif(regexp_extract({column}, '(?:^| )(?:{words}) ([0-9]+)(?: |$)', 1), ''), {only}), '^0+(.)', '\1')"


_FIELDS = ("city_norm", "street_norm", "building_norm", "unit_norm", "postcode_norm")


def _signature_sql(days: int, snapshot: str | None = None) -> str:
    cut = f"WHERE order_date <= TIMESTAMP '{snapshot}'" if snapshot else ""
    t = ", ".join(_FIELDS)
    return f"""
obs AS MATERIALIZED ({OBSERVATIONS}),
dated AS (SELECT *, max(order_date) OVER (PARTITION BY account_id) AS latest FROM obs {cut}),
words AS (SELECT order_id, account_id, order_date, {_norm('city')} AS city_norm, {_norm('street')} AS street_norm, {_norm('building')} AS b_, {_norm('unit')} AS u_, {_norm('postcode')} AS p_, {_norm('family_token')} AS family_token_norm FROM dated WHERE order_date >= latest - INTERVAL {days} DAY),
norm AS MATERIALIZED (SELECT order_id, account_id, order_date, city_norm, street_norm, {_number('b_', 'building|bldg')} AS building_norm, {_number('u_', 'unit|apt')} AS unit_norm, replace(p_, ' ', '') AS postcode_norm, family_token_norm FROM words),
token AS (SELECT account_id, {t}, family_token_norm, row_number() OVER (PARTITION BY account_id, {t} ORDER BY count(*) DESC, family_token_norm) AS r FROM norm GROUP BY account_id, {t}, family_token_norm),
tup AS (SELECT account_id, {t}, count(DISTINCT order_id) AS address_observations, max(order_date) AS last FROM norm GROUP BY account_id, {t}),
ranked AS (SELECT tup.*, row_number() OVER (PARTITION BY account_id ORDER BY address_observations DESC, last DESC, {t}) AS r, count(*) OVER (PARTITION BY account_id) AS hist, sum(address_observations) OVER (PARTITION BY account_id) AS total FROM tup),
sig AS MATERIALIZED (SELECT account_id, {', '.join('ranked.' + f for f in _FIELDS)}, family_token_norm, total::BIGINT AS observed_orders, address_observations::BIGINT AS address_observations, hist::BIGINT AS address_history_count, strftime(last, '%Y-%m-%d') AS address_as_of_date,
  CASE WHEN city_norm <> '' AND street_norm <> '' AND building_norm <> '' AND unit_norm <> '' AND postcode_norm <> '' THEN concat_ws('|', {t}) ELSE '' END AS exact_address_key
  FROM ranked JOIN token USING (account_id, {t}) WHERE ranked.r = 1 AND token.r = 1)"""


def _pairs_sql(cap: int) -> str:
    return f"""
member AS (SELECT 'city_building' AS s, city_norm AS k1, building_norm AS k2, account_id FROM sig WHERE city_norm <> '' AND building_norm <> ''
  UNION ALL SELECT 'postcode', postcode_norm, '', account_id FROM sig WHERE postcode_norm <> '' UNION ALL SELECT 'city_street', city_norm, street_norm, account_id FROM sig WHERE city_norm <> '' AND street_norm <> ''),
block AS (SELECT s, k1, k2, count(*)::BIGINT AS n FROM member GROUP BY ALL HAVING count(*) > 1),
cand AS MATERIALIZED (SELECT a.account_id AS account_a, b.account_id AS account_b, string_agg(a.s, '+' ORDER BY a.s) AS blocking_strategies, count(*)::INTEGER AS blocking_passes
  FROM block JOIN member a USING (s, k1, k2) JOIN member b USING (s, k1, k2) WHERE n <= {cap} AND a.account_id < b.account_id GROUP BY 1, 2)"""


_AUDIT_COLUMNS = "s AS blocking_strategy, substr(sha256(CASE WHEN s = 'postcode' THEN concat_ws('|', s, k1) ELSE concat_ws('|', s, k1, k2) END), 1, 16) AS block_key_hash, n AS block_size"


def _audit_sql(cap: int) -> str:
    return f"SELECT {_AUDIT_COLUMNS}, CASE WHEN n > {cap} THEN 0 ELSE (n * (n - 1) // 2) END::BIGINT AS generated_pairs, CASE WHEN n > {cap} THEN 'deferred_oversized' ELSE 'accepted' END AS block_decision FROM block"


_FEATURES_SQL = """
feat AS (SELECT c.*, (a.city_norm = b.city_norm)::INT::DOUBLE AS city_match,
    CASE WHEN a.street_norm = '' OR b.street_norm = '' THEN 0.0 WHEN a.street_norm = b.street_norm THEN 1.0 ELSE 2.0 * least(length(a.street_norm), length(b.street_norm)) / (length(a.street_norm) + length(b.street_norm)) END::DOUBLE AS street_similarity,
    (a.building_norm = b.building_norm)::INT::DOUBLE AS building_match, (a.unit_norm <> '' AND a.unit_norm = b.unit_norm)::INT::DOUBLE AS unit_match,
    (a.postcode_norm <> '' AND a.postcode_norm = b.postcode_norm)::INT::DOUBLE AS postcode_match, (a.family_token_norm <> '' AND a.family_token_norm = b.family_token_norm)::INT::DOUBLE AS family_token_match,
    a.postcode_norm <> '' AND b.postcode_norm <> '' AS postcode_available, a.family_token_norm <> '' AND b.family_token_norm <> '' AS family_token_available,
    (a.exact_address_key <> '' AND a.exact_address_key = b.exact_address_key)::INTEGER AS baseline_match
  FROM cand c JOIN sig a ON a.account_id = account_a JOIN sig b ON b.account_id = account_b),
scored AS MATERIALIZED (SELECT *, (street_similarity * 0.45::DOUBLE + unit_match * 0.35::DOUBLE + postcode_match * 0.15::DOUBLE + family_token_match * 0.05::DOUBLE)
    / (0.45::DOUBLE + 0.35::DOUBLE + postcode_available::INT * 0.15::DOUBLE + family_token_available::INT * 0.05::DOUBLE) AS relation_score FROM feat)"""

_LABELS_SQL = f"""
truth AS MATERIALIZED ({TRUTH}),
noise(level, r) AS (VALUES ('clean', 1), ('moderate', 2), ('heavy', 3)),
pair AS MATERIALIZED (SELECT s.*, a.split, a.building_id, CASE greatest(x.r, y.r) WHEN 1 THEN 'clean' WHEN 2 THEN 'moderate' ELSE 'heavy' END AS pair_noise_level,
    (a.true_group_id = b.true_group_id)::INTEGER AS is_related, (relation_score >= {THRESHOLD}::DOUBLE)::INTEGER AS enhanced_match
  FROM scored s JOIN truth a ON a.account_id = account_a JOIN truth b ON b.account_id = account_b JOIN noise x ON x.level = a.noise_level JOIN noise y ON y.level = b.noise_level WHERE a.split = b.split)"""

_BASE = _signature_sql(SETTINGS.address_history_days) + "," + _pairs_sql(SETTINGS.max_block_size) + "," + _FEATURES_SQL
_LABELLED = _BASE + "," + _LABELS_SQL


def _components_sql(name: str, edges: str) -> str:
    """name(account_id, root) over all of ``node``."""
    return f"""
{name}_both AS MATERIALIZED (SELECT account_a AS a, account_b AS b FROM {edges} UNION SELECT account_b, account_a FROM {edges}),
{name}_reach AS (SELECT account_id AS a, account_id AS b FROM node UNION SELECT r.a, e.b FROM {name}_reach r JOIN {name}_both e ON e.a = r.b),
{name} AS MATERIALIZED (SELECT a AS account_id, min(b) AS root FROM {name}_reach GROUP BY a)"""


def _walk_sql(policies: str, edges: str) -> str:
    """walk: strongest edge first in each component, for each policy (t, shown, cap); final: each node's last label."""
    return f"""
{_components_sql('raw', edges)},
policies(t, shown, cap) AS (VALUES {policies}),
members AS MATERIALIZED (SELECT root, list(account_id ORDER BY account_id) AS labels FROM raw GROUP BY root),
ranked_edges AS MATERIALIZED (SELECT t, shown, cap, root, account_a AS a, account_b AS b, relation_score AS score, row_number() OVER (PARTITION BY shown, cap, root ORDER BY relation_score DESC, account_a, account_b) AS step
  FROM {edges} e JOIN raw ON raw.account_id = e.account_a JOIN policies ON relation_score >= t),
walk AS (SELECT shown, cap, root, 0::BIGINT AS step, labels, labels AS names, ''::VARCHAR AS a, ''::VARCHAR AS b, 0::DOUBLE AS score, 0::BIGINT AS na, 0::BIGINT AS nb, ''::VARCHAR AS decision FROM members, policies
  UNION ALL
  SELECT shown, cap, root, step, CASE WHEN la <> lb AND na + nb <= cap THEN list_transform(labels, lambda x: CASE WHEN x = greatest(la, lb) THEN least(la, lb) ELSE x END) ELSE labels END, names, a, b, score, na, nb,
    CASE WHEN la = lb THEN 'accepted_redundant' WHEN na + nb > cap THEN 'deferred_component_cap' ELSE 'accepted_merge' END
  FROM (SELECT *, len(list_filter(labels, lambda x: x = la))::BIGINT AS na, len(list_filter(labels, lambda x: x = lb))::BIGINT AS nb
    FROM (SELECT w.shown, w.cap, w.root, e.step, w.labels, w.names, e.a, e.b, e.score, w.labels[list_position(w.names, e.a)] AS la, w.labels[list_position(w.names, e.b)] AS lb
      FROM walk w JOIN ranked_edges e ON e.shown = w.shown AND e.cap = w.cap AND e.root = w.root AND e.step = w.step + 1))),
ended AS (SELECT shown, cap, root, max(step) AS step FROM walk GROUP BY ALL),
final AS MATERIALIZED (SELECT shown, cap, unnest(names) AS account_id, unnest(labels) AS label FROM walk JOIN ended USING (shown, cap, root, step))"""


def _numbered_sql(source: str, label: str) -> str:
    return f"SELECT account_id, printf('PRED-%05d', (dense_rank() OVER (ORDER BY {label}))::INTEGER) AS predicted_group_id FROM {source}"


_ONE = f"({THRESHOLD}::DOUBLE, {THRESHOLD}::DOUBLE, {CAP})"
_GRID = ", ".join(f"({t!r}::DOUBLE, {round(t, 10)!r}::DOUBLE, {c})" for t in policy.grid(SETTINGS.threshold_min, SETTINGS.threshold_max, SETTINGS.threshold_step) for c in SETTINGS.component_size_candidates)
_NODES = "node AS (SELECT account_id FROM truth), on_edge AS MATERIALIZED (SELECT * FROM pair WHERE enhanced_match = 1)"
_GUARDED = _LABELLED + "," + _NODES + "," + _walk_sql(_ONE, "on_edge") + f", assigned AS MATERIALIZED ({_numbered_sql('final', 'label')}), marked AS MATERIALIZED (SELECT p.*, (coalesce(w.decision, '') LIKE 'accepted%')::INTEGER AS guardrail_match FROM pair p LEFT JOIN walk w ON w.a = account_a AND w.b = account_b)"
_TEST = _GUARDED + ", test AS MATERIALIZED (SELECT * FROM marked WHERE split = 'test'), long AS (SELECT is_related, pair_noise_level, 'exact_key_baseline' AS model, baseline_match AS p FROM test UNION ALL SELECT is_related, pair_noise_level, 'scored_resolution', enhanced_match FROM test UNION ALL SELECT is_related, pair_noise_level, 'guarded_resolution', guardrail_match FROM test)"


def _confusion_sql(p: str) -> str:
    tp, fp, fn, tn = (f"count(*) FILTER (is_related = {a} AND {p} = {b})" for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    ratio = lambda x, y: f"round(coalesce(({x})::DOUBLE / nullif({y}, 0), 0), 9)"
    return f"{ratio(tp, f'{tp} + {fp}')} AS precision, {ratio(tp, f'{tp} + {fn}')} AS recall, {ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, {tp} AS true_positives, {fp} AS false_positives, {fn} AS false_negatives, {tn} AS true_negatives"


_JUDGED = (
    _LABELLED
    + ", own AS (SELECT * FROM truth WHERE split = 'test'), node AS (SELECT account_id FROM own), on_edge AS MATERIALIZED (SELECT * FROM pair WHERE enhanced_match = 1 AND split = 'test'),"
    + _components_sql("plain", "on_edge")
    + """, cell AS (SELECT root, true_group_id, count(*) AS n FROM plain JOIN own USING (account_id) GROUP BY ALL), grp AS (SELECT root, count(*) AS n FROM plain GROUP BY root), act AS (SELECT true_group_id, count(*) AS n FROM own GROUP BY ALL),
sums AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM cell)::DOUBLE AS tp, (SELECT sum(n * (n - 1) // 2) FROM grp)::DOUBLE AS pp, (SELECT sum(n * (n - 1) // 2) FROM act)::DOUBLE AS ap, (SELECT count(*) FROM own)::DOUBLE AS m)"""
)
_PR = "tp / pp AS p, tp / ap AS r"
_CURVE = _LABELLED + ", own AS (SELECT * FROM truth WHERE split = 'validation'), node AS (SELECT account_id FROM own), on_edge AS MATERIALIZED (SELECT * FROM pair WHERE relation_score >= 0.65::DOUBLE AND split = 'validation')," + _walk_sql(_GRID, "on_edge") + f""",
lab AS MATERIALIZED (SELECT shown, cap, label, true_group_id FROM final JOIN own USING (account_id)),
cell AS (SELECT shown, cap, label, true_group_id, count(*) AS n FROM lab GROUP BY ALL), grp AS (SELECT shown, cap, label, count(*) AS n FROM lab GROUP BY ALL), act AS (SELECT true_group_id, count(*) AS n FROM own GROUP BY ALL),
a1 AS (SELECT shown, cap, sum(n * (n - 1) // 2)::BIGINT AS tp FROM cell GROUP BY ALL), a2 AS (SELECT shown, cap, sum(n * (n - 1) // 2)::BIGINT AS pp FROM grp GROUP BY ALL), a3 AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS ap, sum(n)::DOUBLE AS m FROM act),
a4 AS (SELECT c.shown, c.cap, sum(c.n * c.n / g.n::DOUBLE) AS bp, sum(c.n * c.n / t.n::DOUBLE) AS br FROM cell c JOIN grp g USING (shown, cap, label) JOIN act t USING (true_group_id) GROUP BY ALL),
a5 AS (SELECT shown, cap, count(*) FILTER (decision = 'deferred_component_cap') AS d FROM walk GROUP BY ALL),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(pp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(ap, 0), 0) AS r, bp / m AS xp, br / m AS xr FROM a1 JOIN a2 USING (shown, cap) JOIN a4 USING (shown, cap) JOIN a5 USING (shown, cap), a3),
curve AS MATERIALIZED (SELECT shown AS threshold, cap::INTEGER AS max_component_size, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, pp - tp AS false_merges, ap - tp AS false_splits, xp, xr, 2 * xp * xr / (xp + xr) AS xf, (5 * (pp - tp) + (ap - tp))::DOUBLE AS weighted_error_cost, d AS deferred_edges, p >= {SETTINGS.precision_floor}::DOUBLE AS meets_precision_floor FROM m)"""


def _curve_columns(prefix: str = "component_") -> str:
    return f"threshold, max_component_size, round(p, 9) AS {prefix}precision, round(r, 9) AS {prefix}recall, round(f, 9) AS {prefix}f1, false_merges, false_splits, round(xp, 9) AS bcubed_precision, round(xr, 9) AS bcubed_recall, round(xf, 9) AS bcubed_f1, weighted_error_cost, deferred_edges, meets_precision_floor"


def _ref(column: str) -> str:
    key = SALT.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"concat('REF-', substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || {column}::BLOB))), 1, 20))"


_ANSWERS = _GUARDED + f""", edge AS MATERIALIZED (SELECT {_ref('a')} AS ra, {_ref('b')} AS rb, decision, CASE (substr(a, 5, 10)::BIGINT + 3 * substr(b, 5, 10)::BIGINT) % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'not_match' WHEN 2 THEN 'uncertain' END AS said FROM walk WHERE step > 0)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


ORACLES: dict[str, str] = {
    "observation_summary": f"SELECT count(*) AS orders, count(DISTINCT account_id) AS accounts, strftime(min(order_date), '%Y-%m-%d') AS first_order_date, strftime(max(order_date), '%Y-%m-%d') AS last_order_date FROM ({OBSERVATIONS})",
    "contract_violations": f"""WITH o AS (SELECT *, CAST(substr(order_id, 5, 12) AS BIGINT) AS n FROM ({OBSERVATIONS})),
bad AS (SELECT *, CASE WHEN n % 97 = 1 THEN ' ' WHEN n % 89 = 2 THEN 'twice' ELSE order_id END AS i FROM o)
SELECT count(*) FILTER (i = ' ')::BIGINT AS order_id_blank, count(*) FILTER (n % 83 = 4)::BIGINT AS account_id_blank, (SELECT count(*) FROM (SELECT i FROM bad GROUP BY i HAVING count(*) > 1))::BIGINT AS order_id_repeated,
  count(*) FILTER (n % 101 = 3 OR (trim(city) = '' AND street = '' AND building = '' AND postcode = ''))::BIGINT AS nowhere,
  max(greatest(100 * length(unit), CASE WHEN n % 101 = 3 THEN 0 ELSE greatest(length(city), length(street)) END))::INTEGER AS longest, count(*) FILTER (n % 79 = 5 OR n % 73 = 6)::BIGINT AS undated FROM bad""",
    "crossing_groups": f"SELECT true_group_id FROM ({TRUTH}) GROUP BY 1 HAVING count(DISTINCT substr(account_id, 13, 2)::INT % 2) > 1",
    "document_normalization": rf"WITH t AS (SELECT doc_id, {_norm('replace(text, chr(223), chr(115) || chr(115))')} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS normalized_sha256 FROM t",
    "normalized_addresses": _with(_signature_sql(100_000), f"SELECT order_id, account_id, {', '.join(_FIELDS)}, family_token_norm FROM norm"),
    "account_signatures": _with(_signature_sql(SETTINGS.address_history_days), "SELECT * FROM sig"),
    "snapshot_signatures": _with(_signature_sql(180, SNAPSHOT), "SELECT * FROM sig"),
    "exact_key_groups": _with(_signature_sql(SETTINGS.address_history_days), "SELECT exact_address_key, count(*) AS accounts, min(account_id) AS first_account FROM sig WHERE exact_address_key <> '' GROUP BY 1 HAVING count(*) > 1"),
    "block_audit": _with(_signature_sql(SETTINGS.address_history_days) + "," + _pairs_sql(250), _audit_sql(250)),
    "candidate_pairs": _with(_signature_sql(SETTINGS.address_history_days) + "," + _pairs_sql(250), "SELECT * FROM cand"),
    "oversized_blocks": _with(_signature_sql(SETTINGS.address_history_days) + "," + _pairs_sql(5), _audit_sql(5)),
    "oversized_deferral": _with(_signature_sql(SETTINGS.address_history_days) + "," + _pairs_sql(5), "SELECT * FROM cand"),
    "pair_features": _with(_BASE, "SELECT * REPLACE (round(street_similarity, 9) AS street_similarity, round(relation_score, 9) AS relation_score) FROM scored"),
    "labelled_pairs": _with(_LABELLED, "SELECT account_a, account_b, split, building_id, pair_noise_level, is_related, enhanced_match FROM pair"),
    "true_pairs": f"WITH t AS (SELECT * FROM ({TRUTH}) WHERE split = 'test') SELECT a.account_id AS account_a, b.account_id AS account_b FROM t a JOIN t b USING (true_group_id) WHERE a.account_id < b.account_id",
    "connected_components": _with(_LABELLED + "," + _NODES + "," + _components_sql("plain", "on_edge"), _numbered_sql("plain", "root")),
    "guarded_components": _with(_GUARDED, "SELECT * FROM assigned"),
    "guardrail_audit": _with(_GUARDED, "SELECT a AS account_a, b AS account_b, round(score, 9) AS relation_score, na AS component_a_size_before, nb AS component_b_size_before, CASE WHEN decision = 'accepted_redundant' THEN na ELSE na + nb END AS proposed_component_size, decision AS guardrail_decision, split FROM walk JOIN (SELECT account_a, account_b, split FROM pair) p ON p.account_a = a AND p.account_b = b WHERE step > 0"),
    "group_profiles": _with(_GUARDED, """, tok AS (SELECT predicted_group_id, family_token_norm, count(*) AS n FROM assigned JOIN sig USING (account_id) GROUP BY ALL),
g AS (SELECT predicted_group_id, sum(n)::BIGINT AS members, coalesce(max(n) FILTER (family_token_norm <> '')::DOUBLE / sum(n) FILTER (family_token_norm <> ''), 0) AS share FROM tok GROUP BY 1),
l AS (SELECT x.predicted_group_id, min(relation_score) AS low, avg(relation_score) AS mean FROM marked JOIN assigned x ON x.account_id = account_a JOIN assigned y ON y.account_id = account_b WHERE guardrail_match = 1 AND x.predicted_group_id = y.predicted_group_id GROUP BY 1)
SELECT predicted_group_id, members, CASE WHEN members = 1 THEN 'singleton' WHEN members <= 5 AND share >= 0.6 THEN 'shared_household_signal' WHEN members <= 5 THEN 'shared_residence_signal' ELSE 'shared_location_review' END AS signal_type,
  round(share, 9) AS dominant_family_token_share, round(coalesce(low, 0), 9) AS minimum_link_score, round(coalesce(mean, 0), 9) AS mean_link_score, true AS review_required FROM g LEFT JOIN l USING (predicted_group_id)"""),
    "review_building": _with(_TEST, """, e AS (SELECT building_id, account_a AS x FROM test WHERE guardrail_match = 1 UNION SELECT building_id, account_b FROM test WHERE guardrail_match = 1),
best AS (SELECT building_id, count(*) AS accounts FROM e GROUP BY 1 ORDER BY accounts DESC, building_id LIMIT 1)
SELECT building_id, accounts, account_a, account_b, round(relation_score, 9) AS relation_score FROM test JOIN best USING (building_id) WHERE guardrail_match = 1"""),
    "pair_confusion": _with(_TEST, f"SELECT model, {_confusion_sql('p')} FROM long GROUP BY model"),
    "noise_recall": _with(_TEST, "SELECT pair_noise_level AS noise_level, count(*) AS positive_pairs, round(avg(baseline_match), 9) AS baseline_recall, round(avg(enhanced_match), 9) AS enhanced_recall FROM test WHERE is_related = 1 GROUP BY 1"),
    "subgroup_errors": _with(_TEST, f"SELECT pair_noise_level AS noise_level, model, count(*) AS pairs, {_confusion_sql('p')} FROM long GROUP BY 1, 2"),
    "component_pair_metrics": _with(_JUDGED, f"SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, tp::BIGINT AS true_positives, (pp - tp)::BIGINT AS false_merges, (ap - tp)::BIGINT AS false_splits FROM (SELECT *, {_PR} FROM sums)"),
    "bcubed": _with(_JUDGED, "SELECT round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM (SELECT sum(c.n * c.n / g.n::DOUBLE) / sum(c.n) AS p, sum(c.n * c.n / t.n::DOUBLE) / sum(c.n) AS r FROM cell c JOIN grp g USING (root) JOIN act t USING (true_group_id))"),
    "adjusted_rand": _with(_JUDGED, "SELECT round((tp - pp * ap / (m * (m - 1) / 2)) / ((pp + ap) / 2 - pp * ap / (m * (m - 1) / 2)), 9) AS ari FROM sums"),
    "candidate_recall": _with(_LABELLED, ", t AS (SELECT * FROM truth WHERE split = 'test'), e AS (SELECT a.account_id AS account_a, b.account_id AS account_b FROM t a JOIN t b USING (true_group_id) WHERE a.account_id < b.account_id) SELECT 'test' AS split, count(*) AS expected_pairs, round(count(p.split) / count(*)::DOUBLE, 9) AS candidate_recall FROM e LEFT JOIN pair p USING (account_a, account_b)"),
    "threshold_curve": _with(_LABELLED + f", policies(t, shown, cap) AS (VALUES {_GRID})", f"SELECT shown AS threshold, {_confusion_sql('(relation_score >= t)::INT')} FROM pair, (SELECT DISTINCT t, shown FROM policies) WHERE split = 'validation' GROUP BY shown"),
    "policy_curve": _with(_CURVE, f"SELECT {_curve_columns()} FROM curve"),
    "selected_policy": _with(_CURVE, f"SELECT {_curve_columns()} FROM curve WHERE meets_precision_floor ORDER BY weighted_error_cost, f DESC, threshold DESC, max_component_size LIMIT 1"),
    "best_by_threshold": _with(_CURVE, f"SELECT {_curve_columns('')} FROM (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY weighted_error_cost, f DESC, max_component_size) AS rn FROM curve) WHERE rn = 1"),
    "pseudonymized_refs": f"SELECT account_id, {_ref('account_id')} AS account_ref FROM ({TRUTH})",
    "feedback_summary": _with(_ANSWERS, """, s AS (SELECT unnest(['overall', CASE WHEN decision LIKE 'accepted%' THEN 'accepted_edges' ELSE 'deferred_edges' END, concat('decision:', decision)]) AS scope, said FROM edge),
c AS (SELECT scope, count(*) AS t, count(said) AS r, count(*) FILTER (said IN ('match', 'not_match')) AS d, count(*) FILTER (said = 'match') AS m, count(*) FILTER (said = 'not_match') AS x, count(*) FILTER (said = 'uncertain') AS u FROM s GROUP BY 1)
SELECT scope, t AS total_edges, r AS reviewed_edges, d AS decisive_edges, m AS confirmed_matches, x AS confirmed_non_matches, u AS uncertain_edges, round(r / t::DOUBLE, 9) AS review_coverage, round(d::DOUBLE / nullif(r, 0), 9) AS decisive_share_of_reviewed,
  round(m::DOUBLE / nullif(d, 0), 9) AS match_rate_among_decisive, round(x::DOUBLE / nullif(d, 0), 9) AS non_match_rate_among_decisive FROM c"""),
    "feedback_unknown_pairs": _with(_ANSWERS, "SELECT least(ra, rb) AS pair_left, greatest(ra, rb) AS pair_right, said AS review_outcome FROM edge WHERE said IS NOT NULL AND decision <> 'deferred_component_cap'"),
    "feedback_violations": _with(_ANSWERS, """, x AS (SELECT rb AS a, ra AS b, said, substr(rb, 5, 1) AS h FROM edge WHERE said IS NOT NULL),
bad AS (SELECT CASE h WHEN '0' THEN 'REF-XYZ' WHEN '1' THEN '' ELSE a END AS a, CASE h WHEN '2' THEN a ELSE b END AS b, CASE h WHEN '3' THEN 'maybe' WHEN '4' THEN NULL ELSE said END AS said FROM x UNION ALL SELECT b, a, said FROM x WHERE h = '5')
SELECT count(*) AS "rows", count(*) FILTER (a = '') AS a_blank, count(*) FILTER (b = '') AS b_blank, count(*) FILTER (NOT regexp_full_match(a, 'REF-[0-9a-f]{20}')) AS a_form, count(*) FILTER (NOT regexp_full_match(b, 'REF-[0-9a-f]{20}')) AS b_form,
  count(*) FILTER (a = b) AS self, count(*) FILTER (said IS NULL) AS empty, count(*) FILTER (said = 'maybe') AS others, (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY least(a, b), greatest(a, b) HAVING count(*) > 1)) AS repeated FROM bad"""),
    "truth_violations": f"""WITH t AS (SELECT *, CAST(substr(account_id, 5, 10) AS BIGINT) AS n FROM ({TRUTH})),
bad AS (SELECT CASE WHEN n % 31 = 1 THEN ' ' WHEN n % 29 = 2 THEN 'twice' ELSE account_id END AS a, CASE WHEN n % 23 <> 3 THEN true_group_id END AS g, CASE WHEN n % 19 = 4 THEN '' ELSE CAST(building_id AS VARCHAR) END AS b,
  CASE WHEN n % 17 = 5 THEN 'holdout' WHEN n % 13 <> 6 THEN split END AS s, CASE WHEN n % 11 = 7 THEN 'extreme' WHEN n % 7 <> 3 THEN noise_level END AS z FROM t)
SELECT count(*) AS "rows", count(*) FILTER (a = ' ') AS account_id_blank, count(*) FILTER (g IS NULL) AS true_group_id_blank, count(*) FILTER (b = '') AS building_id_blank, count(*) FILTER (s IS NULL) AS split_blank,
  count(DISTINCT a) AS accounts, count(DISTINCT g) AS groups, count(DISTINCT b) AS buildings, (count(DISTINCT s) FILTER (s <> 'holdout'))::INTEGER AS splits, count(*) FILTER (s = 'holdout') AS other_split, count(*) FILTER (z IS NULL OR z = 'extreme') AS other_noise FROM bad""",
    "unmatched_accounts": f"""WITH o AS (SELECT DISTINCT account_id FROM ({OBSERVATIONS}) WHERE substr(account_id, 5, 10)::BIGINT % 5 <> 0), t AS (SELECT account_id FROM ({TRUTH}) WHERE substr(account_id, 5, 10)::BIGINT % 7 <> 0)
SELECT account_id, 'orders' AS found_in FROM o WHERE account_id NOT IN (SELECT account_id FROM t) UNION ALL SELECT account_id, 'truth' FROM t WHERE account_id NOT IN (SELECT account_id FROM o)""",
    "character_folding": "SELECT n_nationkey, concat_ws(' ', translate('" + _LETTERS + "', 'يىكةۀؤإأٱ', 'ییکههوااا'), replace(lower(n_name), '_', ' '), '45', CAST(n_nationkey AS VARCHAR)) AS folded FROM nation",
    "largest_groups": _with(_GUARDED, "SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM raw GROUP BY root)) AS before_cap, (SELECT max(n) FROM (SELECT count(*) AS n FROM assigned GROUP BY predicted_group_id)) AS after_cap"),
    "selected_threshold": _with(_LABELLED + f", policies(t, shown, cap) AS (VALUES {_GRID}), c AS MATERIALIZED (SELECT shown AS threshold, {_confusion_sql('(relation_score >= t)::INT')} FROM pair, (SELECT DISTINCT t, shown FROM policies) WHERE split = 'validation' GROUP BY shown), f AS (SELECT max(f1) AS m FROM c), tied AS (SELECT c.* FROM c, f WHERE abs(f1 - m) <= 1e-8 + 1e-5 * m), p AS (SELECT max(precision) AS m FROM tied)", "SELECT max(threshold) AS threshold FROM tied, p WHERE abs(precision - m) <= 1e-8 + 1e-5 * m"),
    "marked_policy": _with(f"policies(t, shown, cap) AS (VALUES {_GRID})", f"SELECT shown AS threshold, cap::INTEGER AS max_component_size, round(shown, 4) = {THRESHOLD} AND cap = {CAP} AS selected FROM policies"),
    "measure_spread": _with(_CURVE + ", v AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in STABLE) + "]) AS metric, unnest([p, r, f, xp, xr, xf, weighted_error_cost]) AS v FROM curve)", "SELECT metric, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, round(min(v), 9) AS min, round(max(v), 9) AS max FROM v GROUP BY metric"),
}
