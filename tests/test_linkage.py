import json

import pytest
from pyspark.sql import functions as F

from kinweave.functions.text import fold, normalize_text, number_field, postcode
from kinweave.operators import policy, quality
from kinweave.operators.blocking import block_audit, candidate_pairs
from kinweave.operators.contracts import InputError
from kinweave.operators.features import WEIGHTS, pair_features, with_labels
from kinweave.operators.graph import GraphError, check_edges, component_assignments, connected, group_profiles, guarded_assignments, merge_under_cap
from kinweave.operators.privacy import account_reference
from kinweave.operators.signatures import signatures
from kinweave.operators.validation import ContractError, validate_observations, validate_truth
from kinweave.plans.analysis import analyze, prepare
from kinweave.plans.audit import audit_feedback
from kinweave.plans.benchmark import reproduce, stability_summary, summary
from kinweave.operators.feedback import FeedbackError
from kinweave.sources.config import Settings, load_settings
from kinweave.sources.synthetic import generate, rows, spread
from kinweave.streaming.normalize import normalize_stream, observation_stream

ORDER = "order_id string, account_id string, city string, street string, building string, unit string, postcode string, family_token string, order_date string"
SIGNED = "account_id string, city_norm string, street_norm string, building_norm string, unit_norm string, postcode_norm string, family_token_norm string, exact_address_key string"


@pytest.fixture(scope="module")
def benchmark(spark):
    orders, truth = generate(spark, seed=42, buildings=180)
    ready = prepare(orders, Settings())
    return orders, truth, ready, with_labels(ready.pairs, truth).cache()


def test_normalization(spark):
    values = [" Cedar St. 7 ", "تهران، خیابان ولیعصر", "خيابان كاشاني", "Apt ۰۳", "Bldg-۱۲", "ساختمان ۱۲ طبقه ۳", None, "", "Straße ①", "no 5 and 6", "apt 007", "CAFÉ"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", normalize_text("v").alias("n"))
    rows_ = got.select("n", number_field(F.col("n")).alias("any"), number_field(F.col("n"), "building").alias("b"), number_field(F.col("n"), "unit").alias("u"), postcode(F.col("n")).alias("p")).collect()
    text = [r["n"] for r in rows_]
    assert text[:3] == ["cedar street 7", "تهران خیابان ولیعصر", "خیابان کاشانی"]
    assert rows_[3]["u"] == "3" and rows_[4]["b"] == "12" and rows_[5]["b"] == "12" and rows_[5]["any"] == ""
    assert text[6] == text[7] == "" and text[8] == "strasse 1" and rows_[9]["any"] == "" and rows_[10]["u"] == "7" and text[11] == "café" and rows_[0]["p"] == "cedarstreet7"
    with pytest.raises(ValueError, match="Unsupported number field"):
        number_field(F.col("n"), "floor")
    assert fold(None) is None


def test_signature_takes_one_real_tuple(spark):
    data = [("O1", "A1", "Tehran", "Valiasr St.", "Building 12", "Unit 3", "111", "F1", "2025-01-01"), ("O2", "A1", "Tehran", "Zand St.", "Building 9", "Unit 2", "222", "F1", "2025-02-01"), ("O3", "A1", "Shiraz", "Valiasr St.", "Building 9", "Unit 2", "222", "F1", "2025-03-01")]
    orders = spark.createDataFrame(data, ORDER)
    now, then = signatures(orders).first(), signatures(orders, "2025-01-15").first()
    assert (now["city_norm"], now["street_norm"], now["building_norm"]) == ("shiraz", "valiasr street", "9")
    assert then["building_norm"] == "12" and now["address_history_count"] == 3 and now["observed_orders"] == 3
    assert signatures(orders, history_days=10).first()["observed_orders"] == 1
    with pytest.raises(ValueError):
        signatures(orders, history_days=0)


def test_blocking_and_deferral(spark):
    row = lambda a, b, p: (a, "c", "s", b, "1", p, "", "")
    near = spark.createDataFrame([row("A", "12", ""), row("B", "13", "")], SIGNED)
    assert [tuple(r) for r in candidate_pairs(near).collect()] == [("A", "B", "city_street", 1)]
    shared = spark.createDataFrame([(a, "", "", "", "", "shared", "", "") for a in "ABC"], SIGNED)
    audit = block_audit(shared, 2).first()
    assert candidate_pairs(shared, 2).isEmpty() and audit["block_decision"] == "deferred_oversized" and "shared" not in str(audit.asDict().values())
    with pytest.raises(ValueError):
        block_audit(shared, 1)


def test_similarity_is_of_the_ordered_pair(spark):
    signed = spark.createDataFrame([("1", "c", "tide", "1", "", "", "", ""), ("2", "c", "diet", "1", "", "", "", ""), ("3", "c", "", "1", "", "", "", "")], SIGNED)
    got = {(r["account_a"], r["account_b"]): r for r in pair_features(candidate_pairs(signed), signed).collect()}
    assert got["1", "2"]["street_similarity"] == 0.25 and got["1", "3"]["street_similarity"] == 0.0
    assert got["1", "2"]["city_match"] == 1.0 and got["1", "2"]["relation_score"] == pytest.approx(0.25 * 0.45 / 0.8)
    assert not {"city_match", "building_match"} & set(WEIGHTS)


CHAIN = [("A", "B", 0.99, 1), ("B", "C", 0.98, 1), ("C", "D", 0.97, 1), ("D", "E", 0.96, 1), ("E", "F", 0.95, 1)]
PAIR = "account_a string, account_b string, relation_score double, enhanced_match int"


def test_guarded_chain(spark):
    accounts = spark.createDataFrame([(a,) for a in "ABCDEFG"], "account_id string")
    pairs = spark.createDataFrame(CHAIN, PAIR)
    assigned, audit = guarded_assignments(accounts, pairs, "enhanced_match", "relation_score", 3)
    told = {(r["account_a"], r["account_b"]): r for r in audit.collect()}
    assert [told[a, b]["guardrail_decision"] for a, b, *_ in CHAIN] == ["accepted_merge", "accepted_merge", "deferred_component_cap", "accepted_merge", "accepted_merge"]
    assert told["C", "D"]["proposed_component_size"] == 4
    groups = {r["account_id"]: r["predicted_group_id"] for r in assigned.collect()}
    assert groups == dict.fromkeys("ABC", "PRED-00001") | dict.fromkeys("DEF", "PRED-00002") | {"G": "PRED-00003"}
    plain = {r["account_id"]: r["predicted_group_id"] for r in component_assignments(accounts, pairs, "enhanced_match").collect()}
    assert plain == dict.fromkeys("ABCDEF", "PRED-00001") | {"G": "PRED-00002"}
    none = component_assignments(accounts, pairs.withColumn("enhanced_match", F.lit(0)), "enhanced_match")
    assert none.select("predicted_group_id").distinct().count() == 7
    assert merge_under_cap([("a", "b", 0.5), ("b", "a", 0.4)], 2)[1][1][-1] == "accepted_redundant"


@pytest.mark.parametrize(("pair", "message"), [(("A", "B", 1.2, 1), "scores"), (("A", "A", 0.5, 1), "Self-pairs"), (("A", "Z", 0.5, 1), "outside"), (("A", "B", 0.5, 2), "zero or one")])
def test_bad_edges(spark, pair, message):
    accounts = spark.createDataFrame([("A",), ("B",)], "account_id string")
    with pytest.raises(GraphError, match=message):
        check_edges(accounts, spark.createDataFrame([pair], PAIR), "enhanced_match", "relation_score")


def test_profile_without_tokens(spark):
    assigned = spark.createDataFrame([("A", "PRED-00001"), ("B", "PRED-00001")], "account_id string, predicted_group_id string")
    signed = spark.createDataFrame([("A", "", "", "", "", "", "", ""), ("B", "", "", "", "", "", "", "")], SIGNED)
    row = group_profiles(assigned, signed, spark.createDataFrame([("A", "B", 0.9, 1)], PAIR)).first()
    assert row["signal_type"] == "shared_residence_signal" and row["dominant_family_token_share"] == 0.0 and row["review_required"]


def test_contracts(spark):
    base = ("O1", "A1", "c", "s", "1", "1", "p", "f", "2025-01-01")
    frame = lambda *rows_: spark.createDataFrame(list(rows_), ORDER)
    seen = validate_observations(frame(base, ("O2", *base[1:-1], "01/03/2025")))
    assert (seen.orders, seen.accounts, seen.last_order_date, seen.checks_passed) == (2, 1, "2025-01-03", 10)
    for bad, message in [((base, base), "order_id must be unique"), ((("O1", " ", *base[2:]),), "account_id must not"), (((*base[:-1], "soon"),), "valid"), ((("O1", "A1", None, " ", "", "1", None, "f", "2025-01-01"),), "no city"), ((("O1", "A1", "x" * 513, *base[3:]),), "512"), ((), "no orders")]:
        with pytest.raises(ContractError, match=message):
            validate_observations(frame(*bad))
    with pytest.raises(ContractError, match="must not appear"):
        validate_observations(frame(base).withColumn("split", F.lit("test")))
    with pytest.raises(ContractError, match="lack the columns"):
        validate_observations(frame(base).drop("city"))
    orders, truth = generate(spark, seed=1, buildings=30)
    assert validate_truth(orders, truth).checks_passed == 18
    crossed = truth.withColumn("split", F.when(F.col("account_id") == "ACC-000001", F.lit("test")).when(F.col("building_id") == 1, F.lit("train")).otherwise(F.col("split")))
    with pytest.raises(ContractError, match="several splits"):
        validate_truth(orders, crossed)
    with pytest.raises(ContractError, match="same accounts"):
        validate_truth(orders.filter("account_id <> 'ACC-000001'"), truth)


def test_published_blocking_and_policy(benchmark):
    _, truth, ready, pairs = benchmark
    assert len(rows()[0]) == 5119 and truth.count() == 1469
    assert ready.pairs.count() == 5805 and ready.audit.count() == 574
    curve = policy.policy_curve(pairs.filter("split = 'validation'"), truth.filter("split = 'validation'"), Settings()).cache()
    assert curve.count() == 155 and policy.select_policy(curve) == (0.82, 6)
    best = policy.best_policy(curve).first()
    assert best["weighted_error_cost"] == 74.0 and best["component_precision"] == pytest.approx(0.9781659388646288, abs=1e-12) and best["component_recall"] == pytest.approx(0.8205128205128205, abs=1e-12)
    assert policy.best_by_threshold(curve).count() == 31 and policy.mark_selected(curve, 0.82, 6).filter("selected").count() == 1
    with pytest.raises(policy.PolicyError):
        policy.select_policy(curve.withColumn("meets_precision_floor", F.lit(False)))
    assert 0.65 <= policy.select_threshold(policy.threshold_curve(pairs.filter("split = 'validation'"), 0.65, 0.95, 0.01)) <= 0.95


def test_published_test_split(benchmark):
    _, truth, _, pairs = benchmark
    own = truth.filter("split = 'test'")
    test = quality.with_threshold(pairs.filter("split = 'test'"), 0.82)
    told = {r["model"]: r for r in quality.pair_confusion(test).collect()}
    assert (told["scored_resolution"]["true_positives"], told["scored_resolution"]["false_positives"], told["exact_key_baseline"]["f1"]) == (262, 33, 0.7931034482758621)
    assigned, audit = guarded_assignments(own.select("account_id"), test, "enhanced_match", "relation_score", 6)
    found = quality.component_pair_metrics(assigned, own).first()
    assert (found["false_merges"], found["false_splits"]) == (29, 57) and audit.filter("guardrail_decision = 'deferred_component_cap'").count() == 11
    assert quality.bcubed(assigned, own).first()["f1"] == pytest.approx(0.927086532800942, abs=1e-12)
    assert quality.adjusted_rand(assigned, own).first()["ari"] == pytest.approx(0.8562529598644958, abs=1e-12)
    assert quality.candidate_recall(pairs, truth, "test").first()["candidate_recall"] == 1.0
    heavy = [r for r in quality.recall_by_noise(test).collect() if r["noise_level"] == "heavy"][0]
    assert heavy["positive_pairs"] == 108 and heavy["enhanced_recall"] == pytest.approx(0.5092592592592593, abs=1e-12)


def test_reproduce_writes_reports(spark, tmp_path):
    told = reproduce(spark, str(tmp_path), Settings(buildings=30, component_size_candidates=(4, 6), max_component_size=8, stability_seeds=()))
    assert told["policy_stability"] == {"seeds": 0} and told["component_guardrail"]["largest_all_component_after"] <= told["component_guardrail"]["max_component_size"]
    assert {"metrics.json", "run_summary.md", "noise_recall.csv", "subgroup_errors.csv", "component_policy_curve.csv"} <= {p.name for p in (tmp_path / "reports").iterdir()}
    assert "cap" in summary(told)


def test_stability_summary(spark):
    from kinweave.plans.benchmark import STABLE

    rows_ = spark.createDataFrame([tuple([v] * len(STABLE)) for v in (0.5, 1.0)], ", ".join(f"{m} double" for m in STABLE))
    row = stability_summary(rows_).first()
    assert (row["mean"], row["std"], row["min"], row["max"]) == (0.75, 0.25, 0.5, 1.0)


def test_analysis_keeps_ids_private(spark, tmp_path):
    orders, _ = generate(spark, seed=3, buildings=30)
    told = analyze(orders, str(tmp_path), identifier_salt="0123456789abcdef")
    text = "".join(p.read_text() for p in tmp_path.rglob("*") if p.suffix in (".csv", ".json") and p.is_file())
    assert "ACC-" not in text and "city" not in text.lower().replace("city_building", "").replace("city_street", "") and "REF-" in text
    assert told["review"]["predicted_groups"] > 0
    with pytest.raises(ValueError, match="16 characters"):
        analyze(orders, str(tmp_path), identifier_salt="short")


def test_reference_is_hmac(spark):
    import hashlib
    import hmac

    for salt in ("0123456789abcdef", "x" * 100):
        want = "REF-" + hmac.new(salt.encode(), b"ACC-1", hashlib.sha256).hexdigest()[:20]
        assert spark.createDataFrame([("ACC-1",)], "a string").select(account_reference("a", salt).alias("r")).first()["r"] == want


REFS = ["REF-" + f"{i:020x}" for i in range(1, 6)]


def test_feedback(spark):
    edges = spark.createDataFrame([(REFS[0], REFS[1], "accepted_merge"), (REFS[1], REFS[2], "accepted_redundant"), (REFS[2], REFS[3], "deferred_component_cap")], "account_ref_a string, account_ref_b string, guardrail_decision string")
    schema = "account_ref_a string, account_ref_b string, review_outcome string"
    told = audit_feedback(edges, spark.createDataFrame([(REFS[1], REFS[0], "match"), (REFS[1], REFS[2], " NOT_match"), (REFS[2], REFS[3], "uncertain")], schema))
    assert told["overall"]["review_coverage"] == 1.0 and told["accepted_edges"]["observed_precision"] == 0.5 and told["accepted_edges"]["observed_false_merge_rate"] == 0.5
    assert told["deferred_edges"]["decisive_edges"] == 0 and told["deferred_edges"]["observed_match_rate"] is None and "REF-" not in json.dumps(told)
    for bad, message in [([(REFS[0], REFS[4], "match")], "not present"), ([(REFS[0], REFS[1], "match"), (REFS[1], REFS[0], "match")], "only once"), ([("A1", REFS[1], "match")], "REF-<20 hex>"), ([(REFS[0], REFS[0], "match")], "Self-pairs"), ([(REFS[0], REFS[1], "maybe")], "Unsupported review"), ([(None, REFS[1], "match")], "blank"), ([], "empty")]:
        with pytest.raises(FeedbackError, match=message):
            audit_feedback(edges, spark.createDataFrame(bad, schema))


def test_inputs_that_would_multiply_pairs_are_refused(spark):
    orders, truth = generate(spark, seed=1, buildings=30)
    signed = signatures(orders).cache()
    twice, pairs = signed.union(signed.limit(1)), candidate_pairs(signed)
    for call in (lambda: candidate_pairs(twice), lambda: pair_features(pairs, twice), lambda: pair_features(pairs.union(pairs.limit(1)), signed), lambda: candidate_pairs(signed.drop("city_norm")), lambda: pair_features(pairs, signed.drop("unit_norm")), lambda: with_labels(pair_features(pairs, signed), truth.union(truth.limit(1)))):
        with pytest.raises(InputError):
            call()
    groups = truth.select("account_id", F.lit("PRED-00001").alias("predicted_group_id"))
    with pytest.raises(InputError):
        quality.bcubed(groups.union(groups.limit(1)), truth)


def test_few_edges_are_joined_at_once(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("x", "y"), ("z", "y")], "a string, b string")
    rooted = [sorted(map(tuple, connected(edges, one_task=n).collect())) for n in (0, 1000)]
    assert rooted[0] == rooted[1] and dict(rooted[0])["z"] == "x" and dict(rooted[0])["n30"] == "n00"


def test_audit_carries_the_split(spark):
    pairs = spark.createDataFrame([("A", "B", 0.9, 1, "test"), ("B", "C", 0.8, 1, "test")], PAIR + ", split string")
    _, audit = guarded_assignments(spark.createDataFrame([("A",), ("B",), ("C",)], "account_id string"), pairs, "enhanced_match", "relation_score", 2)
    assert sorted((r["guardrail_decision"], r["split"]) for r in audit.collect()) == [("accepted_merge", "test"), ("deferred_component_cap", "test")]


def test_settings(tmp_path):
    assert load_settings() == Settings()
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"buildings": 30, "component_size_candidates": [4, 5]}))
    assert load_settings(path).component_size_candidates == (4, 5)
    for change in ({"buildings": 3}, {"threshold_min": 0.99}, {"component_size_candidates": (4, 20)}, {"stability_seeds": (1, 1)}, {"policy_version": " "}, {"precision_floor": 0.0}):
        with pytest.raises(ValueError):
            Settings(**change)
    path.write_text('{"nothing": 1}')
    with pytest.raises(TypeError):
        load_settings(path)


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from kinweave import app

    orders, _ = generate(spark, seed=5, buildings=30)
    source = tmp_path / "orders.csv"
    orders.withColumn("order_date", F.col("order_date").cast("string")).toPandas().to_csv(source, index=False)
    monkeypatch.delenv("KINWEAVE_IDENTIFIER_SALT", raising=False)
    with pytest.raises(SystemExit):
        app.main(["analyze", "--input", str(source), "--output-root", str(tmp_path)])
    monkeypatch.setenv("KINWEAVE_IDENTIFIER_SALT", "0123456789abcdef")
    told = app.main(["analyze", "--input", str(source), "--output-root", str(tmp_path), "--snapshot-date", "2025-12-01"])
    assert told["observations"]["orders"] == orders.count() and "artifact_fingerprint" in capsys.readouterr().out


def test_stream_equals_batch(spark, tmp_path):
    from kinweave.operators.signatures import normalized_addresses

    orders, _ = generate(spark, seed=5, buildings=30)
    orders.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")).write.option("header", True).csv(str(tmp_path / "in"))
    normalize_stream(observation_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("observed_at")
    want = normalized_addresses(orders).drop("observed_at")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_spread_makes_what_it_says(spark):
    assert spread(spark, 100).select("account_id").distinct().count() == 100
    assert validate_observations(spread(spark, 40)).orders == 120


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
