import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import forest, metrics, model as ml
from attestra.plans.jobs import benchmark_report
from attestra.plans.scoring import score_attempts
from attestra.policy import Policy
from attestra.schema import FEATURES
from attestra.session import durable
from replay import random_rows, to_frame


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(120):
        fraud = rng.random() < 0.4
        f = dict.fromkeys(FEATURES, 0.0)
        f["velocity_ip_count"] = rng.randrange(8, 15) if fraud else rng.randrange(3)
        f["credential_failed"] = float(fraud)
        rows.append((str(f).replace("'", '"'), "CREDENTIAL_STUFFING" if fraud else "LEGITIMATE"))
    rows += [("{broken", "LEGITIMATE"), ("{}", "LEGITIMATE"), (None, "LEGITIMATE"), ('{"ela_score": 1}', "UNKNOWN")]
    stored = spark.createDataFrame(rows, "features string, scenario string")
    from attestra.sources.readers import read_training_rows
    matrix = durable(ml.training_matrix(read_training_rows(stored)))
    return matrix, ml.train_model(matrix, trees=10)


def test_training(spark, trained, tmp_path):
    matrix, forest = trained
    assert matrix.count() == 120
    assert ml.model_labels(forest) == ["CREDENTIAL_STUFFING", "LEGITIMATE"]
    p = durable(ml.predicted_label(ml.fraud_probability(matrix, forest), forest))
    assert p.filter("ml_probability < 0 OR ml_probability > 1").isEmpty()
    parts = metrics.evaluate_model(p, spark.createDataFrame(
        [("LEGITIMATE", "BLOCK", 1), ("LEGITIMATE", "ALLOW", 3), ("X", "STEP_UP", 2)],
        "scenario string, decision string, count long"), ml.model_labels(forest))
    s = parts["summary"].first()
    assert s["n_test"] == 120 and s["accuracy"] > 0.95 and s["fraud_vs_legitimate_auc"] > 0.95
    assert parts["engine"].first().asDict() == dict(legitimate_block_rate=0.25, legitimate_step_up_rate=0.0, attack_detection_rate=1.0)
    w = {r["feature"]: r["importance"] for r in ml.feature_importances(spark, forest).collect()}
    assert len(w) == 15 and abs(sum(w.values()) - 1) < 1e-6
    top = matrix.filter("velocity_ip_count > 0").select(ml.contributors(forest).alias("c")).first()["c"]
    assert top and top[0]["name"] in ("velocity_ip_count", "credential_failed")
    ml.save_model(forest, str(tmp_path / "m"))
    again = ml.fraud_probability(matrix, ml.load_model(str(tmp_path / "m")))
    assert again.exceptAll(ml.fraud_probability(matrix, forest)).isEmpty()
    assert ml.load_model(str(tmp_path / "missing")) is None
    with pytest.raises(ValueError):
        ml.train_model(matrix.limit(10))


def test_scoring_with_a_model_blends_and_keeps_floors(spark, trained):
    df = durable(to_frame(spark, random_rows(random.Random(4), 60, span=200)))
    s = score_attempts(df, model=trained[1]).collect()
    policy = Policy()
    for r in s:
        floor = max([0] + [policy.floors[x["rule"]] for x in r["reasons"] if x["rule"] in policy.floors])
        want = max(0.7 * r["rule_points"] + 0.3 * r["ml_probability"] * 100, floor)
        assert r["risk_score"] == max(0, min(100, round(want)))
        assert r["reasons"][-1]["rule"] == "MODEL_RISK" and r["reasons"][-1]["layer"] == "MODEL"
        assert r["rule_points"] == sum(x["points"] for x in r["reasons"])


def test_forest_as_data_gives_the_same_probabilities(spark, trained):
    matrix, model = trained
    plain = forest.exported(model)
    both = ml.fraud_probability(ml.fraud_probability(matrix, model, "a"), plain, "b")
    assert both.filter("abs(a - b) > 1e-9").isEmpty() and both.select("b").distinct().count() > 1
    stored = forest.to_table(spark, plain)
    assert stored.filter("node = 0").count() == 10
    assert forest.from_table(stored, plain.labels, plain.importances) == plain
    same = matrix.select(ml.contributors(model).alias("a"), ml.contributors(plain).alias("b"))
    assert same.filter("a <> b").isEmpty()
    other = forest.Forest(("A", "B"), (("ela_score", 1.0, (0.9, 0.1), (0.2, 0.8)), (0.5, 0.5)))
    assert [r[0] for r in spark.createDataFrame([(0.5,), (2.0,), (None,)], "ela_score double").select(
        F.round(forest.fraud_share(other), 6)).collect()] == [0.7, 0.65, 0.7]


def test_flags_that_lower_scores_reach_the_fixpoint(spark):
    """Rows one at a time, with a forest in which a flagged address lowers the probability."""
    rows = random_rows(random.Random(21), 90, span=400)
    odd = forest.Forest(("FRAUD", "LEGITIMATE"), (("ip_flagged", 0.5, (1.0, 0.0), (0.0, 1.0)), ("cluster_has_blocked", 0.5, (0.75, 0.25), (0.0, 1.0))))
    policy = Policy(block_score=45)
    got = sorted(score_attempts(to_frame(spark, rows), policy, model=odd).collect(), key=lambda r: r["seq"])
    bad_ip, lowered = set(), 0
    for r in got:                       # each row's flags follow from the decisions before it
        assert bool(r["features"]["ip_flagged"]) == (r["ip_address"] in bad_ip)
        p = 0.5 * ((not r["features"]["ip_flagged"]) + 0.75 * (not r["features"]["cluster_has_blocked"]))
        assert abs(r["ml_probability"] - p) < 1e-9
        lowered += p < 0.8
        floor = max([0] + [policy.floors[x["rule"]] for x in r["reasons"] if x["rule"] in policy.floors])
        assert r["risk_score"] == max(0, min(100, round(max(0.7 * r["rule_points"] + 30 * p, floor))))
        if r["decision"] == "BLOCK" and r["ip_address"]:
            bad_ip.add(r["ip_address"])
    assert lowered and bad_ip


def test_disjoint_documents(spark):
    a = spark.createDataFrame([("x",), (None,)], "document_hash string")
    b = spark.createDataFrame([("y",), (None,)], "document_hash string")
    ml.assert_disjoint(a, b)
    with pytest.raises(ValueError):
        ml.assert_disjoint(a, a)


def test_benchmark_report(spark, trained):
    df = to_frame(spark, random_rows(random.Random(6), 30)).withColumn(
        "label_is_fraud", F.col("record_id") % 2 == 0).withColumn("label_category", F.lit("X")).withColumn(
        "campaign_id", F.when(F.col("record_id") % 2 == 0, F.lit("K")))
    rep = benchmark_report({"small": df}, {"rules_only": None})
    r = rep.first()
    assert (r["dataset"], r["config"], r["record_counts"]["records"]) == ("small", "rules_only", 30)
    assert r["campaign_metrics"]["campaigns_total"] == 1
