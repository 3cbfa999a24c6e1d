"""Scenario goldens, all scored in one run: names, addresses and times of the scenarios are disjoint."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import metrics, reports
from attestra.operators.rules import Rule
from attestra.plans import jobs
from attestra.plans.scoring import score_attempts
from attestra.session import durable
from attestra.sources import writers

BASE = 1_780_000_000


def attempt(who, sec, **kw):
    row = dict(claimed_user_ref=who, sec=None if sec is None else BASE + sec, ip_address=None, device_id=None,
               phone=None, address=None, email=None, full_name=None, date_of_birth=None, document_name=None,
               document_hash=None, ela_score=None, metadata_flags=None, liveness_status=None,
               login_status="NOT_SUBMITTED", scenario="UNKNOWN", label_is_fraud=None, error=None)
    row.update(kw)
    return row


def frame(spark, rows):
    schema = ("record_id long, claimed_user_ref string, sec long, ip_address string, device_id string, phone string,"
              " address string, email string, full_name string, date_of_birth string, document_name string,"
              " document_hash string, ela_score double, metadata_flags array<string>, liveness_status string,"
              " login_status string, scenario string, label_is_fraud boolean, error string")
    names = [p.split()[0] for p in schema.split(", ")]
    data = [tuple([i] + [r[n] for n in names[1:]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("sec")) \
                .withColumn("attempt_ref", F.format_string("ATT-%05d", F.col("record_id") + 1001))


def scenarios():
    rows = []
    rows += [attempt(f"LEGIT-{i}", 600 * i, ip_address=f"lip{i}", device_id=f"L{i}", login_status="PASS",
                     address="6 Oasis Rd UAE", phone=f"+9715{i}") for i in range(1)]
    rows += [attempt(f"STUFF-{i}", 3600 + 4 * i, ip_address="sip", device_id="BOT",
                     login_status="PASS" if i == 5 else "FAIL") for i in range(6)]
    rows += [attempt(f"SYN-{i}", 7200 + 60 * i, ip_address=f"yip{i}", device_id="SYN", phone="+97155", login_status="PASS")
             for i in range(4)]
    rows += [attempt("DOCF", 10_000, document_hash=None, ela_score=26.0)]
    rows += [attempt(f"VICTIM-{i}", 20_000, ip_address="burst", login_status="FAIL") for i in range(14)]
    rows += [attempt("CH-A", 30_000, phone="p1"), attempt("CH-B", 30_001, phone="p1", device_id="cd"),
             attempt("CH-C", 30_002, device_id="cd", address="ca"), attempt("CH-D", 30_003, address="ca")]
    rows += [attempt(f"KIOSK-{i}", 40_000 + 900 * i, device_id="kiosk", ip_address=f"kip{i}") for i in range(6)]
    rows += [attempt(f"NAT-{i}", 60_000 + 900 * i, ip_address="nat") for i in range(4)]
    rows += [attempt("RE-1", 70_000, document_hash="dup"), attempt("RE-1", 70_010, document_hash="dup"),
             attempt("RE-2", 70_020, document_hash="dup")]
    rows += [attempt("ATTR", 80_000, date_of_birth="2020-1-5", phone="+15551", address="Flat 2, India",
                     email="x@YOPMAIL.com", full_name="Sara Ali", document_name="Bob Stone")]
    rows += [attempt("META-1", 81_000, ela_score=0.0, metadata_flags=["x", "Metadata names image editing software: GIMP"]),
             attempt("META-2", 81_100, ela_score=0.0, metadata_flags=["No EXIF metadata present"], liveness_status="FAIL")]
    rows += [attempt("NO-TIME", None, ip_address="sip"), attempt(None, 90_000), attempt("BAD", 90_001, error="broken")]
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    df = durable(frame(spark, scenarios()))
    return df, durable(score_attempts(df))


@pytest.fixture(scope="module")
def by_name(scored):
    out = {}
    for r in scored[1].orderBy("seq").collect():
        out.setdefault(r["claimed_user_ref"], []).append((r["risk_score"], r["decision"], [x["rule"] for x in r["reasons"]]))
    return out


def test_known_scores(by_name):
    assert by_name["LEGIT-0"] == [(0, "ALLOW", [])]
    assert [by_name[f"STUFF-{i}"][0][0] for i in range(6)] == [10, 15, 23, 23, 23, 45]
    assert [by_name[f"SYN-{i}"][0][:2] for i in range(4)] == [(0, "ALLOW"), (40, "STEP_UP"), (48, "STEP_UP"), (48, "STEP_UP")]
    assert by_name["DOCF"] == [(20, "ALLOW", ["DOCUMENT_ELA_ANOMALY"])]


def test_burst_of_one_second_is_blocked(by_name):
    score, decision, rules = by_name["VICTIM-13"][0]
    assert decision == "BLOCK" and rules[0] == "CREDENTIAL_STUFFING_BURST" and "IP_FLAGGED" in rules


def test_chain_of_pairwise_links_is_a_large_cluster(by_name):
    assert by_name["CH-D"] == [(40, "STEP_UP", ["CROSS_RECORD_CLUSTER_LARGE"])]


def test_kiosk_and_shared_ip_stay_harmless(by_name):
    for i in range(1, 6):
        assert "CROSS_RECORD_CLUSTER_SMALL" in by_name[f"KIOSK-{i}"][0][2] and by_name[f"KIOSK-{i}"][0][1] == "ALLOW"
    assert all(by_name[f"NAT-{i}"][0] == (0, "ALLOW", []) for i in range(4))


def test_document_reuse_needs_another_identity_and_goes_forward_only(by_name):
    assert [x[2] for x in by_name["RE-1"]] == [[], []]
    assert by_name["RE-2"][0][1] == "BLOCK" and by_name["RE-2"][0][2] == ["CROSS_RECORD_CLUSTER_MEDIUM", "DOCUMENT_REUSE"]


def test_attribute_and_document_rules(by_name):
    assert by_name["ATTR"][0] == (50, "STEP_UP", ["IMPLAUSIBLE_AGE", "PHONE_RESIDENCE_MISMATCH", "DISPOSABLE_EMAIL",
                                                  "NAME_MISMATCH_DOCUMENT"])
    assert by_name["META-1"][0][2] == ["DOCUMENT_METADATA_EDITOR"]
    assert by_name["META-2"][0][2] == ["DOCUMENT_METADATA_MISSING", "LIVENESS_FAILED"]


def test_every_input_has_a_result_row(scored):
    df, s = scored
    rows = {r["record_id"]: r for r in jobs.result_rows(df, s).collect()}
    assert len(rows) == df.count()
    untimed = next(r for r in rows.values() if r["user_ref"] == "NO-TIME")
    broken = next(r for r in rows.values() if r["user_ref"] == "BAD")
    assert (untimed["status"], untimed["error_reason"]) == ("ERROR", "could not be scored (IntegrityError)")
    assert (broken["status"], broken["error_reason"], broken["decision"]) == ("ERROR", "broken", None)
    stuffed = next(r for r in rows.values() if r["user_ref"] == "STUFF-5")
    assert stuffed["top_reasons"] == "VELOCITY_ACCOUNT_SPREAD;VELOCITY_IP_MEDIUM;DEVICE_SHARED_HIGH"
    assert stuffed["predicted_attack"] == "CREDENTIAL_STUFFING"


def test_labels_do_not_matter_and_rescoring_is_stable(spark, scored):
    df, s = scored
    stored = s.withColumn("id", F.col("seq")).withColumn("scenario", F.lit("LEGITIMATE")).withColumn(
        "label_is_fraud", F.lit(True))
    again, changed = jobs.rescore(stored, documents=writers.document_registry(s))
    assert changed == 0
    same = again.filter("has_forensics = (ela_score IS NOT NULL OR document_hash IS NOT NULL)")
    cols = ["record_id", "risk_score", "reasons", "features"]
    kept = s.filter("document_hash IS NOT NULL OR ela_score IS NULL")
    assert same.join(kept.select("record_id"), "record_id", "left_semi").select(cols).exceptAll(kept.select(cols)).isEmpty()
    assert same.join(kept.select("record_id"), "record_id", "left_semi").count() == kept.count()
    # A score without a registered document is not an analysis the replay can see.
    assert again.filter("claimed_user_ref = 'DOCF'").first()["rule_points"] == 0


def test_reports_on_scored_rows(scored):
    _, s = scored
    t = reports.decision_totals(s).first()
    assert t["total"] == s.count() == t["allowed"] + t["stepped_up"] + t["blocked"]
    events = writers.audit_events(s)
    assert events.count() == 2 * t["total"]
    ref = s.filter("claimed_user_ref = 'RE-2'").first()["attempt_ref"]
    detail = reports.attempt_detail(s, events, writers.document_registry(s), ref).collect()
    assert len(detail) == 1 and detail[0]["seen_count"] == 3 and detail[0]["reasons"][0]["rule"] == "CROSS_RECORD_CLUSTER_MEDIUM"
    assert [a["step"] for a in detail[0]["audit"]] == [0, 1]
    text = {r["rule"]: r["description"] for r in writers.reasons_table(s.filter(F.col("attempt_ref") == ref)).collect()}
    assert text["DOCUMENT_REUSE"].endswith("1 other identity/identities (RE-1)")


def test_empty_and_added_rules(spark):
    empty = frame(spark, [attempt(None, 0)]).filter("record_id < 0")
    assert score_attempts(empty).count() == 0
    rule = Rule("CREDENTIAL_FAILED", F.col("stage") == "LOGIN", F.lit("again"))
    one = score_attempts(frame(spark, [attempt("A", 0)]).withColumn("stage", F.lit("LOGIN")), extra_rules=[rule]).first()
    assert one["rule_points"] == 10 and one["reasons"][0]["description"] == "again"
    with pytest.raises(ValueError):
        score_attempts(empty, extra_rules=[Rule("X", F.lit(True), F.lit("x"), feedback=True)])


def test_metrics_hand_computed(spark):
    rows = [(0, "OK", "BLOCK", True, "A", 80), (1, "OK", "ALLOW", True, "A", 10), (2, "OK", "ALLOW", False, "LEGITIMATE", 0),
            (3, "OK", "STEP_UP", False, "LEGITIMATE", 40), (4, "ERROR", None, True, "A", None)]
    df = spark.createDataFrame(rows, "record_id long, status string, decision string, label_is_fraud boolean,"
                               " label_category string, risk_score int").withColumn(
        "fraud_probability", F.lit(None).cast("double"))
    m = metrics.classification_metrics(df).first()
    assert [m[k] for k in ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate")] == [0.5] * 6
    assert metrics.roc_auc(df).first()[0] == 0.75
    assert metrics.classification_metrics(df.withColumn("label_is_fraud", F.lit(None).cast("boolean"))).isEmpty()
    one_class = df.filter("label_is_fraud")
    assert metrics.roc_auc(one_class).first()[0] is None
    q = metrics.decision_quality(df).first()
    assert (q[0], q[1], q[2], q[3]) == (0.5, 0.5, 0.5, 0.0)
    assert metrics.record_counts(df).first().asDict() == dict(records=5, valid_records=4, invalid_records=1, labeled_records=4)
    full = metrics.full_report(df).first()
    assert full["per_attack_type_detection"] == {"A": 0.5} and full["decision_breakdown"]["overall"]["ALLOW"] == 2


def test_confusion_and_calibration(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, prediction string")
    c = metrics.confusion_matrix(pred, ["a", "b", "c"])
    assert c.count() == 9
    p = {r["label"]: r for r in metrics.per_class(c).collect()}
    assert (p["a"]["precision"], p["a"]["recall"], p["b"]["precision"], p["c"]["f1"], p["c"]["support"]) == (1.0, 0.5, 0.5, 0.0, 0)
    scores = spark.createDataFrame([(1.0, False), (2.0, False), (9.0, True), (3.0, True)], "ela_score double, tampered boolean")
    cal = metrics.calibrate_threshold(scores).first()
    best = None
    for cand in metrics.candidate_thresholds():
        acc = (sum(v < cand for v in (1.0, 2.0)) / 2 + sum(v >= cand for v in (9.0, 3.0)) / 2) / 2
        if best is None or acc > best[0]:
            best = (acc, cand)
    assert (cal["threshold"], cal["balanced_accuracy"]) == (round(best[1], 2), round(best[0], 4))
    assert metrics.calibrate_threshold(scores.filter("tampered")).first()["threshold"] == 10.8


def test_histogram_and_paging(spark):
    df = spark.createDataFrame([(5, "ALLOW"), (15, "ALLOW"), (45, "STEP_UP"), (95, "BLOCK"), (100, "BLOCK")],
                               "risk_score int, decision string").withColumn("scenario", F.lit("S")) \
        .withColumn("seq", F.col("risk_score"))
    h = {r["label"]: (r["count"], r["band"]) for r in reports.score_histogram(df).collect()}
    assert len(h) == 10 and h["90-100"] == (2, "BLOCK") and h["20-29"] == (0, "ALLOW")
    assert sum(r["count"] for r in reports.score_histogram(df, scenario="none").collect()) == 0
    assert [r["risk_score"] for r in reports.recent_attempts(df, 2, 1).collect()] == [95, 45]
    with pytest.raises(ValueError):
        reports.recent_attempts(df, 0)
    assert reports.decision_totals(df.filter("false")).first().asDict() == dict(total=0, allowed=0, stepped_up=0, blocked=0)


def test_medians_without_a_sort(spark):
    import random
    import statistics
    r = random.Random(3)
    cases = [[1.0], [1.0, 2.0], [5.0] * 9, [r.gauss(0, 1) for _ in range(501)], [float(r.randrange(4)) for _ in range(200)],
             [10.0 ** r.randrange(-300, 300) for _ in range(101)], [-1.7e308, 1.7e308, 0.0, 1.0], [0.0] * 50 + [1e9] * 50]
    n = max(map(len, cases))
    rows = [tuple(c[i] if i < len(c) else None for c in cases) for i in range(n)] + [tuple([float("nan")] * len(cases)), tuple([None] * len(cases))]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(len(cases)))).withColumn("none", F.lit(None).cast("double"))
    got = metrics.medians(df, [*(f"x{i}" for i in range(len(cases))), "none"], bins=4)
    assert got.pop("none") is None
    assert [got[f"x{i}"] for i in range(len(cases))] == [statistics.median(c) for c in cases]
