"""The whole scoring plan against the row-at-a-time replay, with plain and with split keys."""

import random

import pytest

from pyspark.sql import functions as F

from attestra.operators.rules import Earlier, Rule
from attestra.plans.scoring import base_features, fixpoint, ordered, score_attempts
from attestra.policy import Policy, Skew
from replay import random_rows, replay, to_frame

SPLIT = Skew(hot_rows=20, block_rows=25)


@pytest.mark.parametrize("seed,skew", [(1, Skew()), (2, SPLIT)], ids=["plain", "split"])
def test_scores_equal_the_replay(spark, seed, skew):
    rng = random.Random(seed)
    rows = random_rows(rng, 120, span=300 if seed == 2 else 1500)
    want = dict(zip((r["record_id"] for r in rows), replay(rows)))
    got = {r["record_id"]: r for r in score_attempts(to_frame(spark, rows), skew=skew).collect()}
    assert set(got) == set(want)
    for i, (features, fired, score, decision) in want.items():
        have = got[i]
        assert {k: have["features"][k] for k in features} == features, i
        assert [x["rule"] for x in have["reasons"]] == fired, i
        assert (have["risk_score"], have["decision"]) == (score, decision), i
    assert any(d == "BLOCK" for *_, d in want.values())


def test_rules_of_the_user_read_earlier_decisions(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 150, span=1500)
    added = (("PHONE_BLOCKED", 35, "phone", 1), ("MAIL_BLOCKED_OFTEN", 50, "email", 3))
    want = dict(zip((r["record_id"] for r in rows), replay(rows, added=added)))
    own = [Rule("PHONE_BLOCKED", F.col("phone_seen"), F.lit("phone"), feedback=True, needs=(Earlier("phone_seen", "phone"),)),
           Rule("MAIL_BLOCKED_OFTEN", F.col("mail_seen"), F.lit("mail"), feedback=True, needs=(Earlier("mail_seen", "email", 3),))]
    policy = Policy(points={**Policy().points, "PHONE_BLOCKED": 35, "MAIL_BLOCKED_OFTEN": 50})
    got = {r["record_id"]: r for r in score_attempts(to_frame(spark, rows), policy, extra_rules=own).collect()}
    fired = set()
    for i, (_, names, score, decision) in want.items():
        assert [x["rule"] for x in got[i]["reasons"]] == names, i
        assert (got[i]["risk_score"], got[i]["decision"]) == (score, decision), i
        fired |= set(names)
    assert {"PHONE_BLOCKED", "MAIL_BLOCKED_OFTEN"} <= fired
    with pytest.raises(ValueError):
        score_attempts(to_frame(spark, rows), extra_rules=[Rule("X", F.lit(True), F.lit("x"), feedback=True)])
    with pytest.raises(ValueError):
        score_attempts(to_frame(spark, rows), extra_rules=[
            Rule(f"X{i}", F.lit(True), F.lit("x"), feedback=True, needs=(Earlier(f"x{i}", "phone"),)) for i in range(4)])


def test_rounds_visit_fewer_and_fewer_rows(spark):
    # A chain: each row blocks only if its address was blocked, and hands the block on through its device.
    rows = []
    for i in range(12):
        rows.append({"record_id": i, "id": f"u{i}", "sec": 1_700_000_000 + 1000 * i, "ip": f"ip{i // 2}", "device_id": f"d{(i + 1) // 2}",
                     "phone": None, "address": None, "document_hash": None, "login": "FAIL", "email": "x@yopmail.com",
                     "name": "Sara Ali", "doc_name": "Completely Else"})
    seed = dict(rows[0], record_id=100, sec=1_699_999_999)
    seeds = [dict(seed, record_id=100 + k, id=f"s{k}", device_id=None) for k in range(14)]
    log = sorted([*seeds, *rows], key=lambda r: (r["sec"], r["record_id"]))
    policy = Policy(points={**Policy().points, "IP_FLAGGED": 40, "DEVICE_FLAGGED": 40})
    base = base_features(ordered(to_frame(spark, log)), policy)
    found = fixpoint(base, policy)
    visited = [n for n, _ in found.rounds]
    assert len(visited) > 4 and sum(visited) < 3 * len(log) and visited[-1] <= 2 and found.rounds[-1][1] == 0
    blocked = {r["record_id"] for r in score_attempts(to_frame(spark, log), policy).filter("decision = 'BLOCK'").collect()}
    assert set(range(12)) <= blocked
