"""As-of operators against brute force, with plain keys and with keys split into small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import graph, temporal
from attestra.operators import clusters
from attestra.operators.clusters import replay_clusters
from attestra.operators.ordering import chronological, dense_rank_in_order
from attestra.operators.skew import hot_values
from attestra.policy import Skew
from replay import cluster_of, random_rows, to_frame

TINY = Skew(hot_rows=15, block_rows=20)


@pytest.fixture(scope="module")
def data(spark):
    rows = random_rows(random.Random(7), 240, span=500)
    for i, r in enumerate(rows):
        r["seq"] = i
    from attestra.session import durable
    df = to_frame(spark, rows)
    order = spark.createDataFrame([(r["record_id"], r["seq"]) for r in rows], "record_id long, seq long")
    return rows, durable(df.join(order, "record_id"))


def column(df, name):
    return {r["seq"]: r[name] for r in df.select("seq", name).collect()}


@pytest.mark.parametrize("skew", [Skew(), TINY], ids=["plain", "split"])
def test_trailing_and_running_counts(data, skew):
    rows, df = data
    hot = hot_values(df, ["ip_address", "claimed_user_ref", "device_id", "document_hash"], skew)
    assert (hot["ip_address"] is None) == (skew == Skew())
    d = temporal.velocity_count(df, seconds=60, hot=hot["ip_address"], skew=skew)
    d = temporal.account_spread(d, 120, hot=hot["ip_address"], skew=skew)
    d = temporal.failed_logins(d, 200, hot=hot["claimed_user_ref"], skew=skew)
    d = temporal.device_identity_count(d, hot=hot["device_id"], skew=skew)
    d = temporal.document_history(d, hot=hot["document_hash"], skew=skew)
    got = {r["seq"]: r for r in d.collect()}
    assert len(got) == len(rows)
    for r in rows:
        past = rows[:r["seq"]]
        near = [p for p in past if r["ip"] and p["ip"] == r["ip"]]
        g = got[r["seq"]]
        assert g["velocity_ip_count"] == sum(p["sec"] >= r["sec"] - 60 for p in near)
        assert g["velocity_account_spread"] == len(
            {p["id"] for p in near if p["id"] and p["sec"] >= r["sec"] - 120})
        assert g["failed_login_count"] == sum(
            bool(r["ip"] and r["id"]) and p["id"] == r["id"] and p["login"] == "FAIL"
            and p["sec"] >= r["sec"] - 200 for p in past)
        assert g["device_identity_count"] == (len({p["id"] for p in rows[:r["seq"] + 1] if p["id"]
                                                   and p["device_id"] == r["device_id"]})
                                              if r["device_id"] else 0)
        shown = {p["id"] for p in past if r["document_hash"] and p["id"]
                 and p["document_hash"] == r["document_hash"]}
        assert g["document_reuse_count"] == len(shown)
        assert g["document_other_count"] == (len(shown - {r["id"]}) if r["id"] else 0)


def test_no_window_holds_a_hot_key_whole(spark, monkeypatch):
    """One address with 300 rows, most in seconds of their own: every window of the sums stays within block_rows."""
    sizes, levels = [], temporal._levels

    def watched(totals, group, at, values, width, low, span):
        cell = F.floor((F.col(at) - low) / width)
        sizes.append(totals.groupBy(*group, cell).count().agg(F.max("count")).first()[0])
        return levels(totals, group, at, values, width, low, span)

    monkeypatch.setattr(temporal, "_levels", watched)
    r = random.Random(2)
    secs = sorted(r.randrange(500) for _ in range(300))
    df = spark.createDataFrame([(i, s, "a") for i, s in enumerate(secs)], "seq long, sec long, ip_address string")
    got = column(temporal.velocity_count(df, seconds=40, skew=Skew(hot_rows=10, block_rows=9)), "velocity_ip_count")
    assert got == {i: sum(s - 40 <= t for t in secs[:i]) for i, s in enumerate(secs)}
    assert len(sizes) >= 4 and max(sizes) <= 9


def test_other_presenters_in_order_of_appearance(spark):
    df = spark.createDataFrame([(i, "h", f"u{i % 6}") for i in range(8)],
                               "seq long, document_hash string, claimed_user_ref string")
    d = temporal.document_other_names(df, temporal.first_presenters(df))
    got = column(d, "document_other_names")
    assert got[0] == [] and got[1] == ["u0"] and got[4] == ["u0", "u1", "u2"] and got[6] == ["u1", "u2", "u3"]


@pytest.mark.parametrize("cap", [250_000, 25], ids=["whole", "cut"])
def test_asof_clusters(spark, data, cap):
    rows, df = data
    rows, df = rows[:110], df.filter("seq < 110")
    blocked = {r["seq"] for r in rows if r["seq"] % 9 == 4}
    edges = graph.identity_edges(df)
    vertices = graph.identities(df)
    links = graph.identity_links(edges, vertices)
    roots = graph.connected(links, "vid", "anchor").select(
        F.col("node").alias("vid"), F.col("root").alias("component"))
    who = df.select("seq", F.col("claimed_user_ref").alias("identity"), (F.col("seq") % 9 == 4).alias("blocked")) \
        .join(vertices, "identity")
    got = {r["seq"]: r for r in replay_clusters(who, links, roots, Skew(cluster_rows=cap)).collect()}
    assert len(got) > 50
    # The merge forest answers the same question without a replay.
    replayed = clusters.replay(who.withColumn("blocked", F.lit(False)), links, roots, Skew(cluster_rows=cap)).cache()
    hubs = clusters.ancestors(replayed, roots).cache()
    first = who.filter("blocked").groupBy("vid").agg(F.min("seq").alias("at"))
    linked = {r["vid"]: r["at"] for r in clusters.linked_at(hubs, first).collect()}
    one_each = hubs.groupBy("vid", "hub").count().filter("count > 1")
    assert one_each.isEmpty() and hubs.groupBy("vid").count().agg(F.max("count")).first()[0] > 2
    for r in rows:
        if not r["id"]:
            continue
        members, kinds = cluster_of(r["id"], rows[:r["seq"] + 1])
        bad = {p["id"] for p in rows[:r["seq"]] if p["seq"] in blocked and p["id"]}
        g = got.get(r["seq"])
        have = (g["cluster_size"], bin(g["kind_mask"]).count("1"), g["linked_blocked"]) if g else (1, 0, False)
        assert have == (len(members), len(kinds), bool((members & bad) - {r["id"]})), r["seq"]
        assert bool(g) and linked.get(g["vid"], r["seq"]) < r["seq"] or not have[2], r["seq"]
        assert have[2] or not g or not linked.get(g["vid"], r["seq"]) < r["seq"], r["seq"]


def test_total_order(spark):
    df = spark.createDataFrame([(0, "2026-01-01 10:05:00"), (1, "2026-01-01 10:00:00"), (2, None),
                                (3, "2026-01-01 10:00:00.5"), (4, "2026-01-01 10:00:00")],
                               "record_id long, t string").withColumn("ts", F.to_timestamp("t"))
    order = [r["record_id"] for r in chronological(df).orderBy("seq").collect()]
    assert order == [1, 4, 3, 0, 2]
    ranked = dense_rank_in_order(df, [F.col("record_id").desc()], "w", weight=F.col("record_id"))
    assert {r["record_id"]: r["w"] for r in ranked.collect()} == {4: 0, 3: 4, 2: 7, 1: 9, 0: 10}


def test_reputation_and_flags(spark):
    df = spark.createDataFrame([(0, "a", "ALLOW"), (1, "a", "BLOCK"), (2, "a", "ALLOW"), (3, None, "BLOCK"),
                                (4, "b", "ALLOW"), (5, "a", "BLOCK")], "seq long, ip_address string, decision string")
    assert column(temporal.ip_flagged(df, df), "ip_flagged") == {0: False, 1: False, 2: True, 3: False,
                                                                 4: False, 5: True}
    t = temporal.reputation_table(df, "ip_address").collect()
    assert [(r["ip_address"], r["first_seq"], r["hit_count"]) for r in t] == [("a", 1, 2)]


def test_campaigns(spark):
    rows = [("A", 0, "2026-01-01 00:00:00", "ALLOW"), ("A", 1, "2026-01-01 00:00:30", "STEP_UP"),
            ("A", 2, "2026-01-01 00:01:00", "BLOCK"), ("B", 3, "2026-01-01 00:00:00", "ALLOW"),
            (None, 4, "2026-01-01 00:00:00", "BLOCK"), ("C", 5, "2026-01-01 00:00:00", "BLOCK"),
            ("C", 6, None, "ALLOW")]
    df = spark.createDataFrame(rows, "campaign_id string, record_id long, t string, decision string") \
        .withColumn("ts", F.to_timestamp("t"))
    got = {r["campaign_id"]: (r["detected"], r["position"], r["seconds"])
           for r in temporal.campaign_detection(df).collect()}
    assert got == {"A": (True, 2, 30.0), "B": (False, None, None), "C": (True, 2, None)}
