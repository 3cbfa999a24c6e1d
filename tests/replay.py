"""One-row-at-a-time replay, used only to check the DataFrame operators on small random inputs."""

from __future__ import annotations

import difflib

from attestra.policy import RULE_POINTS, SCORE_FLOORS, DISPOSABLE_DOMAINS

KINDS = ("device_id", "phone", "address", "document_hash")


def cluster_of(who, rows):
    """Members and shared kinds of the component of ``who`` given all rows so far."""
    members, size = {who}, 0
    while len(members) != size:
        size = len(members)
        held = {(k, r[k]) for r in rows if r["id"] in members for k in KINDS if r[k]}
        members |= {r["id"] for r in rows if r["id"] and any((k, r[k]) in held for k in KINDS)}
    holders = {}
    for r in rows:
        for k in KINDS:
            if r[k] and r["id"] in members:
                holders.setdefault((k, r[k]), set()).add(r["id"])
    return members, {k for (k, _), ids in holders.items() if len(ids) > 1}


def replay(rows, velocity=60, window=300, added=()):
    """``rows`` in scoring order -> per row (features dict, fired rule names, score, decision).

    ``added``: (rule, points, key, least number of earlier blocks with the same key).
    """
    past, bad_ip, bad_dev, bad_id, out = [], set(), set(), set(), []
    counts = {}
    given = {**RULE_POINTS, **{name: points for name, points, *_ in added}}
    for r in rows:
        f, fired = {}, []

        def fire(name, when):
            if when:
                fired.append(name)

        v = spread = failed = 0
        if r["ip"]:
            near = [p for p in past if p["ip"] == r["ip"] and r["sec"] - velocity <= p["sec"] <= r["sec"]]
            v = len(near)
            spread = len({p["id"] for p in past if p["ip"] == r["ip"] and p["id"]
                          and r["sec"] - window <= p["sec"] <= r["sec"]})
            if r["id"]:
                failed = sum(p["id"] == r["id"] and p["login"] == "FAIL"
                             and r["sec"] - window <= p["sec"] <= r["sec"] for p in past)
        fire("CREDENTIAL_STUFFING_BURST", v >= 10)
        fire("VELOCITY_IP_MEDIUM", 5 <= v < 10)
        fire("VELOCITY_ACCOUNT_SPREAD", spread >= 5)
        fire("VELOCITY_FAILED_LOGINS", failed >= 3)
        fire("IP_FLAGGED", r["ip"] in bad_ip)
        fire("DEVICE_FLAGGED", r["device_id"] in bad_dev)
        now = past + [r]
        dev = len({p["id"] for p in now if p["id"] and p["device_id"] == r["device_id"]}) if r["device_id"] else 0
        fire("DEVICE_SHARED_HIGH", dev >= 3)
        mail = (r["email"] or "").lower()
        fire("DISPOSABLE_EMAIL", "@" in mail and mail.rsplit("@", 1)[1] in DISPOSABLE_DOMAINS)
        if r["doc_name"] and r["name"]:
            fire("NAME_MISMATCH_DOCUMENT", difflib.SequenceMatcher(
                None, r["doc_name"].lower(), r["name"].lower()).ratio() < 0.8)
        size, kinds, near_block = 0, set(), False
        if r["id"]:
            members, kinds = cluster_of(r["id"], now)
            size = len(members)
            near_block = bool((members & bad_id) - {r["id"]})
            strong = kinds & {"phone", "document_hash"}
            if size >= 2 and kinds:
                fire("CROSS_RECORD_CLUSTER_LARGE", strong and len(kinds) >= 2)
                fire("CROSS_RECORD_CLUSTER_MEDIUM", bool(strong) != (len(kinds) >= 2))
                fire("CROSS_RECORD_CLUSTER_SMALL", not strong and len(kinds) == 1)
            firm = bool(strong) or len(kinds) >= 2
            fire("LINKED_TO_BLOCKED_STRONG", near_block and firm)
            fire("LINKED_TO_BLOCKED_WEAK", near_block and not firm)
        reuse = 0
        if r["document_hash"]:
            shown = [p["id"] for p in past if p["document_hash"] == r["document_hash"] and p["id"]]
            reuse = len(set(shown))
            fire("DOCUMENT_REUSE", r["id"] and set(shown) - {r["id"]})
        fire("CREDENTIAL_FAILED", r["login"] == "FAIL")
        for name, _, key, least in added:
            fire(name, r[key] and counts.get((key, r[key]), 0) >= least)
        points = sum(given[n] for n in fired)
        score = max([points] + [SCORE_FLOORS[n] for n in fired if n in SCORE_FLOORS])
        score = min(100, score)
        decision = "BLOCK" if score >= 70 else "STEP_UP" if score >= 30 else "ALLOW"
        if decision == "BLOCK":
            bad_ip |= {r["ip"]} - {None}
            bad_dev |= {r["device_id"]} - {None}
            bad_id |= {r["id"]} - {None}
            for key in {k for _, _, k, _ in added}:
                counts[(key, r[key])] = counts.get((key, r[key]), 0) + 1
        f.update(velocity_ip_count=v, velocity_account_spread=spread, failed_login_count=failed,
                 device_identity_count=dev, cluster_identity_count=size, cluster_binding_kinds=len(kinds),
                 cluster_has_blocked=int(near_block), document_reuse_count=reuse)
        out.append((f, fired, score, decision))
        past.append(r)
    return out


def random_rows(rng, n, ids=12, pool=6, span=900, hot=0.35):
    """Rows with ties, missing values and one value per key that holds about a third of all rows."""
    def pick(prefix, k, missing=0.15):
        x = rng.random()
        if x < missing:
            return None
        return f"{prefix}0" if x < missing + hot else f"{prefix}{rng.randrange(k)}"

    rows = []
    for i in range(n):
        who = pick("u", ids, 0.05)
        rows.append({
            "record_id": i, "id": who, "sec": 1_700_000_000 + rng.randrange(span),
            "ip": pick("ip", pool, 0.1), "device_id": pick("d", 3 * ids, 0.5),
            "phone": pick("p", 4 * ids, 0.7) if rng.random() < 0.4 else None,
            "address": pick("a", 4 * ids, 0.8) if rng.random() < 0.4 else None,
            "document_hash": pick("h", 3 * ids, 0.8) if rng.random() < 0.3 else None,
            "login": rng.choice(["PASS", "FAIL", "NOT_SUBMITTED"]),
            "email": rng.choice([None, "a@b.com", "x@Yopmail.com"]),
            "name": rng.choice([None, "Sara Ali", "Omar Said"]),
            "doc_name": rng.choice([None, "sara ali", "Sara Alli", "Completely Else"])})
    rows.sort(key=lambda r: (r["sec"], r["record_id"]))
    return rows


def to_frame(spark, rows):
    data = [(r["record_id"], r["id"], r["sec"], r["ip"], r["device_id"], r["phone"], r["address"],
             r["document_hash"], r["login"], r["email"], r["name"], r["doc_name"]) for r in rows]
    schema = ("record_id long, claimed_user_ref string, sec long, ip_address string, device_id string,"
              " phone string, address string, document_hash string, login_status string, email string,"
              " full_name string, document_name string")
    from pyspark.sql import functions as F
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("sec"))
