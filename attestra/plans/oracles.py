"""DuckDB SQL with the meaning of each registered query, written from the definition and not from the plan."""

from __future__ import annotations

DAY = 86_400
KEY = "k1"
SQL: dict[str, str] = {}

EVENTS = """ev AS (
  SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(user_id AS VARCHAR) AS identity,
         'ip' || (user_id % 7) AS ip, nullif(regexp_extract(props, '[0-9]+', 0), '') AS device,
         event_type = 'error' AS failed
  FROM events)"""

ORDERS = """att AS (
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, o_orderkey AS record_id,
    CAST(epoch(o_orderdate) AS BIGINT) AS sec, o_orderdate AS ts, 'C' || o_custkey AS identity,
    'ip' || (o_custkey // 150) AS ip,
    CASE WHEN o_custkey % 4 < 2 THEN 'dev' || (o_custkey // 4) END AS device,
    CASE WHEN o_custkey % 9 < 2 THEN '+' || (97150000000 + o_custkey // 9) END AS phone,
    CASE WHEN o_custkey % 14 < 3 THEN (o_custkey // 28) || ' Ring Rd, ' ||
      CASE (o_custkey // 28) % 3 WHEN 0 THEN 'UAE' WHEN 1 THEN 'India' ELSE 'Springfield' END END AS address,
    'user' || o_custkey || '@' || CASE WHEN o_custkey % 37 = 0 THEN 'YOPMAIL.com' ELSE 'example.com' END AS email,
    CASE WHEN o_custkey % 21 < 2 THEN 'H' || (o_custkey // 21) END AS doc,
    CASE WHEN o_orderkey % 25 = 0 THEN (o_orderkey % 130) / 10.0 END AS ela,
    CASE o_custkey % 50 WHEN 0 THEN DATE '2015-06-01' WHEN 1 THEN DATE '1880-02-01' ELSE DATE '1980-05-05' END AS dob,
    CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'NOT_SUBMITTED' END AS login,
    CASE WHEN o_orderkey % 40 = 0 THEN 'FAIL' ELSE 'PASS' END AS liveness,
    CASE o_orderstatus WHEN 'F' THEN 'CREDENTIAL_STUFFING' WHEN 'O' THEN 'LEGITIMATE' ELSE 'UNKNOWN' END AS scenario
  FROM orders)"""

PEOPLE = """pe AS (
  SELECT c_custkey AS seq, 'C' || c_custkey AS identity, 'ip' || (c_custkey % 20) AS ip_address,
    CASE WHEN c_custkey % 4 < 2 THEN 'dev' || (c_custkey // 4) END AS device_id,
    CASE WHEN c_custkey % 9 < 2 THEN '+' || (97150000000 + c_custkey // 9) END AS phone,
    CASE WHEN c_custkey % 14 < 3 THEN (c_custkey // 28) || ' Ring Rd' END AS address,
    CASE WHEN c_custkey % 21 < 2 THEN 'H' || (c_custkey // 21) END AS document_hash,
    c_acctbal < 0 AS blocked
  FROM customer),
pedge AS (SELECT identity, kind, value, seq AS first_seq FROM (
  UNPIVOT (SELECT seq, identity, ip_address, device_id, phone, address, document_hash FROM pe)
  ON ip_address, device_id, phone, address, document_hash INTO NAME kind VALUE value))"""

# Components as minimum first_seq over reachable identities. {kinds} picks the linking kinds.
REACH = """start AS (SELECT DISTINCT identity, seq AS vid FROM pe),
le AS (SELECT * FROM pedge WHERE {kinds}),
reach AS (
  SELECT identity AS src, identity AS dst FROM start
  UNION
  SELECT r.src, b.identity FROM reach r JOIN le a ON a.identity = r.dst
    JOIN le b ON b.kind = a.kind AND b.value = a.value),
comp AS (SELECT src AS identity, min(s.vid) AS component FROM reach JOIN start s ON s.identity = dst GROUP BY src)"""
NO_IP = "kind <> 'ip_address'"

RESULTS = """res AS (
  SELECT *, CASE WHEN decision = 'ALLOW' AND record_id % 11 = 0 THEN 'STEP_UP' ELSE decision END AS initial_decision
  FROM (SELECT o_orderkey AS record_id, o_custkey AS cust, 'C' || o_custkey AS identity,
    CASE WHEN o_orderkey % 83 <> 0 THEN o_orderdate END AS ts,
    CASE WHEN o_orderkey % 97 = 0 THEN 'ERROR' ELSE 'OK' END AS status,
    (o_orderkey * 37 + o_custkey * 11) % 101 AS risk_score,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN (o_orderkey * 37 + o_custkey * 11) % 101 >= 70 THEN 'BLOCK'
      WHEN (o_orderkey * 37 + o_custkey * 11) % 101 >= 30 THEN 'STEP_UP' ELSE 'ALLOW' END AS decision,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7 % 1000) / 1000.0 END AS fraud_probability,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS fraud,
    CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'LEGITIMATE' END AS category,
    CASE WHEN o_orderstatus = 'F' THEN 'K' || (o_custkey % 400) END AS campaign_id,
    CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'LEGITIMATE' ELSE 'UNKNOWN' END AS scenario,
    'H' || (o_custkey % 300) AS document_hash, printf('ATT-%05d', o_orderkey) AS attempt_ref
  FROM orders)),
lab AS (SELECT * FROM res WHERE status = 'OK' AND fraud IS NOT NULL)"""

TRUTH = """res AS (SELECT doc_id AS record_id, 'OK' AS status, toxic = 1 AS fraud,
    CASE WHEN toxic = 1 THEN upper(lang) ELSE 'LEGITIMATE' END AS category,
    least(100, n_chars // 100) AS risk_score,
    CASE WHEN n_chars > 4000 THEN 'BLOCK' WHEN n_chars > 1500 THEN 'STEP_UP' ELSE 'ALLOW' END AS decision,
    CAST(NULL AS DOUBLE) AS fraud_probability
  FROM labels JOIN documents USING (doc_id)),
lab AS (SELECT * FROM res)"""

# ---- as-of operators
SQL["chronological_order"] = f"WITH {ORDERS} SELECT record_id, seq FROM att"
SQL["velocity_ip"] = f"""WITH {EVENTS} SELECT a.seq, count(b.seq) AS velocity_ip_count FROM ev a LEFT JOIN ev b
  ON b.ip = a.ip AND b.seq < a.seq AND b.sec BETWEEN a.sec - 21600 AND a.sec GROUP BY a.seq"""
SQL["velocity_ip_split"] = SQL["velocity_ip"]
SQL["velocity_ties"] = f"""WITH {ORDERS} SELECT a.record_id, count(b.seq) AS velocity_ip_count FROM att a LEFT JOIN att b
  ON b.ip = a.ip AND b.seq < a.seq AND b.sec >= a.sec - {3 * DAY} GROUP BY a.record_id"""
SQL["account_spread"] = f"""WITH {EVENTS} SELECT a.seq, count(DISTINCT b.identity) AS velocity_account_spread
  FROM ev a LEFT JOIN ev b ON b.ip = a.ip AND b.seq < a.seq AND b.sec BETWEEN a.sec - 43200 AND a.sec GROUP BY a.seq"""
SQL["account_spread_split"] = SQL["account_spread"]
SQL["failed_logins"] = f"""WITH {EVENTS} SELECT a.seq, count(b.seq) AS failed_login_count FROM ev a LEFT JOIN ev b
  ON b.identity = a.identity AND b.failed AND b.seq < a.seq AND b.sec BETWEEN a.sec - {7 * DAY} AND a.sec GROUP BY a.seq"""
SQL["device_identities"] = f"""WITH {EVENTS} SELECT a.seq, count(DISTINCT b.identity) AS device_identity_count
  FROM ev a LEFT JOIN ev b ON b.device = a.device AND b.seq <= a.seq GROUP BY a.seq"""
SQL["device_identities_split"] = SQL["device_identities"]
SQL["document_reuse"] = """WITH p AS (SELECT doc_id AS seq, source AS who, sha256(text) AS h FROM documents),
f AS (SELECT h, who, min(seq) AS s FROM p GROUP BY h, who),
o AS (SELECT p.seq, f.who, f.s, row_number() OVER (PARTITION BY p.seq ORDER BY f.s) AS n FROM p JOIN f
      ON f.h = p.h AND f.s < p.seq AND f.who <> p.who)
SELECT p.seq, (SELECT count(*) FROM f WHERE f.h = p.h AND f.s < p.seq) AS document_reuse_count,
  (SELECT count(*) FROM o WHERE o.seq = p.seq) AS document_other_count,
  coalesce((SELECT string_agg(who, ',' ORDER BY s) FROM o WHERE o.seq = p.seq AND n <= 3), '') AS others FROM p"""
BLOCKS = f"""{EVENTS}, vel AS (SELECT a.seq, a.ip, a.device, count(b.seq) AS v FROM ev a LEFT JOIN ev b
  ON b.ip = a.ip AND b.seq < a.seq AND b.sec BETWEEN a.sec - 21600 AND a.sec GROUP BY a.seq, a.ip, a.device)"""
SQL["ip_reputation"] = f"""WITH {BLOCKS}, f AS (SELECT ip, min(seq) AS s FROM vel WHERE v >= 22 GROUP BY ip)
  SELECT vel.seq, CAST(coalesce(f.s < vel.seq, false) AS BIGINT) AS ip_flagged FROM vel LEFT JOIN f USING (ip)"""
SQL["device_reputation"] = f"""WITH {BLOCKS}, f AS (SELECT device, min(seq) AS s FROM vel WHERE v >= 22 GROUP BY device)
  SELECT vel.seq, CAST(coalesce(f.s < vel.seq, false) AS BIGINT) AS device_flagged FROM vel LEFT JOIN f USING (device)"""
SQL["reputation_table"] = f"""WITH {BLOCKS} SELECT device AS device_id, min(seq) AS first_seq, count(*) AS hit_count
  FROM vel WHERE v >= 22 AND device IS NOT NULL GROUP BY device"""
SQL["campaign_detection"] = """WITH r AS (SELECT conv_id, role, turn, 1700000000 + turn * 30 AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
h AS (SELECT conv_id, min(pos) AS p FROM r WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id AS campaign_id, CAST(h.p IS NOT NULL AS BIGINT) AS detected, coalesce(h.p, -1) AS position,
  CAST(x.t - c.t AS DOUBLE) AS seconds FROM r c LEFT JOIN h USING (conv_id)
  LEFT JOIN r x ON x.conv_id = c.conv_id AND x.pos = h.p WHERE c.pos = 1"""

# ---- graph
SQL["identity_edges"] = f"""WITH {ORDERS}, l AS (SELECT seq, identity, ip AS ip_address, device AS device_id, phone,
  address, doc AS document_hash FROM att)
  SELECT identity, kind, value, min(seq) AS first_seq FROM (UNPIVOT l ON ip_address, device_id, phone, address,
  document_hash INTO NAME kind VALUE value) GROUP BY identity, kind, value"""
SQL["components"] = f"WITH RECURSIVE {PEOPLE}, {REACH.format(kinds=NO_IP)} SELECT identity, component FROM comp"
SQL["components_with_ip"] = f"WITH RECURSIVE {PEOPLE}, {REACH.format(kinds='true')} SELECT identity, component FROM comp"
SQL["attribute_degree"] = f"""WITH {PEOPLE} SELECT kind, value, count(*) AS identities FROM pedge GROUP BY kind, value"""
SQL["shared_attributes"] = f"""WITH {PEOPLE}, n AS (SELECT kind, value, count(*) AS c FROM pedge GROUP BY kind, value)
  SELECT identity, kind AS attribute, value, c - 1 AS others FROM pedge JOIN n USING (kind, value) WHERE c > 1"""
SQL["shared_with"] = f"""WITH {PEOPLE} SELECT a.kind AS attribute, a.value, b.identity AS other FROM pedge a JOIN pedge b
  USING (kind, value) WHERE a.identity = 'C28' AND b.identity <> 'C28'"""
SQL["binding_kinds"] = f"""WITH RECURSIVE {PEOPLE}, {REACH.format(kinds=NO_IP)},
n AS (SELECT kind, value FROM le GROUP BY kind, value HAVING count(*) > 1)
SELECT component, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM le JOIN n USING (kind, value)
  JOIN comp USING (identity) GROUP BY component"""
SQL["link_summary"] = f"""WITH {PEOPLE}, n AS (SELECT kind, value, count(*) AS c FROM pedge GROUP BY kind, value)
  SELECT identity, kind AS attribute, CASE WHEN kind IN ('phone', 'document_hash') THEN 'strong' ELSE 'weak' END AS strength,
  c - 1 AS identity_count FROM pedge JOIN n USING (kind, value) WHERE c > 1 AND kind <> 'ip_address'"""
SQL["blocked_identities"] = f"WITH {PEOPLE} SELECT DISTINCT identity FROM pe WHERE blocked"
_NODE = f"substr(sha256('{KEY}' || chr(31) || {{k}} || chr(31) || {{v}}), 1, 24)"
_MASK = f"'***' || CASE WHEN length({{v}}) > {{n}} THEN right({{v}}, {{n}}) ELSE '' END || '#' || substr(sha256('{KEY}' || {{v}}), 1, 8)"
SUB = f"""{PEOPLE}, {REACH.format(kinds=NO_IP)},
mem AS (SELECT dst AS identity FROM reach WHERE src = 'C28'),
sh AS (SELECT kind, value FROM le GROUP BY kind, value HAVING count(*) > 1),
nod AS (SELECT 'identity' AS kind, identity AS value FROM mem UNION
  SELECT kind, value FROM le JOIN sh USING (kind, value) JOIN mem USING (identity)),
rnk AS (SELECT *, row_number() OVER (ORDER BY (kind = 'identity' AND value = 'C28') DESC, (kind = 'identity'), kind, value)
  AS position, count(*) OVER () AS total FROM nod)"""
SQL["cluster_subgraph_nodes"] = f"""WITH RECURSIVE {SUB} SELECT position, {_NODE.format(k='kind', v='value')} AS id,
  CASE WHEN kind IN ('phone', 'address') THEN {_MASK.format(v='value', n=2)}
    WHEN kind = 'document_hash' THEN 'doc:' || substr(value, 1, 8) ELSE value END AS label, kind AS "group",
  CAST(kind = 'identity' AND value IN (SELECT identity FROM pe WHERE blocked) AS BIGINT) AS blocked,
  CAST(kind = 'identity' AND value = 'C28' AS BIGINT) AS focus, CAST(total > 6 AS BIGINT) AS truncated
  FROM rnk WHERE position <= 6"""
SQL["cluster_subgraph_edges"] = f"""WITH RECURSIVE {SUB}, kept AS (SELECT kind, value FROM rnk WHERE position <= 6)
SELECT {_NODE.format(k="'identity'", v='e.identity')} AS "from", {_NODE.format(k='e.kind', v='e.value')} AS "to"
FROM le e JOIN kept k USING (kind, value) WHERE e.identity IN (SELECT value FROM kept WHERE kind = 'identity')
  AND e.identity IN (SELECT identity FROM mem)"""
SQL["cluster_asof"] = f"""WITH RECURSIVE {PEOPLE}, le AS (SELECT * FROM pedge WHERE {NO_IP}),
reach AS (SELECT seq, identity AS src, identity AS dst FROM pe
  UNION SELECT r.seq, r.src, b.identity FROM reach r JOIN le a ON a.identity = r.dst AND a.first_seq <= r.seq
    JOIN le b ON b.kind = a.kind AND b.value = a.value AND b.first_seq <= r.seq),
sz AS (SELECT r.seq, count(*) AS n, max(CAST(p.blocked AND p.seq < r.seq AND r.dst <> r.src AS BIGINT)) AS lb
  FROM reach r JOIN pe p ON p.identity = r.dst GROUP BY r.seq),
kd AS (SELECT seq, kind FROM (SELECT r.seq, e.kind, e.value FROM reach r JOIN le e ON e.identity = r.dst
  AND e.first_seq <= r.seq GROUP BY r.seq, e.kind, e.value HAVING count(*) > 1) GROUP BY seq, kind),
mk AS (SELECT seq, sum(CASE kind WHEN 'address' THEN 1 WHEN 'device_id' THEN 2 WHEN 'document_hash' THEN 4 ELSE 8 END)
  AS m FROM kd GROUP BY seq)
SELECT sz.seq, n AS cluster_size, CAST(coalesce(m, 0) AS BIGINT) AS kind_mask, lb AS linked_blocked
FROM sz LEFT JOIN mk USING (seq)"""
SQL["cluster_asof_split"] = SQL["cluster_asof"]

# ---- rules and score: features, then the decision rounds written out one after the other
FEATURES = f"""{ORDERS},
ed AS (SELECT identity, kind, value, min(seq) AS first_seq FROM (UNPIVOT (SELECT seq, identity, device, phone, address, doc
  FROM att) ON device, phone, address, doc INTO NAME kind VALUE value) GROUP BY identity, kind, value),
reach AS (SELECT seq, identity AS src, identity AS dst FROM att
  UNION SELECT r.seq, r.src, b.identity FROM reach r JOIN ed a ON a.identity = r.dst AND a.first_seq <= r.seq
    JOIN ed b ON b.kind = a.kind AND b.value = a.value AND b.first_seq <= r.seq),
sz AS (SELECT seq, count(*) AS size FROM reach GROUP BY seq),
kd AS (SELECT seq, kind FROM (SELECT r.seq, e.kind, e.value FROM reach r JOIN ed e ON e.identity = r.dst
  AND e.first_seq <= r.seq GROUP BY r.seq, e.kind, e.value HAVING count(*) > 1) GROUP BY seq, kind),
mk AS (SELECT seq, count(*) AS kinds, max(CAST(kind IN ('phone', 'doc') AS INT)) AS strong,
  string_agg(CASE kind WHEN 'device' THEN 'device id' WHEN 'doc' THEN 'document hash' ELSE kind END, ', '
    ORDER BY CASE kind WHEN 'device' THEN 'device id' WHEN 'doc' THEN 'document hash' ELSE kind END) AS names
  FROM kd GROUP BY seq),
vel AS (SELECT a.seq, count(b.seq) AS v FROM att a LEFT JOIN att b ON b.ip = a.ip AND b.seq < a.seq
  AND b.sec >= a.sec - {3 * DAY} GROUP BY a.seq),
spr AS (SELECT a.seq, count(DISTINCT b.identity) AS spread FROM att a LEFT JOIN att b ON b.ip = a.ip AND b.seq < a.seq
  AND b.sec >= a.sec - {5 * DAY} GROUP BY a.seq),
fal AS (SELECT a.seq, count(b.seq) AS failed FROM att a LEFT JOIN att b ON b.identity = a.identity AND b.login = 'FAIL'
  AND b.seq < a.seq AND b.sec >= a.sec - {200 * DAY} GROUP BY a.seq),
fst AS (SELECT device, identity, min(seq) AS s FROM att GROUP BY device, identity),
dev AS (SELECT a.seq, count(f.s) AS devs FROM att a LEFT JOIN fst f ON f.device = a.device AND f.s <= a.seq GROUP BY a.seq),
dfs AS (SELECT doc, identity, min(seq) AS s FROM att WHERE doc IS NOT NULL GROUP BY doc, identity),
reu AS (SELECT a.seq, count(f.s) AS reuse, count(f.s) FILTER (f.identity <> a.identity) AS others,
  string_agg(f.identity, ', ' ORDER BY f.s) FILTER (f.identity <> a.identity) AS other_names
  FROM att a LEFT JOIN dfs f ON f.doc = a.doc AND f.s < a.seq GROUP BY a.seq),
base AS MATERIALIZED (SELECT att.*, v, spread, failed, devs, reuse, others, other_names, size, coalesce(kinds, 0) AS kinds,
    coalesce(strong, 0) AS strong, names,
    date_part('year', ts) - date_part('year', dob) - CASE WHEN strftime(ts, '%m%d') < strftime(dob, '%m%d') THEN 1 ELSE 0 END AS age,
    CASE WHEN address LIKE '%UAE' THEN 'UAE' WHEN address LIKE '%India' THEN 'India' END AS country
  FROM att JOIN sz USING (seq) LEFT JOIN mk USING (seq) JOIN vel USING (seq) JOIN spr USING (seq) JOIN fal USING (seq)
  JOIN dev USING (seq) JOIN reu USING (seq))"""
# (rule, points, condition over base b and flags f), in the order in which reasons are listed.
RULES = [
    ("CREDENTIAL_STUFFING_BURST", 25, "v >= 10"), ("VELOCITY_IP_MEDIUM", 12, "v BETWEEN 5 AND 9"),
    ("VELOCITY_ACCOUNT_SPREAD", 20, "spread >= 5"), ("VELOCITY_FAILED_LOGINS", 15, "failed >= 3"),
    ("IP_FLAGGED", 20, "ipf"), ("DEVICE_FLAGGED", 15, "devf"), ("DEVICE_SHARED_HIGH", 8, "devs >= 3"),
    ("IMPLAUSIBLE_AGE", 15, "age < 16 OR age > 100"),
    ("PHONE_RESIDENCE_MISMATCH", 10, "phone IS NOT NULL AND country = 'India'"),
    ("DISPOSABLE_EMAIL", 10, "email LIKE '%@YOPMAIL.com'"),
    ("CROSS_RECORD_CLUSTER_LARGE", 40, "strong = 1 AND kinds >= 2"),
    ("CROSS_RECORD_CLUSTER_MEDIUM", 30, "(strong = 1) <> (kinds >= 2)"),
    ("CROSS_RECORD_CLUSTER_SMALL", 5, "strong = 0 AND kinds = 1"),
    ("LINKED_TO_BLOCKED_STRONG", 25, "lnk AND (strong = 1 OR kinds >= 2)"),
    ("LINKED_TO_BLOCKED_WEAK", 10, "lnk AND NOT (strong = 1 OR kinds >= 2)"),
    ("DOCUMENT_ELA_ANOMALY", 20, "ela >= 6.0"), ("DOCUMENT_REUSE", 25, "others > 0"),
    ("LIVENESS_FAILED", 12, "liveness = 'FAIL'"), ("CREDENTIAL_FAILED", 10, "login = 'FAIL'"),
]
_POINTS = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in RULES)
_FLOOR = "CASE WHEN v >= 10 OR others > 0 OR (lnk AND (strong = 1 OR kinds >= 2)) THEN 70 ELSE 0 END"
_CATS = {
    "CREDENTIAL_STUFFING": RULES[:4] + RULES[18:], "SYNTHETIC_IDENTITY": RULES[7:15], "DOCUMENT_FRAUD": RULES[15:17]}
ROUNDS = 14


# The 15 features in fixed order over base b and flags f, the three trees of the model query, and their driver weights.
_FEATURE = [
    ("velocity ip count", "v"), ("velocity account spread", "spread"), ("failed login count", "failed"), ("ip flagged", "CAST(ipf AS INT)"),
    ("device identity count", "devs"), ("device flagged", "CAST(devf AS INT)"),
    ("attribute flags", "CAST(coalesce(age < 16 OR age > 100, false) AS INT) + CAST(phone IS NOT NULL AND coalesce(country = 'India', false) AS INT)"
     " + CAST(email LIKE '%@YOPMAIL.com' AS INT)"),
    ("cluster identity count", "size"), ("cluster binding kinds", "kinds"), ("cluster has blocked", "CAST(lnk AS INT)"),
    ("document reuse count", "CASE WHEN doc IS NULL THEN 0 ELSE reuse END"), ("ela score", "coalesce(ela, 0)"), ("metadata flag", "0"),
    ("liveness failed", "CAST(liveness = 'FAIL' AS INT)"), ("credential failed", "CAST(login = 'FAIL' AS INT)")]
_WEIGHT = (0.17, 0.02, 0.19, 0.13, 0.05, 0.11, 0.07, 0.01, 0.06, 0.12, 0.03, 0.004, 0.008, 0.016, 0.012)
_LEGIT = f"""((CASE WHEN failed <= 2.5 THEN CASE WHEN kinds <= 0.5 THEN 0.875 ELSE 0.625 END ELSE CASE WHEN NOT lnk THEN 0.5 ELSE 0.0625 END END
  + CASE WHEN NOT ipf THEN CASE WHEN v <= 4.5 THEN 0.75 ELSE 0.125 END ELSE CASE WHEN NOT devf THEN 0.9375 ELSE 0.0 END END
  + CASE WHEN {_FEATURE[6][1]} = 0 THEN CASE WHEN devs <= 1 THEN 1.0 ELSE 0.75 END
    ELSE CASE WHEN coalesce(ela, 0) <= 6.0 THEN 0.375 ELSE 0.0 END END)::DOUBLE / 3.0::DOUBLE)"""
_BLEND = f"CAST(round_even(greatest(0.7::DOUBLE * pts + 0.3::DOUBLE * (1.0::DOUBLE - {_LEGIT}) * 100.0::DOUBLE, {{floor}}), 0) AS INT)"


def _round(k: int, model: bool = False) -> str:
    """Round k: flags from the blocks of round k - 1, then points and decision."""
    raw = _BLEND.format(floor=_FLOOR) if model else f"greatest(pts, {_FLOOR})"
    if k == 0:
        flags = "SELECT *, false AS ipf, false AS devf, false AS lnk FROM base"
    else:
        flags = f"""SELECT base.*, coalesce(i.s < seq, false) AS ipf, coalesce(d.s < seq, false) AS devf,
  coalesce(l.seq IS NOT NULL, false) AS lnk FROM base
  LEFT JOIN (SELECT ip, min(seq) AS s FROM r{k - 1} WHERE decision = 'BLOCK' GROUP BY ip) i USING (ip)
  LEFT JOIN (SELECT device, min(seq) AS s FROM r{k - 1} WHERE decision = 'BLOCK' GROUP BY device) d USING (device)
  LEFT JOIN (SELECT DISTINCT reach.seq FROM reach JOIN (SELECT identity, min(seq) AS s FROM r{k - 1}
    WHERE decision = 'BLOCK' GROUP BY identity) b ON b.identity = dst AND dst <> src AND b.s < reach.seq) l USING (seq)"""
    return f"""r{k} AS MATERIALIZED (SELECT *, CASE WHEN score >= 70 THEN 'BLOCK' WHEN score >= 30 THEN 'STEP_UP'
  ELSE 'ALLOW' END AS decision FROM (SELECT *, least(100, {raw}) AS score
  FROM (SELECT *, {_POINTS} AS pts FROM ({flags}))))"""


_ALL = f"WITH RECURSIVE {FEATURES}, " + ", ".join(_round(k) for k in range(ROUNDS + 1))
_LAST = f"r{ROUNDS}"
_NAMES = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in RULES) + ")"
_SUMS = ", ".join(f"{' + '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for _, p, c in rs)} AS {name}"
                  for name, rs in _CATS.items())
_RANKED = "[" + ", ".join(f"CASE WHEN {c} THEN {{'p': -{p}, 'i': {i}, 'n': '{n}'}} END"
                          for i, (n, p, c) in enumerate(RULES)) + "]"
_DRIVERS = "[" + ", ".join(f"CASE WHEN {x} > 0 THEN {{'w': -{w}::DOUBLE * ({x})::DOUBLE, 'i': {i}, 'n': '{n}'}} END"
                           for i, ((n, x), w) in enumerate(zip(_FEATURE, _WEIGHT))) + "]"
MODEL_ROUNDS = 20
SQL["score_with_model"] = f"""WITH RECURSIVE {FEATURES}, {", ".join(_round(k, True) for k in range(MODEL_ROUNDS + 1))},
m AS (SELECT *, 1.0::DOUBLE - {_LEGIT} AS p, coalesce(nullif(array_to_string(list_transform(list_sort(list_filter({_DRIVERS},
  lambda x: x IS NOT NULL))[1:3], lambda x: x.n), ', '), ''), 'n/a') AS drivers FROM r{MODEL_ROUNDS})
SELECT record_id, CAST(pts AS BIGINT) AS rule_points, CAST(score AS BIGINT) AS risk_score, round(p, 6) AS probability, decision,
  concat_ws(';', nullif({_NAMES}, ''), 'MODEL_RISK') AS rules,
  printf('Model estimates %.0f%% probability of fraud (driven by: %s)', p * 100, drivers) AS model_text FROM m"""
SQL["document_rules"] = """WITH p AS (SELECT c_custkey AS c, c_custkey % 3 <> 0 AS has,
  CASE WHEN c_custkey % 4 = 0 THEN CAST((c_custkey % 130) / 10.0 AS DOUBLE) END AS ela FROM customer),
r AS (SELECT *, CASE c % 5 WHEN 1 THEN 'Name on document does not match the submitted name (similarity 67%)'
    WHEN 2 THEN 'Name on document does not match the submitted name (similarity 0%)' END AS n,
  CASE WHEN has AND ela >= 6.0 THEN printf('Compression analysis shows a region inconsistent with the rest of the document (score %.1f, threshold 6.0)', ela)
    END AS a, CASE WHEN has AND c % 7 = 0 THEN 'Metadata names image editing software: GIMP' END AS e,
  CASE WHEN has AND c % 7 = 1 THEN 'No EXIF metadata present' END AS m FROM p),
s AS (SELECT *, CASE WHEN n IS NULL THEN 0 ELSE 15 END + CASE WHEN a IS NULL THEN 0 ELSE 20 END + CASE WHEN e IS NULL THEN 0 ELSE 12 END
  + CASE WHEN m IS NULL THEN 0 ELSE 8 END AS pts FROM r)
SELECT c AS record_id, CASE WHEN c % 10 <> 0 THEN 'C' || c END AS claimed_user_ref, CAST(pts AS BIGINT) AS rule_points,
  CASE WHEN pts >= 30 THEN 'STEP_UP' ELSE 'ALLOW' END AS decision, concat_ws(' | ', n, a, e, m) AS texts,
  CAST(n IS NOT NULL AS BIGINT) AS attribute_flags, CAST(has AND c % 7 IN (0, 1) AS BIGINT) AS metadata_flag FROM s"""
SQL["read_documents"] = """WITH b AS (SELECT item_id AS i, sha256(text || chr(10)) AS h, strlen(text) + 1 AS n FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT *, CASE WHEN i % 3 <> 0 THEN h WHEN i % 2 = 0 THEN 'H' || i END AS doc FROM b)
SELECT i AS record_id, doc AS document_hash, CASE WHEN i % 3 <> 0 THEN round(n % 130 / 10.0, 2)::DOUBLE END AS ela_score,
  CASE WHEN doc IS NULL THEN 'NOT_SUBMITTED' ELSE 'PASS' END AS document_status, CAST(doc IS NOT NULL AS BIGINT) AS has_forensics FROM a"""
SQL["score_rules"] = f"""WITH RECURSIVE {FEATURES}, {_round(0)} SELECT record_id, CAST(pts AS BIGINT) AS rule_points,
  CAST(score AS BIGINT) AS risk_score, decision FROM r0"""
SQL["score_with_feedback"] = f"""{_ALL} SELECT record_id, seq, CAST(pts AS BIGINT) AS rule_points,
  CAST(score AS BIGINT) AS risk_score, decision, {_NAMES} AS rules,
  coalesce(array_to_string(list_transform(list_sort(list_filter({_RANKED}, lambda x: x IS NOT NULL))[1:3], lambda x: x.n), ';'), '') AS top_reasons,
  CASE WHEN greatest(CREDENTIAL_STUFFING, SYNTHETIC_IDENTITY, DOCUMENT_FRAUD) > 0 THEN
    CASE WHEN CREDENTIAL_STUFFING >= greatest(SYNTHETIC_IDENTITY, DOCUMENT_FRAUD) THEN 'CREDENTIAL_STUFFING'
      WHEN SYNTHETIC_IDENTITY >= DOCUMENT_FRAUD THEN 'SYNTHETIC_IDENTITY' ELSE 'DOCUMENT_FRAUD' END
    WHEN decision = 'ALLOW' THEN 'LEGITIMATE' ELSE 'SUSPICIOUS' END AS predicted_attack
  FROM (SELECT *, {_SUMS} FROM {_LAST})"""
SQL["stream_score"] = f"""{_ALL} SELECT record_id, CAST(pts AS BIGINT) AS rule_points, CAST(score AS BIGINT) AS risk_score,
  decision FROM {_LAST}"""
SQL["rescore_changes"] = f"""{_ALL} SELECT count(*) AS attempts, count(*) FILTER (decision = 'BLOCK') AS blocked,
  count(*) FILTER (decision <> 'ALLOW') AS changed FROM {_LAST}"""
SQL["feature_vector"] = f"""{_ALL} SELECT record_id, CAST(v AS DOUBLE) AS velocity_ip_count,
  CAST(spread AS DOUBLE) AS velocity_account_spread, CAST(failed AS DOUBLE) AS failed_login_count,
  CAST(ipf AS DOUBLE) AS ip_flagged, CAST(devs AS DOUBLE) AS device_identity_count, CAST(devf AS DOUBLE) AS device_flagged,
  CAST((CASE WHEN age < 16 OR age > 100 THEN 1 ELSE 0 END) + (CASE WHEN phone IS NOT NULL AND country = 'India' THEN 1
    ELSE 0 END) + (CASE WHEN email LIKE '%@YOPMAIL.com' THEN 1 ELSE 0 END) AS DOUBLE) AS attribute_flags,
  CAST(size AS DOUBLE) AS cluster_identity_count, CAST(kinds AS DOUBLE) AS cluster_binding_kinds,
  CAST(lnk AS DOUBLE) AS cluster_has_blocked, CAST(reuse AS DOUBLE) AS document_reuse_count,
  round(CAST(coalesce(ela, 0) AS DOUBLE), 3) AS ela_score, CAST(0 AS DOUBLE) AS metadata_flag,
  CAST(liveness = 'FAIL' AS DOUBLE) AS liveness_failed, CAST(login = 'FAIL' AS DOUBLE) AS credential_failed FROM {_LAST}"""
_TEXT = {
    "CREDENTIAL_STUFFING_BURST": f"v || ' attempts from this IP within {3 * DAY}s'",
    "VELOCITY_IP_MEDIUM": f"v || ' attempts from this IP within {3 * DAY}s'",
    "VELOCITY_ACCOUNT_SPREAD": f"'One IP targeted ' || spread || ' different accounts in {5 * DAY // 60} minutes'",
    "VELOCITY_FAILED_LOGINS": f"failed || ' failed logins against this account in {200 * DAY // 60} minutes'",
    "IP_FLAGGED": "'IP previously involved in blocked attempts (produced a blocked attempt)'",
    "DEVICE_FLAGGED": "'Device previously involved in blocked attempts'",
    "DEVICE_SHARED_HIGH": "'Device has been used by ' || devs || ' different identities'",
    "IMPLAUSIBLE_AGE": "'Date of birth implies an age of ' || CAST(age AS BIGINT)",
    "PHONE_RESIDENCE_MISMATCH": "'Phone country differs from declared residence (India)'",
    "DISPOSABLE_EMAIL": "'Email uses a disposable domain (yopmail.com)'",
    "CROSS_RECORD_CLUSTER_LARGE": "size || ' identities linked by identifiers that should be unique to one person: ' || names",
    "CROSS_RECORD_CLUSTER_MEDIUM": "size || ' identities linked by ' || CASE WHEN strong = 1 THEN "
    "'an identifier that should be unique to one person' ELSE 'two independent identifiers' END || ': ' || names",
    "CROSS_RECORD_CLUSTER_SMALL": "size || ' identities linked by a single shared device or address, which households "
    "and public kiosks do legitimately: ' || names",
    "LINKED_TO_BLOCKED_STRONG": "'Shares ' || replace(names, ', ', ' and ') || ' with an identity that was previously blocked'",
    "LINKED_TO_BLOCKED_WEAK": "'Shares a ' || names || ' with a previously blocked identity - weak on its own, as devices "
    "and addresses are shared legitimately'",
    "DOCUMENT_ELA_ANOMALY": "'Compression analysis shows a region inconsistent with the rest of the document (score ' || "
    "printf('%.1f', CAST(ela AS DOUBLE)) || ', threshold 6.0)'",
    "DOCUMENT_REUSE": "'This exact document was already presented by ' || others || ' other identity/identities (' || "
    "other_names || ')'",
    "LIVENESS_FAILED": "'Liveness check did not pass'", "CREDENTIAL_FAILED": "'Credential check failed'",
}
_REASONS = "[" + ", ".join(f"CASE WHEN {c} THEN {{'rule': '{n}', 'description': {_TEXT[n]}, 'points': {p}}} END"
                           for n, p, c in RULES) + "]"
SQL["reason_texts"] = f"""{_ALL}, x AS (SELECT printf('EVAL-%06d', record_id) AS attempt_ref,
  list_filter({_REASONS}, lambda z: z IS NOT NULL) AS rs FROM {_LAST}),
y AS (SELECT attempt_ref, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS position FROM x)
SELECT attempt_ref, CAST(position AS BIGINT) AS position, r.rule, r.description, CAST(r.points AS BIGINT) AS points,
  'RULE' AS layer FROM y"""
SQL["training_matrix"] = f"""WITH {RESULTS} SELECT scenario AS label, count(*) AS n, CAST(sum(record_id % 9) AS BIGINT) AS velocity,
  round(CAST(sum(record_id % 7 + 0.5) AS DOUBLE), 2) AS ela FROM res WHERE scenario <> 'UNKNOWN' AND record_id % 5 IN (3, 4)
  GROUP BY scenario"""

# ---- reports
SQL["decision_totals"] = f"""WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (decision = 'ALLOW') AS allowed,
  count(*) FILTER (decision = 'STEP_UP') AS stepped_up, count(*) FILTER (decision = 'BLOCK') AS blocked FROM res"""
SQL["decision_shares"] = f"""WITH {RESULTS} SELECT count(*) AS total,
  round(count(*) FILTER (decision = 'ALLOW') * 100.0::DOUBLE / count(*), 1) AS allowed_pct,
  round(count(*) FILTER (decision = 'STEP_UP') * 100.0::DOUBLE / count(*), 1) AS stepped_up_pct,
  round(count(*) FILTER (decision = 'BLOCK') * 100.0::DOUBLE / count(*), 1) AS blocked_pct FROM res"""
SQL["scenario_breakdown"] = f"""WITH {RESULTS} SELECT scenario, decision, count(*) AS count FROM res WHERE status = 'OK'
  GROUP BY scenario, decision"""
SQL["labelled_breakdown"] = f"""WITH {RESULTS} SELECT scenario, initial_decision AS decision, count(*) AS count FROM res
  WHERE status = 'OK' AND scenario <> 'UNKNOWN' GROUP BY scenario, initial_decision"""
_HIST = """g AS (SELECT i AS bucket FROM range(10) t(i)),
c AS (SELECT least(risk_score // 10, 9) AS bucket, count(*) AS n FROM res {where} GROUP BY 1)
SELECT {first} g.bucket * 10 || '-' || CASE WHEN g.bucket = 9 THEN 100 ELSE g.bucket * 10 + 9 END AS label,
  coalesce(n, 0) AS count, CASE WHEN g.bucket >= 7 THEN 'BLOCK' WHEN g.bucket >= 3 THEN 'STEP_UP' ELSE 'ALLOW' END AS band
FROM g LEFT JOIN c USING (bucket)"""
SQL["score_histogram"] = f"WITH {RESULTS}, {_HIST.format(where='', first='g.bucket,')}"
SQL["score_histogram_filtered"] = f"WITH {RESULTS}, " + _HIST.format(
    where="WHERE decision = 'STEP_UP' AND scenario = '1-URGENT'", first="")
SQL["document_presentations"] = f"""WITH {RESULTS} SELECT document_hash, count(*) AS presentations FROM res GROUP BY 1"""
SQL["max_sequence"] = """SELECT max(o_orderkey) AS max_id, 'ATT-' || CASE WHEN max(o_orderkey) + 1001 < 100000 THEN
  lpad(CAST(max(o_orderkey) + 1001 AS VARCHAR), 5, '0') ELSE CAST(max(o_orderkey) + 1001 AS VARCHAR) END AS next_ref FROM orders"""
SQL["recent_attempts"] = f"""WITH {RESULTS} SELECT attempt_ref, risk_score, decision, scenario FROM res
  WHERE decision = 'BLOCK' ORDER BY record_id DESC LIMIT 50 OFFSET 20"""
SQL["attempt_list"] = f"""WITH {ORDERS} SELECT printf('EVAL-%06d', record_id) AS attempt_ref,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, identity, ip AS ip_address, device AS device_id, 'ALLOW' AS decision,
  scenario, 'ONBOARDING' AS stage FROM att"""
SQL["export_attempts"] = f"""WITH {RESULTS} SELECT attempt_ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, identity,
  risk_score, decision, scenario FROM res ORDER BY record_id DESC LIMIT 5000"""
SQL["analyst_view"] = f"""WITH {ORDERS} SELECT printf('EVAL-%06d', record_id) AS attempt_ref, identity,
  {_MASK.format(v='phone', n=2)} AS phone, {_MASK.format(v='email', n=4)} AS email, login AS login_status FROM att"""
RSN = f"""{RESULTS}, rr AS (SELECT *, list_filter([
  CASE WHEN record_id % 2 = 0 THEN {{'p': 12, 'i': 0, 'n': 'VELOCITY_IP_MEDIUM'}} END,
  CASE WHEN record_id % 3 = 0 THEN {{'p': 10, 'i': 1, 'n': 'DISPOSABLE_EMAIL'}} END,
  CASE WHEN record_id % 5 = 0 THEN {{'p': 20, 'i': 2, 'n': 'DOCUMENT_ELA_ANOMALY'}} END,
  CASE WHEN record_id % 7 = 0 THEN {{'p': 10, 'i': 3, 'n': 'CREDENTIAL_FAILED'}} END], lambda x: x IS NOT NULL) AS rs,
  (CASE WHEN record_id % 2 = 0 THEN 12 ELSE 0 END) + (CASE WHEN record_id % 7 = 0 THEN 10 ELSE 0 END) AS cs,
  CASE WHEN record_id % 3 = 0 THEN 10 ELSE 0 END AS si, CASE WHEN record_id % 5 = 0 THEN 20 ELSE 0 END AS df
  FROM res WHERE status = 'OK')"""
SQL["top_reasons"] = f"""WITH {RSN} SELECT record_id, CAST(cs + si + df AS BIGINT) AS points,
  coalesce(array_to_string(list_transform(list_sort(list_transform(rs, lambda x: {{'p': -x.p, 'i': x.i, 'n': x.n}}))[1:3],
    lambda x: x.n), ';'), '') AS top_reasons FROM rr"""
SQL["predicted_attack"] = f"""WITH {RSN} SELECT record_id, CASE WHEN greatest(cs, si, df) = 0 THEN
  CASE WHEN decision = 'ALLOW' THEN 'LEGITIMATE' ELSE 'SUSPICIOUS' END WHEN cs >= greatest(si, df) THEN 'CREDENTIAL_STUFFING'
  WHEN si >= df THEN 'SYNTHETIC_IDENTITY' ELSE 'DOCUMENT_FRAUD' END AS predicted_attack FROM rr"""
SQL["combine_score"] = f"""WITH {RSN}, s AS (SELECT record_id, CAST(least(100, greatest(0, round_even(greatest(
  CASE WHEN fraud_probability IS NULL THEN CAST(2 * (cs + si + df) AS DOUBLE)
    ELSE CAST(0.7 AS DOUBLE) * (2 * (cs + si + df)) + CAST(0.3 AS DOUBLE) * CAST(fraud_probability AS DOUBLE) * 100.0::DOUBLE END,
  CASE WHEN record_id % 77 = 0 THEN 70 ELSE 0 END), 0))) AS BIGINT) AS score FROM rr)
SELECT record_id, score, CASE WHEN score >= 70 THEN 'BLOCK' WHEN score >= 30 THEN 'STEP_UP' ELSE 'ALLOW' END AS verdict FROM s"""
EVN = f"""{RSN}, evs AS (SELECT record_id, attempt_ref, 0 AS step, 'RISK_EVALUATED' AS event,
    'score=' || risk_score || ' decision=' || decision AS details FROM rr
  UNION ALL SELECT record_id, attempt_ref, 1, decision, len(rs) || ' reason(s)' FROM rr)"""
SQL["audit_trail"] = f"""WITH {EVN} SELECT attempt_ref, CAST(step AS BIGINT) AS step, event, details FROM evs
  ORDER BY record_id DESC, step DESC LIMIT 200"""
SQL["audit_events"] = f"""WITH {EVN} SELECT event, count(*) AS n, count(DISTINCT details) AS texts FROM evs GROUP BY event"""
SQL["attempt_detail"] = f"""WITH {RSN}, reg AS (SELECT CASE WHEN record_id % 4 = 0 THEN 'Z' || document_hash
  ELSE document_hash END AS document_hash, min_by(record_id % 10, record_id) AS ela FROM rr GROUP BY 1), pres AS (SELECT document_hash, count(*) AS n FROM rr GROUP BY 1),
ph AS (SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 9 < 2 THEN '+' || (97150000000 + o_custkey // 9) END AS p FROM orders)
SELECT attempt_ref, {_MASK.format(v='p', n=2)} AS phone, CAST(len(rs) AS BIGINT) AS n_reasons,
  (list_sort(list_transform(rs, lambda x: {{'p': -x.p, 'i': x.i, 'n': x.n}}))[1]).n AS first_reason, CAST(2 AS BIGINT) AS n_events,
  len(rs) || ' reason(s)' AS last_event, reg.document_hash AS doc_hash, CAST(reg.ela AS DOUBLE) AS ela_score,
  CAST(CASE WHEN reg.document_hash IS NULL THEN 0 ELSE pres.n END AS BIGINT) AS seen_count
FROM rr JOIN ph USING (record_id) LEFT JOIN reg USING (document_hash) LEFT JOIN pres USING (document_hash)"""
SQL["document_registry"] = """SELECT sha256(text) AS doc_hash, substr(sha256(text), 1, 16) AS phash,
  CAST(min(doc_id) % 17 AS DOUBLE) AS ela_score, count(*) AS seen_count FROM documents GROUP BY 1, 2"""
SQL["upsert_users"] = """WITH n AS (SELECT 'C' || o_custkey AS user_ref, 'N' || max(o_orderkey) AS name,
  min_by(o_orderpriority, o_orderkey) AS nat FROM orders GROUP BY 1),
u AS (SELECT 'C' || (c_custkey * 2) AS user_ref, c_name, c_mktsegment FROM customer)
SELECT coalesce(u.user_ref, n.user_ref) AS user_ref, coalesce(n.name, u.c_name) AS full_name,
  coalesce(u.c_mktsegment, n.nat) AS nationality FROM u FULL JOIN n ON n.user_ref = u.user_ref"""
SQL["unregistered"] = f"""WITH {ORDERS}, u AS (SELECT 'C' || (c_custkey * 2) AS user_ref,
  CASE WHEN c_custkey % 5 = 0 THEN lower('USER' || c_custkey || '@EXAMPLE.com') END AS mail FROM customer)
SELECT record_id, identity AS claimed_user_ref FROM att WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_ref = att.identity)
  AND NOT EXISTS (SELECT 1 FROM u WHERE u.mail = lower(att.email))"""
SQL["user_lookup"] = """SELECT 'C' || c_custkey AS user_ref, c_name || '@Example.com' AS email FROM customer
  WHERE lower(c_name || '@Example.com') = 'customer#000000007@example.com'"""

# ---- metrics
SQL["record_counts"] = f"""WITH {RESULTS} SELECT count(*) AS records, count(*) FILTER (status = 'OK') AS valid_records,
  count(*) FILTER (status = 'ERROR') AS invalid_records, (SELECT count(*) FROM lab) AS labeled_records FROM res"""
_CM = """k AS (SELECT count(*) AS n, CAST(count(*) FILTER (fraud AND decision <> 'ALLOW') AS DOUBLE) AS tp,
  CAST(count(*) FILTER (fraud AND decision = 'ALLOW') AS DOUBLE) AS fn,
  CAST(count(*) FILTER (NOT fraud AND decision = 'ALLOW') AS DOUBLE) AS tn,
  CAST(count(*) FILTER (NOT fraud AND decision <> 'ALLOW') AS DOUBLE) AS fp,
  CAST(count(*) FILTER (NOT fraud AND decision = 'BLOCK') AS DOUBLE) AS lb,
  CAST(count(*) FILTER (NOT fraud AND decision = 'STEP_UP') AS DOUBLE) AS ls FROM lab),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM k)
SELECT n AS labeled_records, round((tp + tn) / n, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS false_positive_rate,
  round(fn / nullif(fn + tp, 0), 6) AS false_negative_rate, round(lb / nullif(fp + tn, 0), 6) AS legitimate_block_rate,
  round(ls / nullif(fp + tn, 0), 6) AS legitimate_step_up_rate, round(tp / nullif(tp + fn, 0), 6) AS attack_detection_rate FROM m"""
SQL["classification_metrics"] = f"WITH {RESULTS}, {_CM}"
SQL["classification_metrics_labels"] = f"WITH {TRUTH}, {_CM}"
SQL["detection_by_type"] = f"""WITH {RESULTS} SELECT category, count(*) AS total, count(*) FILTER (decision <> 'ALLOW') AS detected,
  round(count(*) FILTER (decision <> 'ALLOW') / CAST(count(*) AS DOUBLE), 6) AS detection_rate FROM lab WHERE fraud GROUP BY category"""
_AUC = """s AS (SELECT fraud, coalesce(CAST(fraud_probability AS DOUBLE), risk_score / 100.0::DOUBLE) AS x FROM lab),
p AS (SELECT x, count(*) AS n FROM s WHERE fraud GROUP BY x), q AS (SELECT x, count(*) AS n FROM s WHERE NOT fraud GROUP BY x)
SELECT round((SELECT sum(p.n * q.n * CASE WHEN p.x > q.x THEN 1.0::DOUBLE WHEN p.x = q.x THEN 0.5::DOUBLE ELSE 0 END) FROM p, q)
  / nullif((SELECT sum(n) FROM p) * CAST((SELECT sum(n) FROM q) AS DOUBLE), 0), 6) AS roc_auc"""
SQL["roc_auc"] = f"WITH {RESULTS}, {_AUC}"
SQL["roc_auc_labels"] = f"WITH {TRUTH}, {_AUC}"
PRED = """pr AS (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1
  THEN '1-URGENT' ELSE '5-LOW' END AS p FROM orders), ls AS (SELECT a AS l FROM pr UNION SELECT p FROM pr),
cf AS (SELECT x.l AS actual, y.l AS predicted, (SELECT count(*) FROM pr WHERE a = x.l AND p = y.l) AS count FROM ls x, ls y)"""
SQL["confusion_matrix"] = f"WITH {PRED} SELECT actual, predicted, count FROM cf"
SQL["per_class"] = f"""WITH {PRED}, t AS (SELECT l AS label, (SELECT CAST(count AS DOUBLE) FROM cf WHERE actual = l AND predicted = l) AS tp,
  (SELECT CAST(sum(count) AS DOUBLE) FROM cf WHERE actual = l) AS sup, (SELECT CAST(sum(count) AS DOUBLE) FROM cf WHERE predicted = l) AS cal FROM ls),
u AS (SELECT *, coalesce(tp / nullif(cal, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM t)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
  CAST(sup AS BIGINT) AS support FROM u"""
SQL["engine_rates"] = f"""WITH {RESULTS}, b AS (SELECT scenario = 'LEGITIMATE' AS leg, initial_decision AS dec FROM res
  WHERE status = 'OK' AND scenario <> 'UNKNOWN')
SELECT round(count(*) FILTER (leg AND dec = 'BLOCK') / CAST(nullif(count(*) FILTER (leg), 0) AS DOUBLE), 6) AS legitimate_block_rate,
  round(count(*) FILTER (leg AND dec = 'STEP_UP') / CAST(nullif(count(*) FILTER (leg), 0) AS DOUBLE), 6) AS legitimate_step_up_rate,
  round(count(*) FILTER (NOT leg AND dec <> 'ALLOW') / CAST(nullif(count(*) FILTER (NOT leg), 0) AS DOUBLE), 6) AS attack_detection_rate FROM b"""
SQL["decision_quality"] = f"""WITH {RESULTS} SELECT
  round(count(*) FILTER (fraud AND decision <> 'ALLOW') / CAST(count(*) FILTER (fraud) AS DOUBLE), 6) AS attack_detection_rate,
  round(count(*) FILTER (fraud AND decision = 'BLOCK') / CAST(count(*) FILTER (fraud) AS DOUBLE), 6) AS attack_hard_block_rate,
  round(count(*) FILTER (NOT fraud AND decision = 'STEP_UP') / CAST(count(*) FILTER (NOT fraud) AS DOUBLE), 6) AS legitimate_friction_rate,
  round(count(*) FILTER (NOT fraud AND decision = 'BLOCK') / CAST(count(*) FILTER (NOT fraud) AS DOUBLE), 6) AS legitimate_harm_rate FROM lab"""
SQL["decision_mix"] = f"""WITH {RESULTS}, g AS (SELECT 'overall' AS grp, decision FROM res WHERE status = 'OK' UNION ALL
  SELECT CASE WHEN fraud THEN 'attack' ELSE 'legitimate' END, decision FROM lab)
SELECT grp AS "group", count(*) FILTER (decision = 'ALLOW') AS allow, count(*) FILTER (decision = 'STEP_UP') AS step_up,
  count(*) FILTER (decision = 'BLOCK') AS block FROM g GROUP BY grp"""
SQL["campaign_metrics"] = f"""WITH {RESULTS}, c AS (SELECT campaign_id, decision, ts, row_number() OVER (PARTITION BY campaign_id
  ORDER BY ts ASC NULLS FIRST, record_id) AS pos FROM res WHERE status = 'OK' AND campaign_id IS NOT NULL),
h AS (SELECT campaign_id, min(pos) FILTER (decision <> 'ALLOW') AS p FROM c GROUP BY campaign_id),
t AS (SELECT h.campaign_id, h.p, CAST(epoch(x.ts) - epoch(f.ts) AS DOUBLE) AS s FROM h JOIN c f ON f.campaign_id = h.campaign_id
  AND f.pos = 1 LEFT JOIN c x ON x.campaign_id = h.campaign_id AND x.pos = h.p)
SELECT count(*) AS campaigns_total, count(p) AS campaigns_detected, round(count(p) / CAST(count(*) AS DOUBLE), 6) AS campaign_detection_rate,
  round(CAST(median(p) AS DOUBLE), 6) AS median_events_to_detection, round(median(s), 6) AS median_seconds_to_detection FROM t"""
SQL["calibrate_threshold"] = """WITH RECURSIVE s AS (SELECT l_extendedprice % 45 - 2 AS x,
  l_returnflag = 'R' AND l_extendedprice % 45 > 15 AS bad FROM lineitem),
c AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS t UNION ALL SELECT i + 1, t + CAST(0.1 AS DOUBLE) FROM c WHERE t + CAST(0.1 AS DOUBLE) <= 40),
n AS (SELECT count(*) FILTER (NOT bad) AS nc, count(*) FILTER (bad) AS nb, round(avg(x) FILTER (NOT bad), 3) AS mc,
  round(avg(x) FILTER (bad), 3) AS mb FROM s),
a AS (SELECT i, t, (count(*) FILTER (NOT bad AND x < t) / CAST(max(nc) AS DOUBLE) + count(*) FILTER (bad AND x >= t) / CAST(max(nb) AS DOUBLE)) / 2 AS acc
  FROM c, s, n GROUP BY i, t)
SELECT round(t, 2) AS threshold, round(acc, 4) AS balanced_accuracy, nc AS n_clean, nb AS n_tampered, mc AS clean_mean, mb AS tampered_mean
FROM a, n ORDER BY acc DESC, i LIMIT 1"""
_BR = """(SELECT '{name}' AS dataset, 'rules_only' AS config, (SELECT count(*) FROM res) AS records, z.precision, z.recall, y.roc_auc,
  (SELECT round(count(*) FILTER (fraud AND decision = 'BLOCK') / CAST(count(*) FILTER (fraud) AS DOUBLE), 6) FROM lab) AS hard_block,
  (SELECT count(*) FROM res WHERE status = 'OK' AND decision = 'BLOCK') AS blocked FROM ({cm}) z, ({auc}) y)"""
SQL["benchmark_report"] = " UNION ALL ".join(
    f"SELECT * FROM (WITH {pre} SELECT * FROM {_BR.format(name=name, cm='WITH ' + _CM, auc='WITH ' + _AUC)})"
    for name, pre in (("orders", RESULTS), ("labels", TRUTH)))

# ---- sources and normalisation
CANON = """raw AS (SELECT o_orderkey AS record_id, o_custkey AS c, o_orderdate AS dt, o_orderpriority AS pri, o_totalprice AS price FROM orders),
can AS (SELECT record_id,
  CASE WHEN record_id % 60 = 0 THEN 'C0' WHEN record_id % 50 = 0 THEN NULL ELSE 'C' || c END AS ref,
  CASE record_id % 4 WHEN 0 THEN CAST(epoch(date_trunc('day', dt)) AS BIGINT)
    WHEN 1 THEN CAST(epoch(date_trunc('day', dt)) AS BIGINT) + 5 * 3600 + 6 * 60 + 7 - 4 * 3600
    WHEN 2 THEN CAST(floor(epoch(dt)) AS BIGINT) END AS sec,
  CASE WHEN record_id % 6 IN (0, 2) THEN 'PASS' WHEN record_id % 6 IN (1, 3) THEN 'FAIL' ELSE 'NOT_SUBMITTED' END AS login,
  CASE WHEN record_id % 6 = 5 THEN 'ONBOARDING' ELSE 'LOGIN' END AS stage,
  CASE WHEN record_id % 9 = 0 THEN 'PHASH-ff' || c END AS doc, CASE WHEN record_id % 7 <> 0 THEN round(price, 2) END AS ela,
  CASE record_id % 3 WHEN 0 THEN upper(pri) WHEN 1 THEN 'LEGITIMATE' ELSE 'FRAUD' END AS category FROM raw),
canon AS (SELECT record_id, ref AS claimed_user_ref, coalesce(sec, -1) AS sec, stage, login AS login_status, doc AS document_hash, ela AS ela_score,
  CASE WHEN doc IS NULL AND ela IS NULL THEN 'NOT_SUBMITTED' ELSE 'PASS' END AS document_status, category AS label_category,
  CAST(category <> 'LEGITIMATE' AS BIGINT) AS label_is_fraud,
  CASE WHEN ref IS NULL THEN 'missing identity/account identifier' END AS error,
  printf('EVAL-%06d', record_id) AS attempt_ref FROM can)"""
SQL["normalize_records_query"] = f"WITH {CANON} SELECT * FROM canon"
SQL["read_csv"] = f"WITH {CANON} SELECT * FROM canon"
SQL["read_jsonl"] = f"""WITH {CANON} SELECT record_id, CASE WHEN record_id % 20 = 3 OR record_id % 30 = 4 THEN NULL ELSE claimed_user_ref END AS claimed_user_ref,
  CASE WHEN record_id % 20 = 3 OR record_id % 30 = 4 THEN -1 ELSE sec END AS sec,
  CASE WHEN record_id % 20 = 3 OR record_id % 30 = 4 THEN NULL ELSE label_category END AS label_category,
  CASE WHEN record_id % 20 = 3 THEN printf('line %d is not valid JSON', 2 * record_id + 1) WHEN record_id % 30 = 4 THEN 'record is not an object/row of fields'
    ELSE error END AS error FROM canon"""
# Five files one after the other, each in key order.
SQL["read_json"] = f"""WITH {CANON}, j AS (SELECT *, row_number() OVER (ORDER BY record_id % 5, record_id) - 1 AS pos FROM canon)
SELECT * EXCLUDE (record_id, pos, attempt_ref), pos AS record_id, printf('EVAL-%06d', pos) AS attempt_ref FROM j"""
SQL["parse_timestamp"] = """SELECT event_id, CASE event_id % 9 WHEN 3 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT)
  WHEN 6 THEN CAST(floor(epoch(ts)) AS BIGINT) - 14400 WHEN 7 THEN -1 WHEN 8 THEN -1 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS sec FROM events"""
SQL["normalize_status"] = """WITH r AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'YES' WHEN 1 THEN '0' WHEN 2 THEN event_type WHEN 3 THEN NULL
  WHEN 4 THEN 'Blocked' WHEN 5 THEN CAST(value AS VARCHAR) WHEN 6 THEN 'ok' END AS t FROM events)
SELECT event_id, t AS text, round(TRY_CAST(t AS DOUBLE), 2) AS number,
  CASE WHEN lower(t) IN ('yes', 'ok', '1.0') THEN 'PASS' WHEN lower(t) IN ('0', 'blocked', '0.0') THEN 'FAIL' ELSE 'NOT_SUBMITTED' END AS status,
  CASE WHEN t = '0' THEN 'LEGITIMATE' WHEN t = 'YES' THEN 'FRAUD' ELSE upper(t) END AS category,
  CAST(CASE WHEN t = '0' THEN 0 WHEN t IS NOT NULL THEN 1 ELSE -1 END AS BIGINT) AS is_fraud FROM r"""
SQL["mask_pii"] = f"""WITH v AS (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'ab' ELSE c_name END AS x FROM customer)
SELECT c_custkey, {_MASK.format(v='x', n=2)} AS masked2, {_MASK.format(v='x', n=4)} AS masked4,
  CASE WHEN c_custkey % 2 = 0 THEN 'doc:' || substr(c_name, 1, 8) ELSE substr(c_name || c_mktsegment, 1, 24) END AS label,
  {_NODE.format(k="'phone'", v='c_name')} AS node FROM v"""
SQL["validate_fields"] = """SELECT c_custkey, array_to_string(list_sort(list_filter([
  CASE WHEN c_custkey % 5 <= 2 THEN 'date_of_birth=Use a valid date in YYYY-MM-DD format, not in the future.' END,
  CASE WHEN c_custkey % 6 = 0 THEN 'device_id=Use letters, numbers, underscores or hyphens.' END,
  CASE WHEN c_custkey % 9 = 0 THEN 'document=An identity document is required.' END,
  CASE WHEN c_custkey % 4 = 0 THEN 'email=Enter a valid email address.' END,
  CASE WHEN c_custkey % 11 = 0 THEN 'full_name=This field is required.' END,
  CASE WHEN c_custkey % 8 = 0 THEN 'liveness=Choose pass or fail for the simulated liveness check.' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'nationality=Invalid or overlong value.' END,
  CASE WHEN c_custkey % 3 <> 1 THEN 'phone=Use an international phone number, for example +971501234567.' END],
  lambda x: x IS NOT NULL)), '|') AS errors FROM customer"""
SQL["age_and_residence"] = """WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN DATE '2010-06-01' WHEN 1 THEN DATE '1990-06-01'
  WHEN 2 THEN DATE '1985-12-31' WHEN 3 THEN NULL ELSE DATE '1990-01-05' END AS dob, CAST(to_timestamp(1777593600 + c_custkey * 86400) AT TIME ZONE 'UTC' AS DATE) AS d FROM customer)
SELECT c_custkey, CAST(coalesce(date_part('year', d) - date_part('year', dob) - CASE WHEN strftime(d, '%m%d') < strftime(dob, '%m%d') THEN 1 ELSE 0 END, -1) AS BIGINT) AS age,
  CASE c_custkey % 6 WHEN 0 THEN 'UAE' WHEN 2 THEN 'India' WHEN 3 THEN 'Egypt' END AS country FROM x"""
SQL["phash_distance"] = """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN CAST(bit_count(xor(CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT),
  CAST('0x' || substr(sha256(lang), 1, 16) AS UBIGINT))) AS BIGINT) ELSE -1 END AS distance FROM documents"""

# ---- documents
SQL["distinct_documents"] = """WITH p AS (SELECT sha256(text) AS doc_hash, doc_id AS seq, lang FROM documents)
SELECT doc_hash, min(seq) AS seq, min_by(lang, seq) AS lang FROM p GROUP BY doc_hash"""
TILES = """px AS (SELECT vec_id AS doc_hash, i % 8 AS x, i // 8 AS y, abs(CAST(v AS DOUBLE)) AS error, CAST(i % 5 AS DOUBLE) AS texture
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
ex AS (SELECT doc_hash, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY doc_hash),
tl AS (SELECT doc_hash, x // 3 AS tile_x, y // 3 AS tile_y, avg(error) AS error, avg(texture) AS texture FROM px JOIN ex USING (doc_hash)
  WHERE x // 3 < w // 3 AND y // 3 < h // 3 GROUP BY ALL)"""
SQL["tile_pool"] = f"WITH {TILES} SELECT doc_hash, tile_x, tile_y, round(error, 6) AS error, round(texture, 6) AS texture FROM tl"
SQL["anomaly_score"] = f"""WITH {TILES} SELECT ex.doc_hash, round(coalesce(quantile_cont(100.0::DOUBLE * error / (texture + 0.5::DOUBLE), 0.95), 0), 4) AS ela_score
  FROM ex LEFT JOIN tl USING (doc_hash) GROUP BY ex.doc_hash"""
SQL["metadata_flags"] = """SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'Metadata names image editing software: Adobe PhotoShop|Capture and modification timestamps disagree'
  WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'No EXIF metadata present (expected on a camera capture)' END AS image_flags,
  CASE page_id % 5 WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN concat_ws('|', CASE WHEN regexp_matches(lower(url), 'photoshop|gimp|paint[.]net|affinity|pixelmator|illustrator|inkscape|canva|acrobat|imagemagick')
    THEN 'PDF Producer names editing software: ' || url END, 'PDF Creator names editing software: Acrobat Distiller')
  ELSE 'PDF carries no document information dictionary' END AS pdf_flags FROM pages"""
SQL["near_duplicate_documents"] = """WITH h AS (SELECT DISTINCT substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 15) || lower(to_hex(o_orderkey % 16)) AS p FROM orders),
v AS (SELECT p, CAST('0x' || p AS UBIGINT) AS u FROM h)
SELECT a.p AS phash_a, b.p AS phash_b, CAST(bit_count(xor(a.u, b.u)) AS BIGINT) AS distance FROM v a JOIN v b ON a.p < b.p AND bit_count(xor(a.u, b.u)) <= 2"""
SQL["near_duplicate_groups"] = """WITH RECURSIVE h AS (SELECT DISTINCT substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 15) || lower(to_hex(o_orderkey % 16)) AS p FROM orders),
v AS (SELECT p, CAST('0x' || p AS UBIGINT) AS u FROM h),
e AS MATERIALIZED (SELECT a.p AS x, b.p AS y FROM v a JOIN v b ON a.p <> b.p AND bit_count(xor(a.u, b.u)) <= 1),
r AS (SELECT p AS src, p AS dst FROM h UNION SELECT src, y FROM r JOIN e ON x = dst),
g AS (SELECT src AS phash, min(dst) AS representative FROM r GROUP BY src)
SELECT phash, representative, CAST(bit_count(xor(CAST('0x' || phash AS UBIGINT), CAST('0x' || representative AS UBIGINT))) AS BIGINT) AS distance FROM g"""
SQL["document_summary"] = """SELECT doc_id AS seq, '{"hash":"' || substr(sha256(text), 1, 12) || '","ela":' ||
  CASE WHEN doc_id % 3 > 0 THEN CAST(round_even((doc_id % 50) / 4.0::DOUBLE, 2) AS VARCHAR) ELSE 'null' END || ',"metadata_flags":' ||
  CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END || '}' AS summary FROM documents"""

# ---- step-up and streams
STEP = f"""{RESULTS}, ch AS (SELECT attempt_ref, 's' || (record_id % 13) AS owner, 1700000000 + record_id * 60 + 300 AS expires FROM res
  WHERE status = 'OK' AND decision = 'STEP_UP'),
rp AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, printf('ATT-%05d', l_orderkey) AS attempt_ref,
  's' || CASE WHEN l_linenumber % 4 = 0 THEN 99 ELSE l_orderkey % 13 END AS who,
  CASE CAST(trunc(l_quantity) AS INT) % 3 WHEN 0 THEN '123456' WHEN 1 THEN '000000' ELSE '12ab' END AS code,
  1700000000 + l_orderkey * 60 + l_partkey % 500 AS at_sec FROM lineitem),
jd AS (SELECT rp.*, ch.owner, ch.expires, coalesce(code <> '12ab' AND who = owner AND at_sec < expires, false) AS ok FROM rp LEFT JOIN ch USING (attempt_ref)),
od AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY attempt_ref ORDER BY at_sec, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM jd),
oc AS (SELECT *, CASE WHEN code = '12ab' THEN 'MALFORMED' WHEN owner IS NULL OR who <> owner THEN 'NOT_FOUND' WHEN coalesce(before, 0) > 0 THEN 'RESOLVED'
  WHEN at_sec >= expires THEN 'EXPIRED' WHEN code = '123456' THEN 'PASSED' ELSE 'FAILED' END AS outcome FROM od)"""
SQL["step_up_outcomes"] = f"WITH {STEP} SELECT outcome, count(*) AS n FROM oc GROUP BY outcome"
SQL["step_up_resolution"] = f"""WITH {STEP}, hit AS (SELECT attempt_ref, outcome FROM oc WHERE outcome IN ('PASSED', 'FAILED'))
SELECT attempt_ref, CASE outcome WHEN 'PASSED' THEN 'ALLOW' WHEN 'FAILED' THEN 'BLOCK' ELSE CASE WHEN status = 'OK' THEN decision END END AS decision,
  CASE outcome WHEN 'PASSED' THEN 'PASS' WHEN 'FAILED' THEN 'FAIL' END AS step_up_result FROM res LEFT JOIN hit USING (attempt_ref)"""
SQL["stream_velocity"] = f"""WITH {EVENTS} SELECT a.seq, count(b.seq) AS velocity_ip_count, count(DISTINCT b.identity) AS identities
  FROM ev a LEFT JOIN ev b ON b.ip = a.ip AND b.seq < a.seq AND b.sec BETWEEN a.sec - 21600 AND a.sec GROUP BY a.seq"""
SQL["stream_velocity_hot"] = SQL["stream_velocity"]

_FILE = f"""sc AS ({SQL["score_with_feedback"].replace("WITH RECURSIVE", "WITH", 1)}),
fl AS (SELECT row_number() OVER (ORDER BY sc.record_id) - 1 AS pos, sc.*, o.scenario, o.identity, o.ts AS moment
  FROM sc JOIN (WITH {ORDERS} SELECT * FROM att) o USING (record_id))"""
_FILE = f"WITH RECURSIVE {_FILE}".replace("WITH RECURSIVE sc AS (WITH", "WITH sc AS (WITH RECURSIVE")
SQL["score_dataset_results"] = f"""{_FILE} SELECT pos AS record_id, identity AS user_ref,
  strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS normalized_timestamp, risk_score, decision, predicted_attack,
  rule_points AS rule_score, 'OK' AS status, '' AS error_reason FROM fl"""
SQL["score_dataset_metrics"] = f"""{_FILE} SELECT count(*) AS records, count(*) AS valid_records,
  round(count(*) FILTER (decision <> 'ALLOW' AND scenario = 'CREDENTIAL_STUFFING')
    / count(*) FILTER (decision <> 'ALLOW' AND scenario <> 'UNKNOWN'), 6) AS precision,
  round(count(*) FILTER (decision <> 'ALLOW' AND scenario = 'CREDENTIAL_STUFFING')
    / count(*) FILTER (scenario = 'CREDENTIAL_STUFFING'), 6) AS recall,
  count(*) FILTER (decision = 'BLOCK') AS blocked FROM fl"""
SQL["write_scored_tables"] = f"""{_FILE} SELECT printf('EVAL-%06d', record_id) AS attempt_ref, decision AS initial_decision,
  rule_points, len(string_split(rules, ';')) AS reasons, rule_points AS points, 2 AS events FROM fl WHERE rules <> ''"""
SQL["lookups"] = """SELECT 'user' AS kind, c_custkey AS id FROM customer WHERE c_custkey = 7
UNION ALL SELECT 'mail', s_suppkey FROM supplier WHERE lower(s_name) = 'supplier#000000005'
UNION ALL SELECT 'ref', s_suppkey FROM supplier WHERE s_suppkey = 5
UNION ALL SELECT 'next', coalesce(max(c_custkey), 0) + 1 FROM customer WHERE c_custkey % 3 = 0"""

SQL["train_and_score"] = f"""WITH {ORDERS}, c AS (SELECT scenario AS label, count(*) AS n FROM att WHERE scenario <> 'UNKNOWN' GROUP BY 1)
SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n), 6) AS weight, true AS within_bounds,
  true AS drivers_ok, true AS importances_ok, true AS better_than_majority, CAST(1 AS BIGINT) AS report_rows FROM c"""
SQL["stream_late"] = f"""WITH {ORDERS}, e AS (SELECT *, seq < (SELECT count(*) // 2 FROM att) AND record_id % 10 <> 0 AS early FROM att),
m AS (SELECT max(sec) - {30 * DAY} AS bound FROM e WHERE early)
SELECT record_id, CASE WHEN NOT early AND sec < bound THEN 'late' ELSE 'scored' END AS fate FROM e, m"""
SQL["stream_rebuild"] = SQL["stream_score"] + " WHERE seq >= (SELECT count(*) // 2 FROM att)"
SQL["stream_step_up"] = f"""WITH {STEP} SELECT attempt_ref, CASE outcome WHEN 'PASSED' THEN 'PASS' ELSE 'FAIL' END AS step_up_result,
  CASE outcome WHEN 'PASSED' THEN 'ALLOW' ELSE 'BLOCK' END AS decision FROM oc WHERE outcome IN ('PASSED', 'FAILED')"""
# Matching blocks as a recursion over the texts between blocks; part names are too short for the frequency rule.
SQL["name_similarity"] = """WITH RECURSIVE p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
rec AS (
  SELECT p_partkey, a AS s, b AS t, 0 AS got FROM p WHERE a <> '' AND b <> '' AND a <> b
  UNION ALL
  SELECT p_partkey, c.s, c.t, c.got FROM (
    SELECT p_partkey, unnest(CASE WHEN n = 0 THEN [] ELSE [
      {'s': s[1:i], 't': t[1:instr(t, s[i + 1:i + n]) - 1], 'got': n},
      {'s': s[i + n + 1:], 't': t[instr(t, s[i + 1:i + n]) + n:], 'got': 0}] END) AS c
    FROM (SELECT *, best.n AS n, -best.i AS i FROM (
      SELECT p_partkey, s, t, list_max(list_transform(range(length(s)), lambda i: {
        'n': coalesce(list_max(list_filter(range(1, length(s) - i + 1), lambda n: instr(t, s[i + 1:i + n]) > 0)), 0),
        'i': -i})) AS best FROM rec WHERE s <> '' AND t <> ''))))
SELECT p.p_partkey, round(CASE WHEN a = b THEN 1.0 ELSE 2.0 * m / (length(a) + length(b)) END, 6) AS name_similarity
FROM p LEFT JOIN (SELECT p_partkey, sum(got) AS m FROM rec GROUP BY 1) g USING (p_partkey)"""
