import pytest
from pyspark.sql import functions as F

from attestra.functions import clean, names, text
from attestra.operators import documents, validate
from attestra.operators.normalize import normalize_name, resolve_aliases
from attestra.sources import readers, writers


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_bytes(body.encode() if isinstance(body, str) else body)
    return str(p)


def test_csv(spark, tmp_path):
    body = "﻿Account-ID,Event Time,Client IP,Success,Address\r\nA,2026-09-01T09:00:00Z,1.1.1.1,true,\"x, \"\"y\"\"\nz\"\r\n,1,2,no,\r\n"
    rows = readers.read_attempts(spark, put(tmp_path, "a.csv", body)).orderBy("record_id").collect()
    assert [(r["record_id"], r["claimed_user_ref"], r["error"]) for r in rows] == [
        (0, "A", None), (1, None, "missing identity/account identifier")]
    assert rows[0]["address"] == 'x, "y"\nz' and rows[0]["login_status"] == "PASS" and rows[0]["stage"] == "LOGIN"
    assert rows[0]["attempt_ref"] == "EVAL-000000" and rows[1]["login_status"] == "FAIL"
    for body in ("", "a,b\n"):
        with pytest.raises(readers.DatasetError):
            readers.read_raw(spark, put(tmp_path, "bad.csv", body)).count()
    with pytest.raises(readers.DatasetError):
        readers.read_raw(spark, put(tmp_path, "x.xml", "<a/>"))


def test_record_ids_follow_file_order(spark, tmp_path):
    d = tmp_path / "many.csv"
    d.mkdir()
    n = 0
    for part, size in enumerate((3, 50, 7, 1)):
        (d / f"part-{part}.csv").write_text("user_ref\n" + "".join(f"u{n + i}\n" for i in range(size)))
        n += size
    rows = readers.read_raw(spark, str(d)).collect()
    assert sorted((r["record_id"], r["user_ref"]) for r in rows) == [(i, f"u{i}") for i in range(n)]


def test_jsonl(spark, tmp_path):
    body = '{"user_id": "a", "ip": "1.2.3.4", "success": true}\nnot json at all\n\n{"user_id": "c", "dob": null}\n[1]\n{"user_id":"d"} x\n'
    rows = readers.read_attempts(spark, put(tmp_path, "a.jsonl", body)).orderBy("record_id").collect()
    assert [r["error"] for r in rows] == [None, "line 2 is not valid JSON", None, "record is not an object/row of fields",
                                          "line 6 is not valid JSON"]
    assert [r["record_id"] for r in rows] == [0, 1, 2, 3, 4] and rows[0]["login_status"] == "PASS"
    with pytest.raises(readers.DatasetError):
        readers.read_attempts(spark, put(tmp_path, "e.jsonl", "\n \n"))


def test_json(spark, tmp_path):
    good = '{"records": [{"User ID": "a", "time": 1780000000}, 7, {"user_id": "b", "time": 1780000000000, "fraud": 1}]}'
    rows = readers.read_attempts(spark, put(tmp_path, "a.json", good)).orderBy("record_id").collect()
    assert [r["error"] for r in rows] == [None, "record is not an object/row of fields", None]
    assert rows[0]["sec"] == rows[2]["sec"] == 1780000000 and rows[2]["label_category"] == "FRAUD"
    for i, bad in enumerate(("{", '{"a": 1}', "[]", "3", "[1] 2")):
        with pytest.raises(readers.DatasetError):
            readers.read_attempts(spark, put(tmp_path, f"b{i}.json", bad))


def values(spark, items, col):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(col(F.col("c"))).collect()]


def test_cleaning(spark):
    assert values(spark, [None, "", "null", "NaN", "n/a", "  ", " x "], clean.nullify) == [None] * 6 + ["x"]
    assert values(spark, ["True", "1", "yes", "success", "pass", "allowed", "0", "no", "Failure", "blocked", "maybe", None],
                  clean.to_bool) == [True] * 6 + [False] * 4 + [None] * 2
    assert values(spark, ["1.5", "x", " 2 ", "nan"], clean.to_double) == [1.5, None, 2.0, None]
    same = ["2026-09-11T10:30:00Z", "2026-09-11 10:30:00", "2026-09-11T14:30:00+04:00", "2026/09/11 10:30:00"]
    sec = lambda c: F.unix_timestamp(clean.parse_timestamp(c))
    assert len(set(values(spark, same, sec))) == 1
    assert values(spark, ["1780000000", "1780000000000", "not-a-date", "12:30", "2026-13-01", "2026-09-11", ""], sec) == [
        1780000000, 1780000000, None, None, None, 1789084800, None]
    micros = lambda c: F.unix_micros(clean.parse_timestamp(c))
    assert values(spark, ["1970-01-01T00:00:00.5Z", "1970-01-01 00:00:01.000250", "1.25"], micros) == [500000, 1000250, 1250000]
    label = lambda c: F.concat_ws(":", clean.interpret_label(c)["category"], clean.interpret_label(c)["is_fraud"])
    assert values(spark, ["legitimate", "0", "1", "Synthetic_identity", ""], label) == [
        "LEGITIMATE:false", "LEGITIMATE:false", "FRAUD:true", "SYNTHETIC_IDENTITY:true", ""]
    assert normalize_name("  Event - Time ") == "event_time"


def test_aliases_take_the_first_non_empty(spark):
    df = spark.createDataFrame([("n/a", "b", "c")], "`User Ref` string, username string, account string").withColumn(
        "record_id", F.lit(0))
    assert resolve_aliases(df).first()["user_ref"] == "c"


def test_text_functions(spark):
    df = spark.createDataFrame([("2010-06-01", "2026-05-01"), ("2010-06-01", "2026-07-01"), ("1/6/2010", "2026-06-01"),
                                ("x", "2026-06-01")], "dob string, t string")
    assert [r[0] for r in df.select(text.age_at(F.col("dob"), F.to_timestamp("t"))).collect()] == [15, 16, 16, None]
    assert values(spark, ["1 uae rd", "Ukraine", "UK and India", None], text.address_country) == ["UAE", None, "India", None]
    masked = values(spark, ["+971501234567", "ab", None, ""], lambda c: text.mask_pii(c, 2, "k"))
    assert masked[0].startswith("***67#") and masked[1].startswith("***#") and masked[2:] == [None, None]
    pairs = spark.createDataFrame([("00000000000000ff", "0000000000000000"), ("ffffffffffffffff", "0000000000000000"),
                                   (None, "0000000000000000")], "a string, b string")
    assert [r[0] for r in pairs.select(text.phash_distance(F.col("a"), F.col("b"))).collect()] == [8, 64, None]


def test_name_similarity(spark):
    import difflib
    items = [("Sara Ali", "sara ali"), ("Omar Said", "Omer Saeed"), (None, "x"), ("", "x"), ("abcd", "bcde")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(items)], "i int, document_name string, full_name string")
    got = [r["name_similarity"] for r in names.with_name_similarity(df).orderBy("i").collect()]
    want = [difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else None for a, b in items]
    assert got == want
    import random
    r = random.Random(1)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = [(text(r.randint(1, 20), "abc é"), text(r.randint(1, 20), "abc é")) for _ in range(60)]
    # long second texts: frequent characters start no block
    pairs += [(text(40, "abcdefgh" + "e" * 9), text(230, "abcdefghijklmnopqrst" + "e" * 20)) for _ in range(3)]
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.matching_ratio(F.col("a"), F.col("b")))
    assert all(abs(x - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12 for a, b, x in found.collect())


def test_documents(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.jpg").write_bytes(b"one")
    (tmp_path / "docs" / "sub" / "b.jpg").write_bytes(b"one")
    (tmp_path / "outside.jpg").write_bytes(b"two")
    found = {r["path"]: r["doc_hash"] for r in readers.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert set(found) == {"a.jpg", "sub/b.jpg"} and len(set(found.values())) == 1
    hashes = spark.createDataFrame([("0" * 16,), ("0" * 15 + "3",), ("f" + "0" * 15,), ("0" * 16,)], "phash string")
    got = [tuple(r) for r in documents.near_duplicate_documents(hashes, 2).collect()]
    assert got == [("0" * 16, "0" * 15 + "3", 2)]
    px = spark.createDataFrame([("d", x, y, float(x), 1.0) for x in range(5) for y in range(4)] + [("s", 0, 0, 1.0, 1.0)],
                               "doc_hash string, x int, y int, error double, texture double")
    tiles = documents.tile_pool(px, tile=2)
    assert tiles.count() == 4
    score = {r[0]: r[1] for r in documents.anomaly_score(tiles, documents=px).collect()}
    assert score["s"] == 0.0 and abs(score["d"] - 100 * 2.5 / 1.5) < 1e-9


def test_near_duplicates_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    hs = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)})
    df = spark.createDataFrame([(f"{h:016x}",) for h in hs], "phash string")
    for d in (1, 4):
        want = {(f"{a:016x}", f"{b:016x}") for a in hs for b in hs if a < b and bin(a ^ b).count("1") <= d}
        got = [(r[0], r[1]) for r in documents.near_duplicate_documents(df, d).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicate_groups_equal_brute_force(spark):
    import random
    rng = random.Random(4)
    flip = lambda h, n: h ^ sum({1 << rng.randrange(64) for _ in range(n)})
    base = [rng.getrandbits(64) for _ in range(5)]
    hs = {flip(b, 3) for b in base for _ in range(10)} | {base[0] ^ k for k in range(40)} | {rng.getrandbits(64) for _ in range(15)}
    df = spark.createDataFrame([(f"{h:016X}",) for h in hs for _ in range(2)] + [(None,), ("zz",)], "phash string")
    for d, full in ((1, 3), (4, 6), (4, 1000)):
        root = {h: h for h in hs}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in hs:
            for b in hs:
                if bin(a ^ b).count("1") <= d and find(a) != find(b):
                    root[max(find(a), find(b))] = min(find(a), find(b))
        got = {r["phash"]: (r["representative"], r["distance"]) for r in documents.near_duplicate_groups(df, d, full=full).collect()}
        assert got == {f"{h:016x}": (f"{find(h):016x}", bin(h ^ find(h)).count("1")) for h in hs}, (d, full)


def test_validation(spark):
    good = ("Sara Ali", "1990-01-05", "UAE", "+971501234567", "a@b.co", "1 Palm St", "DEV-1", "pass", "id.png")
    bad = ("  ", "1990-1-5", "UAE", "0501", "a b@c", "x" * 301, "dev 1", "maybe", None)
    df = spark.createDataFrame([good, bad], "full_name string, date_of_birth string, nationality string, phone string,"
                               " email string, address string, device_id string, liveness string, document string")
    rows = validate.validate_submissions(df).collect()
    assert rows[0]["errors"] == {}
    assert set(rows[1]["errors"]) == {"full_name", "date_of_birth", "phone", "email", "address", "device_id", "liveness", "document"}


def test_sinks(spark, tmp_path):
    users = spark.createDataFrame([("a", "Old", "UAE")], "user_ref string, full_name string, nationality string")
    new = spark.createDataFrame([("a", "New", "UK", 1), ("b", "B1", "IN", 2), ("b", "B2", "XX", 3)],
                                "user_ref string, full_name string, nationality string, n int")
    assert sorted(tuple(r) for r in writers.upsert_users(users, new, "n").collect()) == [("a", "New", "UAE"), ("b", "B2", "IN")]
    report = spark.createDataFrame([(1, None)], "a int, b double")
    writers.write_metrics(report, str(tmp_path / "m"))
    assert writers.read_metrics(spark, str(tmp_path / "m")).first()["a"] == 1
    assert writers.read_metrics(spark, str(tmp_path / "none")) is None


def test_score_dataset_from_file_to_files(spark, tmp_path):
    from attestra.plans.jobs import score_dataset
    lines = ["account_id,event_time,client_ip,device_fingerprint,mobile,authentication_success,document_path,scenario"]
    lines += [f"STUFF-{i},2026-09-02T09:00:{4 * i:02d}Z,198.51.100.40,BOT,,{'true' if i == 5 else 'false'},,CREDENTIAL_STUFFING"
              for i in range(6)]
    lines += ["LEGIT,2026-09-02T08:00:00Z,203.0.113.80,D1,+971505551111,true,a.jpg,LEGITIMATE",
              ",2026-09-02T08:00:00Z,203.0.113.80,D2,,true,../b.jpg,LEGITIMATE"]
    docs = spark.createDataFrame([("a.jpg", "h1", 7.5, ["No EXIF metadata present"])],
                                 "path string, doc_hash string, ela_score double, metadata_flags array<string>")
    results, report = score_dataset(spark, put(tmp_path, "in.csv", "\n".join(lines) + "\n"), str(tmp_path / "out"), documents=docs)
    rows = {r["record_id"]: r for r in results.collect()}
    assert [rows[i]["risk_score"] for i in range(6)] == [10, 15, 23, 23, 23, 45]
    assert rows[6]["top_reasons"] == "DOCUMENT_ELA_ANOMALY;DOCUMENT_METADATA_MISSING" and rows[6]["rule_score"] == 28
    assert rows[7]["status"] == "ERROR" and rows[0]["normalized_timestamp"] == "2026-09-02T09:00:00+00:00"
    assert report.first()["row_metrics"]["recall"] == 1 / 6
    back = spark.read.csv(str(tmp_path / "out" / "results"), header=True)
    assert back.count() == 8 and back.columns[0] == "record_id" and len(back.columns) == 11
    assert writers.read_metrics(spark, str(tmp_path / "out" / "metrics")).first()["record_counts"]["records"] == 8


def test_untidy_files(spark, tmp_path):
    lines = ['{"user_id": "a", "user_id": "b", "amount": NaN, "device": 123.0, "label": 1.0, "time": 1.7e9, "error": "timeout"}',
             '{"user_id": "c", "device": 7, "nested": {"x": [1]}, "time": 1700000000}', '{"user_id": "d"} x', "", '"text"', "NaN",
             '{"user_id": "e", "device": true, "time": null}']
    rows = readers.read_attempts(spark, put(tmp_path, "u.jsonl", "\n".join(lines))).orderBy("record_id").collect()
    assert [(r["record_id"], r["claimed_user_ref"], r["device_id"], r["sec"], r["error"]) for r in rows] == [
        (0, "b", "123.0", 1_700_000_000, None), (1, "c", "7", 1_700_000_000, None),
        (2, None, None, None, "line 3 is not valid JSON"), (3, None, None, None, "record is not an object/row of fields"),
        (4, None, None, None, "record is not an object/row of fields"), (5, "e", "true", None, None)]
    assert rows[0]["label_category"] == "1.0" and rows[0]["label_is_fraud"]
    body = '[{"user_id": "a", "score": NaN}, 5, {"user_id": "b", "user_id": "c"}]'
    for text in (body, ' {"x": [], "records": %s}\n' % body):
        got = readers.read_attempts(spark, put(tmp_path, "u.json", text)).orderBy("record_id").collect()
        assert [(r["claimed_user_ref"], r["error"]) for r in got] == [
            ("a", None), (None, "record is not an object/row of fields"), ("c", None)]
    for text in ("[]", '{"rows": []}', "[1, 2", "nothing", "5"):
        with pytest.raises(readers.DatasetError):
            readers.read_raw(spark, put(tmp_path, "bad.json", text)).count()


def test_columns_of_the_user(spark, tmp_path):
    body = "user_id,device,device,error,record_id,_parse_error\nu1,d1,d2,timeout,99,x\nu2,d3,,,98,y\n"
    rows = readers.read_attempts(spark, put(tmp_path, "c.csv", body), multi_line=False).orderBy("record_id").collect()
    assert [(r["record_id"], r["claimed_user_ref"], r["device_id"], r["error"]) for r in rows] == [
        (0, "u1", "d2", None), (1, "u2", None, None)]


def test_iso_spellings(spark):
    from datetime import datetime, timezone
    texts = ["2024-01-02T05", "2024-W01-1", "20240102T0506", "2024-01-02T05:06:07+04", "2024-01-02T05:06:07+04:00:30",
             "20240102T050607+0400", "2024-01-02T050607", "2024-01-02x05:06:07", "2024-W01", "2020-W53-7", "2024-01-02",
             "2024-01-02T05:06:07.1234567891", "2024-01-02T05:06:07,5"]
    bad = ["2024-01-02T05:06:07z", "2024-W53-1", "2024-02-30", "2024-01-02T25:00:00", "2024-01-02T5", "24-01-02", "2024-001"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", F.unix_micros(clean.parse_timestamp(F.col("t"))).alias("u")).collect()}
    for t in texts:
        d = datetime.fromisoformat(t)
        d = d.replace(tzinfo=timezone.utc) if d.tzinfo is None else d
        assert got[t] == round((d - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1e6), t
    assert all(got[t] is None for t in bad)
    n = spark.createDataFrame([(t,) for t in ("1.0d", "1f", "1_0", "1__0", "inf", "1e5", ".5", "5.")], "t string")
    assert [r[0] for r in n.select(clean.to_double(F.col("t"))).collect()] == [None, None, 10.0, None, float("inf"), 1e5, 0.5, 5.0]
