"""Whitening, lexical ranking and preference ranking against brute force and held-out accuracy."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from fixtures import frame, lower, prose
from pyspark.sql import functions as F

from attestra.llm import lexical, preference, whitening

VECTORS = "vec_id long, embedding array<float>, label int, doc string, w string, v int, n int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "doc", "w", 3, 4, "c") for i, v in rows], VECTORS)


def test_whitening_equals_exact_arithmetic(spark):
    r = np.random.default_rng(5)
    base = (r.normal(size=(120, 3)) @ r.normal(size=(3, 6)) * 0.2 + 0.1 * r.normal(size=(120, 6))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist()), (None, base[8].tolist())]
    bad = [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan] * 6), (504, [math.inf] + [0.0] * 5),
           (505, [1.0] * 5), (506, [3e38] * 6)]
    out = whitening.whiten(vectors(spark, rows + bad)).select("doc.vec_id", "component", "n", "deviation", "whitened", "explained",
                                                              "identity_error").collect()
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, d = len(x), 6
    s = [sum(v[j] for v in x) for j in range(d)]
    y = [[n * v[j] - s[j] for j in range(d)] for v in x]
    v = np.array([[float(Fraction(sum(a[i] * a[j] for a in y), n ** 3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    want = np.array(y, float) / n @ u / np.sqrt(e)
    assert len(out) == n * d and {o.n for o in out} == {n} and {o.component for o in out} == set(range(1, d + 1))
    assert max(o.identity_error for o in out) < 1e-9
    seen = {}
    for o in out:
        seen.setdefault((o.vec_id, o.component), []).append(o)
        assert abs(o.explained - e[o.component - 1] / e.sum()) < 1e-12
    signs = {}
    for k, (i, _) in enumerate(rows):
        for c in range(1, d + 1):
            for o in seen[(i, c)]:
                assert o.deviation == sum(a * a for a in y[k])
                signs.setdefault(c, set()).add(bool(abs(o.whitened - want[k, c - 1]) < 1e-9))
                assert abs(abs(o.whitened) - abs(want[k, c - 1])) < 1e-9
    assert all(len(x) == 1 for x in signs.values()) and len(seen[(7, 1)]) == 2 and len(seen[(None, 1)]) == 1


def test_whitening_of_large_and_degenerate_tables(spark):
    # few dimensions vary: fewer components; entries of very different size take Python integers
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    out = whitening.whiten(vectors(spark, rows)).collect()
    assert {o.component for o in out} == {1} and len(out) == 10 and abs(out[0].explained - 1) < 1e-12
    wide = [(i, [float((-1) ** i * 2 ** 35), float(i)]) for i in range(40)]
    out = whitening.whiten(vectors(spark, wide)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in wide]
    s = [sum(c) for c in zip(*x)]
    dev = {i: sum((40 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(wide, x)}
    assert all(int(o.deviation) == dev[o.doc.vec_id] for o in out)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(vectors(spark, rows))
        assert got.collect() == [] and got.columns == out[0].__fields__


def test_square_sums_are_exact():
    r = random.Random(1)
    z = [[r.randint(-2 ** 51, 2 ** 51) for _ in range(3)] for _ in range(whitening.SLICE)]
    want = [sum(c * c for c in col) for col in zip(*z)]
    assert whitening.square_sums(np.array(z)) == want == whitening.square_sums(np.array(z, dtype=object))
    assert [whitening.from_limbs(p) for p in zip(*whitening.limbs(want + [-7, 0, -2 ** 100]))] == want + [-7, 0, -2 ** 100]
    with pytest.raises(IndexError):
        whitening.covariance([1], 2, 1)


def ranks(docs, items, top):
    pattern = re.compile(lexical.TERM)
    held = [(i, Counter(pattern.findall(lower(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        q = Counter(pattern.findall(lower(text)))
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * c.total() * len(held)) // total
            scores.append((-sum(k * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                                * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c), i is None, i or 0))
        best = sorted(s for s in scores if s[0] < 0)[:top]
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [500_000, 40])
def test_lexical_ranks_equal_brute_force(spark, docs, rows, block_terms):
    r = random.Random(4)
    texts = [t for _, t in rows if t]
    items = [(1, prose(r, 20)), (2, texts[3][:400]), (2, texts[3][:400]), (3, None), (4, ""), (5, "?! ..."), (None, "A b C b"),
             (6, "日本é ß, w12x W12X w12x"), (7, "nowhere-found zzz"), (8, "one"), (9, "\x00one\x7fTWO_three")]
    table = spark.createDataFrame([(i, t, "d", 1, "k") for i, t in items], "item_id int, text string, doc string, score int, key string")
    for top in (10, 2):
        got = lexical.search(docs, table, top, block_terms=block_terms)
        assert dict(got.dtypes) == {"item": "int", "rank": "int", "key": "bigint", "score": "bigint"}
        assert sorted((tuple(x) for x in got.collect()), key=str) == ranks(rows, items, top)


def test_lexical_search_of_ties_and_empty_tables(spark):
    docs = frame(spark, [(i, f"same words here {i % 2}") for i in range(60)] + [(None, "same words here 0")])
    items = spark.createDataFrame([(1, "words here")], "item_id long, text string")
    assert [(x.rank, x.key) for x in lexical.search(docs, items).orderBy("rank").collect()] == [(i + 1, i) for i in range(10)]
    none = docs.filter("doc_id < 0")
    assert lexical.search(none, items).collect() == [] == lexical.search(docs, items.filter("item_id < 0")).collect()
    assert lexical.search(frame(spark, [(1, None), (2, "--")]), items).columns == ["item", "rank", "key", "score"]


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        ranks[score == v] = ranks[score == v].mean()
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def noisy(r, n):
    """A text of bad quality: marks on words, capitals, or one phrase over and over."""
    kind = r.randrange(3)
    words = prose(r, n).split()
    return " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in words) if kind == 0 else \
        " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(words[:2] * (n // 2))


def test_preference_ranking_on_held_out_rows(spark):
    r = random.Random(6)
    rows = [(i, prose(r, r.randint(5, 120)) if i % 4 else noisy(r, r.randint(5, 120))) for i in range(600)]
    docs = frame(spark, rows + [(9000, None), (9001, ""), (9002, "x" * 3_000_000), (None, rows[1][1]), (9003, "a b\n" * 200_000)])
    marks = [(i, int(bool(i % 4)), 0) for i, _ in rows] + [(3, 1, 0), (4, None, 0), (5, 7, 1), (99999, 1, 0), (None, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = preference.learn(docs, labels.filter(~preference.held_out(F.col("doc_id"))))
    out = preference.rank(docs, model).select("doc.doc_id", "score", "predicted", preference.held_out(F.col("doc.doc_id")).alias("h"))
    got = {x.doc_id: x for x in out.collect()}
    assert len(got) == 606 - 1 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got.values())
    test = [x for i, x in got.items() if x.h and i is not None and i < 600]
    y = np.array([int(bool(x.doc_id % 4)) for x in test])
    assert len(test) > 100 and auc(np.array([x.score for x in test]), y) > 0.97
    assert np.mean(np.array([x.predicted for x in test]) == y) > 0.93
    assert got[None].score == got[1].score and not got[None].h


def test_preference_fit_is_the_least_loss(spark):
    r = np.random.default_rng(2)
    d = r.normal(size=(400, 3)) + [0.5, 0, -0.2]
    w = preference.fit_strength(d, 0.01)
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 0.01 * w @ w
    best = loss(w)
    assert all(loss(w + 0.01 * r.normal(size=3)) >= best - 1e-9 for _ in range(200))
    a, b = preference.pairs(5, 12, 3)
    assert len(a) == len(b) == 36 and set(a) == set(range(5)) and set(b) == set(range(12))
    v = np.array([5.0, 1.0, 3.0, 9.0])
    assert preference.quantile(v, np.ones(4), 0.5) == 4.0 and preference.quantile(v, np.array([1, 1, 1, 97.0]), 0.02) == 4.0


def test_preference_learns_from_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(preference, "GROUP", 40)
    monkeypatch.setattr(preference, "PARTNERS", 3)
    r = random.Random(12)
    rows = [(i, prose(r, 30) if i % 5 else noisy(r, 30)) for i in range(300)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(bool(i % 5))) for i in range(310)], "doc_id long, quality int")
    found, share = preference.labelled(docs, labels, "text", "doc_id", "quality")
    assert found.count() == 300 and abs(share - 248 / 310) < 1e-12
    table = preference.class_table()
    x = spark.createDataFrame([(i, int(bool(i % 5)), bytearray(preference.features(t, table).tobytes())) for i, t in rows], "k long, y int, x binary")
    groups = preference.opponents(x, {1: 240, 0: 60}).collect()
    met = Counter(bytes(v["x"]) for g in groups for v in g["rows"])
    assert len(groups) == 6 and set(met) == {bytes(preference.features(t, table).tobytes()) for _, t in rows}
    model = preference.learn(docs, labels)
    z = np.clip((np.array([preference.features(t, table) for _, t in rows]) - model.mean) / model.scale, -8, 8)
    strength, y = (z * model.weights).sum(axis=1), np.array([bool(i % 5) for i, _ in rows])
    weights = np.where(y, share / 240, (1 - share) / 60)
    assert abs(preference.quantile(strength, weights, 1 - share) - model.threshold) < 1e-9      # over all rows, not over some
    full = np.array([preference.features(t, table) for _, t in rows])
    assert np.allclose(model.mean, full.mean(axis=0)) and np.allclose(model.scale, np.where(full.std(axis=0) > 1e-9, full.std(axis=0), 1))


def test_preference_features_and_missing_labels(spark, monkeypatch):
    table = preference.class_table()
    x = dict(zip(preference.NAMES, preference.features("Ab ab, AB!\n12 ###", table)))
    assert x["caps"] == x["title"] == 0.2 and x["bare"] == 0.4 and x["marked"] == 0.2 and x["short"] == 0.4
    assert abs(x["mean_word"] - 13 / 5) < 1e-12 and x["common"] == 0.2
    r = random.Random(8)
    long = " ".join(r.choice(["word", "ab.", "X!!", "\n", "12"]) + str(r.randrange(50)) for _ in range(40_000))
    whole = preference.features(long, table)
    monkeypatch.setattr(preference, "PIECE", 1 << 12)       # only pairs and edges across pieces may differ
    assert np.allclose(preference.features(long, table), whole, atol=2e-3, rtol=2e-3)
    assert not preference.features(None, table).any() and not preference.features("", table).any()
    docs = frame(spark, [(1, "some words"), (2, None)])
    for marks, share in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)):
        model = preference.learn(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
        assert {r.score for r in preference.rank(docs, model).collect()} == {share}
    assert preference.rank(docs.filter("doc_id < 0"), model).collect() == []
