"""Language, near-duplicates, passages, mixture, pseudo-likelihood, pages and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import WORD, frame, lower, prose

import corpus_pipeline
from attestra.llm import boosting, dom, html_extract, language, mixture, passages, pseudo_likelihood as pl, simhash
from attestra.llm.sql import MIXTURE

LANGUAGES = {"aa": "ba be bi bo bu ga ge".split(), "bb": "kra kre kri stro stru".split(), "cc": "éna ßel çou ñam üng".split()}


def labelled(r, n):
    out = []
    for i in range(n):
        name = r.choice(list(LANGUAGES))
        words = ["".join(r.choice(LANGUAGES[name]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))]
        out.append((i, " ".join(words), name))
    return out


def test_language_held_out_accuracy(spark):
    r = random.Random(1)
    data = labelled(r, 240)
    docs = spark.createDataFrame(data + [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, "ba be bi", None)],
                                 "doc_id long, text string, lang string")
    learn = docs.filter(~language.held_out())
    model = language.learn(learn)
    assert model.languages == ("aa", "bb", "cc")
    truth = {i: name for i, _, name in data}
    out = {x.doc.doc_id: x for x in language.identify(docs, model).collect()}
    assert len(out) == 244 and all(0 <= x.score <= 1 for x in out.values())
    held = [x.doc_id for x in docs.filter(language.held_out()).collect() if x.doc_id in truth]
    assert len(held) > 50 and sum(out[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (900, 901, 902)) and out[None].lang_pred == "aa"
    nothing = language.learn(docs.limit(0))
    assert all(x.lang_pred == "und" for x in language.identify(docs, nothing).collect())


def test_bloom_masks_hold_every_gram():
    r = np.random.default_rng(0)
    grams = {k: r.integers(0, 2**63, 3000).astype(np.uint64) for k in "xyz"}
    f = language.build_filter(grams, 16, 3, (3,))
    for i, name in enumerate("xyz"):
        seen = np.bitwise_and.reduce([f.masks[p] for p in language.places(grams[name], 16, 3)])
        assert (seen >> np.uint64(i) & np.uint64(1)).all()
    others = r.integers(0, 2**63, 20000).astype(np.uint64)
    seen = np.bitwise_and.reduce([f.masks[p] for p in language.places(others, 16, 3)])
    assert abs((seen & np.uint64(1)).mean() - f.chance[0]) < 0.005


def test_score_is_the_share_of_the_text_that_is_explained():
    grams = lambda t: np.concatenate(language.gram_hashes(t, language.letter_table(), (3,)))
    known = "".join(chr(0x4E00 + i) for i in range(400))
    few = language.build_filter({"aa": grams(known), "bb": grams(known[::-1])}, 18, 3, (3,))
    gibberish = "".join(chr(0x6000 + i) for i in range(1000)) + " " + known[:40]
    assert 0 < language.decide(gibberish, few)[1] < corpus_pipeline.MIN_LANGUAGE_SCORE
    # related languages share nearly all n-grams: the one with more of them is named, and the text is explained
    related = {f"r{i}": grams(known[:390 + i]) for i in range(8)}
    name, score = language.decide(known[:397], language.build_filter(related, 18, 3, (3,)))
    assert name == "r7" and score > 0.9


def test_more_languages_than_bits_of_a_word(spark):
    names = [f"l{i:03d}" for i in range(70)]
    texts = {n: " ".join(chr(0x4E00 + 40 * i + j) * 3 for j in range(20)) for i, n in enumerate(names)}
    f = language.build_filter({n: np.concatenate(language.gram_hashes(t, language.letter_table(), (3,)))
                               for n, t in texts.items()}, 16, 3, (3,))
    assert f.masks.shape == (1 << 16, 2) and all(language.decide(texts[n], f)[0] == n for n in names)
    rows = spark.createDataFrame([(i, texts[n], n) for i, n in enumerate(names)], "doc_id long, text string, lang string")
    names_asked = []
    with pytest.MonkeyPatch.context() as m:     # the n-grams of 70 languages are not needed to see which are learned
        m.setattr(language, "build_filter", lambda grams, *a: names_asked.extend(grams))
        language.learn(rows, documents_per_language=1, grams_per_language=1, orders=(3,))
    assert names_asked == names


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = " ".join("kra" * (i % 5 + 1) for i in range(500))
    f = language.build_filter({"k": np.concatenate(language.gram_hashes(text, language.letter_table(), (3, 4)))}, 16, 3, (3, 4))
    whole = language.language_counts(text, f)[0]
    monkeypatch.setattr(language, "PIECE", 100)
    assert language.language_counts(text, f)[0] == whole


def python_fingerprint(text):
    import xxhash

    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in linked:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_golay_keys_meet_for_all_error_patterns():
    tables = simhash.golay_tables()
    r = np.random.default_rng(5)
    assert (simhash.decode(np.arange(1 << 12) << 11 ^ np.array([tables[0][0]] * (1 << 12)), tables) >= 0).all()
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    near = []
    for b in base:
        x = b
        for bit in r.choice(64, r.integers(1, 5), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        near.append(x)
    fps = np.unique(np.concatenate((base, np.array(near))))
    row, key, plain = simhash.fuzzy_keys(fps, tables)
    order = np.argsort(key, kind="stable")
    got = {tuple(map(int, e)) for e in simhash.bucket_links(key[order], fps[row][order], plain[order])}
    assert all(tuple(sorted((int(a), int(b)))) in got for a, b in zip(base, near))
    assert all((a ^ b).bit_count() <= 4 for a, b in got)


def test_near_duplicates(spark, docs, rows):
    out = simhash.near_duplicates(docs).collect()
    fps = [python_fingerprint(t) for _, t in rows]
    assert Counter((x.key, x.fp & (2**64 - 1)) for x in out) == Counter((i, f) for (i, _), f in zip(rows, fps))
    distinct = sorted(set(fps))
    root = components(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = defaultdict(list)
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]].append(i)
    assert all(x.component == min(least[root[x.fp & (2**64 - 1)]]) for x in out)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(min(v) for v in least.values())
    assert simhash.near_duplicates(docs.limit(0)).collect() == simhash.one_of_each(docs.limit(0)).collect() == []


def test_forest_joins_what_pairs_would():
    r = np.random.default_rng(2)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = []
    for _ in range(200):
        x = centre
        for bit in r.choice(64, r.integers(0, 7), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        fps.append(x)
    fps = np.unique(np.array(fps))
    edges = simhash.forest(fps)
    assert len(edges) < len(fps) and all((a ^ b).bit_count() <= 4 for a, b in edges)
    ids = [int(f) for f in fps]
    pairs = [(a, b) for a in ids for b in ids if a < b and (a ^ b).bit_count() <= 4]
    groups = lambda root: sorted(sorted(k for k in ids if root[k] == v) for v in set(root.values()))
    assert groups(components(ids, edges)) == groups(components(ids, pairs))


def test_passages(spark, docs, rows):
    r = random.Random(11)
    passage = prose(r, 60).split()
    edited = list(passage)
    edited[30] = "edited"
    del edited[45]
    halves = prose(r, 30).split(), prose(r, 30).split()
    more = [(500, prose(r, 200) + " " + " ".join(passage) + " " + prose(r, 10)), (501, " ".join(passage)),
            (502, prose(r, 20) + " " + " ".join(edited) + " " + prose(r, 20)), (503, prose(r, 20) + " " + " ".join(passage[:40])),
            # a passage whose halves occur in other documents first
            (510, " ".join(halves[0])), (511, " ".join(halves[1])), (512, prose(r, 9) + " " + " ".join(halves[0] + halves[1])),
            (513, " ".join(halves[0] + halves[1]) + " " + prose(r, 9)), (520, (prose(r, 60) + "\n") * 2)]
    mine = rows + more
    out = defaultdict(list)
    for x in passages.shared_passages(frame(spark, mine)).collect():
        out[x.key].append(x)
    assert sum(map(len, out.values())) == len(mine)
    where = defaultdict(set)
    texts = {(i, t): WORD.findall(lower(t)) for i, t in mine}
    for d, w in texts.items():
        for p in range(len(w) - 50):
            where[tuple(w[p:p + 51])].add(d)
    for (i, t), w in texts.items():
        need = {q for p in range(len(w) - 50) if len(where[tuple(w[p:p + 51])]) > 1 for q in range(p, p + 51)}
        for x in out[i]:
            spans = [tuple(map(int, s.split(":"))) for s in x.passages.split(",") if s]
            if i in (15, None):             # several documents of one id
                continue
            assert need <= {q for a, b in spans for q in range(a, b)}, i
    one = lambda i: out[i][0]
    assert one(502).passages == "20:79" and one(502).component == 500
    assert one(503).n_passages == one(520).n_passages == one(510).n_passages == 0
    assert one(512).passages == "9:69" and one(513).passages == "0:60"
    assert len(out[6]) == 3 and len({x.component for x in out[6]}) == 1
    assert passages.shared_passages(docs.limit(0)).collect() == []


def test_hot_seeds_are_split(spark):
    r = random.Random(3)
    line = prose(r, 60)
    docs = frame(spark, [(i, prose(r, 20) + " " + line) for i in range(150)]).selectExpr(
        "xxhash64(doc_id) n", "text")
    small = passages.seed_matches(docs, 5, 16, 50, group_rows=10, sample=1).collect()
    plain = passages.seed_matches(docs, 5, 16, 50).collect()
    assert {(x.n, x.pos) for x in small} == {(x.n, x.pos) for x in plain} and all(x.n != x.an for x in small)
    root = components({x.n for x in small} | {x.an for x in small}, [(x.n, x.an) for x in small])
    assert len(root) == 150 and len(set(root.values())) == 1


def test_chains_are_optimal_on_small_inputs():
    r = random.Random(7)
    for _ in range(60):
        n = r.randint(2, 9)
        pts = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(n)})
        pos, apos = np.array([p for p, _ in pts]), np.array([q for _, q in pts])

        def value(chain):
            return 5 * len(chain) - sum(passages.GAP_COST * (pos[b] - pos[a] + apos[b] - apos[a]) / 2
                                        for a, b in zip(chain, chain[1:]))
        best = max(value([i for i in range(len(pts)) if mask >> i & 1]) for mask in range(1, 1 << len(pts))
                   if all(pos[a] < pos[b] and apos[a] < apos[b] for c in [[i for i in range(len(pts)) if mask >> i & 1]]
                          for a, b in zip(c, c[1:])))
        chains = passages.chains_of(pos, apos, 5)
        assert sorted(i for c in chains for i in c.tolist()) == list(range(len(pts)))
        assert abs(max(value(c.tolist()) for c in chains) - best) < 1e-9


def test_single_matches_inside_other_chains_stay():
    # two seeds of partner 1 stand around the only seed that partner 2 shares
    an, pos, apos = np.array([1, 2, 1]), np.array([10, 30, 50]), np.array([5, 40, 45])
    found = passages.document_chains(an, pos, apos, 5, 16, 50, 2)
    assert sorted(found) == [(1, [10, 50], [5, 45]), (2, [30], [40])]


def test_pieces_with_too_many_edits_are_split():
    good = [b"g%d" % i for i in range(60)]
    x, y, seeds = list(good), list(good), list(range(0, 56, 5))
    for i in range(20):                         # five equal words after four substituted ones, again and again
        seeds.append(len(x) + 4)
        equal = [b"e%d" % (5 * i + j) for j in range(5)]
        x += [b"x%d" % (4 * i + j) for j in range(4)] + equal
        y += [b"y%d" % (4 * i + j) for j in range(4)] + equal
    found = passages.align(x, y, seeds, seeds, 5, 0.8)
    assert found and found[0][0] == 0 and found[0][1] >= 60
    assert all(cost <= 0.2 * max(e - s, qe - qs) for s, e, qs, qe, cost in found)
    assert {p for s, e, *_ in found for p in range(s, e)} >= {p + j for p in seeds for j in range(5)}
    # ends that cost too much are shortened, the seeds stay
    x, y = "a b c d e p q r s t".split(), "a b c d e v q w s z".split()
    assert passages.align(x, y, [0], [0], 5, 0.9) == [(0, 5, 0, 5, 0)]


def test_edit_distance():
    assert passages.edits("a b c d".split(), "a x c".split()) == 2 and passages.edits([], ["a"]) == 1
    assert passages.edits(list("kitten"), list("sitting")) == 3


@pytest.mark.parametrize("sources", [("hot",) * 8 + ("b", "c", None), ("a", "b"), ("only",)])
def test_mixture_equals_sql(spark, sources):
    import duckdb

    r = random.Random(5)
    rows = [(i, prose(r, r.randint(1, 60))) for i in range(120)] + [(200, None), (201, ""), (None, "x y z"), (7, "x y"), (7, "x y")]
    docs = frame(spark, rows, sources)
    out = mixture.mix(docs, block_tokens=262_144).toPandas()
    con = duckdb.connect()
    con.register("t", docs.toPandas()[["doc_id", "text", "source"]].astype({"doc_id": "Int64"}))
    want = con.execute("WITH RECURSIVE" + MIXTURE.replace("{documents}", "t")).df()
    key = ["doc_id", "source", "copy", "block", "position", "n_tokens"]
    as_rows = lambda f: sorted(tuple(-1 if v != v or v is None else v for v in row) for row in
                               f[key].astype(object).where(f[key].notna(), None).itertuples(index=False))
    assert as_rows(out) == as_rows(want) and len(out) > 50


def test_mixture_properties(spark):
    r = random.Random(6)
    docs = frame(spark, [(i, prose(r, 20)) for i in range(400)], ("hot",) * 17 + ("b", "c", "d"))
    out = mixture.mix(docs, target_entropy=0.95, max_repeats=100.0, block_tokens=500, bucket_documents=7).toPandas()
    tokens = out.groupby("source").n_tokens.sum()
    share = tokens / tokens.sum()
    assert abs(-(share * np.log(share)).sum() / math.log(4) - 0.95) < 0.02 and tokens.sum() <= 8000
    for (block, source), n in out.groupby(["block", "source"]).n_tokens.sum().items():
        assert n <= 500 * share[source] + 40            # every block has the same mixture, up to a document
    copies = out.groupby(["source", "doc_id"]).size()
    assert all(copies[s].max() - copies[s].min() <= 1 for s in ("b", "c", "d")) and copies["b"].min() >= 2
    assert (out.groupby("block").position.max() == out.groupby("block").size()).all()
    less = mixture.mix(docs, target_entropy=1.0, max_repeats=3.0).toPandas()
    assert less.groupby(["source", "doc_id"]).size().max() <= 4 and less.groupby("source").n_tokens.sum()["b"] <= 3 * 20 * 20
    assert mixture.mix(docs.limit(0)).collect() == []


def test_pseudo_likelihood(spark):
    r = random.Random(4)
    cycle = [f"t{i}" for i in range(30)]
    texts = []
    for i in range(300):
        at = r.randrange(30)
        texts.append((i, " ".join(cycle[(at + k) % 30] for k in range(r.randint(20, 60)))))
    docs = frame(spark, texts + [(900, None), (901, ""), (902, "t1"), (903, "unseen words here")])
    model = pl.train(docs, classes=48, inputs=128, bits=12, every=3, rounds=3, steps=150)
    out = {x.doc.doc_id: x for x in pl.score(docs, model).collect()}
    v, w = model
    for i in (0, 7, 902, 903):                          # the batched sum against one window at a time
        b = pl.buckets(dict(texts + [(902, "t1"), (903, "unseen words here")])[i].encode(), v.bits)
        total = 0.0
        for p in range(len(b)):
            x = pl.windows_of(v.input[b], 3)[p:p + 1]
            total += pl.log_classes(w, x)[0][0, v.output[b[p]]] + v.share[b[p]]
        assert out[i].n_tokens == len(b) and abs(out[i].log_likelihood - total) < 1e-3 * max(1, abs(total))
    assert (out[900].n_tokens, out[900].log_likelihood, out[900].per_token) == (0, 0.0, None) == (
        out[901].n_tokens, out[901].log_likelihood, out[901].per_token)
    ordered = np.mean([out[i].per_token for i in range(300)])
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for _, t in texts]
    mixed = np.mean([s / n for n, s in pl.text_scores([t.encode() for t in shuffled], v, w, 3)])
    assert ordered > -1.5 > -3.0 > mixed                # both sides decide the word; unigrams give -3.4
    empty = pl.train(docs.limit(0), classes=8, inputs=32, bits=6)
    assert pl.score(docs.limit(0), empty).collect() == []
    probability = [math.exp(s) for _, s in pl.text_scores([f"w{i}".encode() for i in range(3)], *empty, 3)]
    assert all(0 < p < 1 for p in probability)


def test_all_positions_are_trained_on(spark, monkeypatch):
    monkeypatch.setattr(pl, "RUN", 500)
    texts = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1 + i * 7 % 90))) for i in range(40)] + [(90, None), (91, " ")]
    docs = frame(spark, texts)
    windows = pl.training_windows(docs, "text", 10, 3)
    counts = pl.count_buckets(windows, 10)
    seen = sum(int((np.frombuffer(r["w"], dtype=np.int32) >= 0).sum()) for r in windows.collect())
    assert seen == counts.sum() == sum(len((t or "").split()) for _, t in texts)
    for count in (1, 100, 40_000, 150_001):                 # a long run is dealt out, a short one is taken whole
        r = np.random.default_rng(1)
        places = [pl.round_positions(count, k, 3, 150, r)[0] for k in range(3)]
        taken = np.bincount(np.concatenate(places), minlength=count)
        assert taken.min() == taken.max() and (taken.max() == 1) == (count > 150 * 256)


def test_gradients():
    r = np.random.default_rng(1)
    v = pl.Vocabulary(np.arange(6), np.zeros(6, np.float32), np.arange(6) + 1, 6, 8, 3)
    w = pl.fresh(v, 2, 3, 5, np.ones(6))
    x, y = r.integers(0, 7, (40, 4)), r.integers(0, 6, 40)
    loss = lambda u: -pl.log_classes(u, x)[0][np.arange(40), y].mean()
    start = loss(w)
    after = pl.descend(w, x, y, 0.05, 30, 0)
    assert loss(after) < start - 0.3 and loss(w) == start       # the shared weights are left alone


@pytest.fixture(scope="module")
def pages_model():
    return html_extract.train(pages=250)


def test_main_text_on_held_out_layouts(pages_model):
    maker, exact, n = html_extract.PageMaker(4242), 0, 150
    nodes = right = 0
    for _ in range(n):
        page = maker.page()
        order = dom.finish(dom.parse(page))
        want = " ".join(k.text.replace(maker.MARK, "") for k in order if k.text and maker.MARK in k.text)
        exact += html_extract.extract([page.replace(maker.MARK, "")], pages_model)[0] == want
    x, y = html_extract.labelled_nodes(60, 777)
    nodes, right = len(y), ((boosting.predict(pages_model, x) > 0.5) == (y > 0.5)).sum()
    assert exact >= 0.9 * n and right >= 0.98 * nodes


def test_pages(spark, pages_model):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen. "
    cases = {
        1: f"<nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>A &amp; B</h1><p>{words * 3}<p>x&nbsp;\n y <b>z</b>w<br>v"
           f"</article><footer>&copy; 2020</footer>",
        2: None, 3: "", 4: "<html><head><title>t</title></head><body></body></html>",
        5: f"<article><p>{words * 2}</p><script>var a='<p>no</p>';</script><style>p{{}}</style><!-- c --></article><p",
        6: f"<nav><a href=/x>{words[:20]}</a></nav><article><h1>T</h1><p>{words * 400}</p></article>",
    }
    pages = spark.createDataFrame([(i, f"u{i}", h, "text") for i, h in cases.items()] + [(5, "u5", cases[5], "t")],
                                  "page_id long, url string, html string, doc string")
    out = defaultdict(list)
    for x in html_extract.main_text(pages, model=pages_model).collect():
        out[x.doc.page_id].append(x.text)
    w = words.strip()
    assert out[1] == [f"A & B {' '.join([w] * 3)} x y zw v"]
    assert out[2] == out[3] == out[4] == [""] and out[5] == [f"{w} {w}"] * 2
    assert out[6] == ["T " + " ".join([w] * 400)]


def test_no_descendant_of_a_dropped_node_is_kept():
    order = dom.finish(dom.parse("<div><p>a</p><div><p>b</p></div></div>"))
    r = np.random.default_rng(0)
    for _ in range(50):
        p = np.clip(r.random(len(order)), 0.01, 0.99)
        yes, no = np.log(p), np.log(1 - p)
        got = dom.kept_text(order, yes.tolist(), no.tolist())
        index = {id(n): i for i, n in enumerate(order)}
        best, text = -1e9, None
        for mask in range(1 << len(order)):
            keep = [bool(mask >> i & 1) for i in range(len(order))]
            if keep[0] and all(keep[index[id(n.parent)]] or not keep[i] for i, n in enumerate(order) if n.parent):
                total = sum(yes[i] if k else no[i] for i, k in enumerate(keep))
                if total > best:
                    best, text = total, " ".join(n.text for i, n in enumerate(order) if keep[i] and n.text)
        assert got == text


def test_pipeline(spark, tmp_path):
    r = random.Random(12)
    good = [(i, t, name, f"s{i % 3}") for i, t, name in labelled(r, 90)]
    bench = " ".join("ba" + r.choice(LANGUAGES["aa"]) for _ in range(30))
    rows = [(*g, len(g[1])) for g in good] + [
        (800, "12 34", "aa", "s0", 5), (801, None, "aa", "s1", None), (802, good[0][1], good[0][2], "s2", len(good[0][1])),
        (803, bench, "aa", "s0", len(bench)), (804, "ba be bi bo gabe " * 9 + 'password = "hunter2abc" ba', "aa", "s1", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert kept.schema.fieldNames() == docs.columns
            seen.append({x.doc_id: x for x in kept.collect()})
    assert set(range(90)) <= set(seen[0]) and not {800, 801} & set(seen[0])
    linked = defaultdict(list)
    for x in simhash.near_duplicates(spark.read.parquet(str(tmp_path / "stage0"))).collect():
        linked[x.component].append(x.key)
    assert set(seen[1]) == set(linked) and 802 not in seen[1] and 0 in seen[1]
    assert set(seen[1]) - set(seen[2]) == {803} and set(seen[3]) == set(seen[2])
    assert "hunter2" not in seen[3][804].text and seen[3][804].n_chars == len(seen[3][804].text)
    assert all(seen[3][i].text == seen[2][i].text for i in seen[3] if i != 804)
    placed = {x.doc_id for x in kept.collect()}
    assert placed <= set(seen[3]) and len(placed) > 0.8 * len(seen[3])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == placed
