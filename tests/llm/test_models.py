import pathlib
import random

import numpy as np
import pytest

from factloom.llm import language, licenses, neighbours, pieces, quality, rules, toxicity

WORDS = "the of and to in is that it was for on are as with they be at one have this".split()


def docs(spark, n=300, seed=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        body = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(30, 90))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if bad:
            body = [w + "%%%" for w in body]
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["grumpface", "grumpfaces", "snotling", "snotlings", "blighter"])
        rows.append((i, " ".join(body), 0 if bad else 1, 1 if toxic else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


EDGES = "doc_id long, text string, quality string"


def edge_rows():
    return [(None, "a b"), (1, None), (2, ""), (3, " \n "), (4, "word " * 40_000), (4, "word " * 40_000), (5, "x" * 100_000), (6, "tie tie\ntie tie"), (7, "日本語 \u0000 😀")]


def test_quality_held_out_and_edges(spark):
    all_ = docs(spark)
    labels = all_.select("doc_id", "quality")
    model = quality.train(labels, all_.select("doc_id", "text"), quality.remainder(5) != 0)
    got = quality.score(all_.where(quality.remainder(5) == 0), model).collect()
    assert len(got) == all_.where(quality.remainder(5) == 0).count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(r["quality"] >= 0.3) == truth[r.doc_id] for r in got]) > 0.97
    edge = spark.createDataFrame([(*r, "mine") for r in edge_rows()], EDGES)
    out = quality.score(edge, model).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.quality <= 1 for r in out)
    same = {r.quality for r in out if r.text in (None, "")}
    assert len(same) == 1 and len({r.quality for r in out if r.doc_id == 4}) == 1
    empty = quality.train(labels.limit(0), all_.limit(0), quality.remainder(5) != 0)
    assert {r.quality for r in quality.score(edge, empty).collect()} == {0.5}


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(200) < 0.3, -1, 1)
    rows = [np.unique(np.concatenate([rng.integers(0, 400, 20), [500 if k > 0 else 501]])).astype(np.int32) for k in y]
    model = quality._fit_hinge(rows, y)
    assert all((model.margin(r) > 0) == (k > 0) for r, k in zip(rows, y, strict=True))


def test_features_do_not_depend_on_the_batch():
    texts = ["", "One two two. THREE!!", "x" * 5000, "a b " * 900, "é ü\nß"]
    alone = [np.sort(next(quality.features([t.encode()]))) for t in texts]
    together = [np.sort(x) for x in quality.features([t.encode() for t in texts], piece=50)]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True)) and not len(alone[0])


def test_toxicity_held_out_misspelled_and_edges(spark):
    all_ = docs(spark)
    labels = all_.select("doc_id", "toxic")
    model = toxicity.train(labels, all_.select("doc_id", "text"), toxicity.remainder(3) != 1)
    got = toxicity.score(all_.where(toxicity.remainder(3) == 1), model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(r.toxicity >= 0.7) == truth[r.doc_id] for r in got]) > 0.97
    assert model.texts([toxicity.plain("you snottling")])[0] > 0.5 > model.texts([toxicity.plain("the of and")])[0]
    out = toxicity.score(spark.createDataFrame([(*r, "mine") for r in edge_rows()], EDGES), model).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.score(all_.limit(0), model).count() == 0
    some = [toxicity.plain(x) for x in ("a snotling here", "", "fine of the", "word " * 300)]
    assert np.allclose(model.texts(some, piece=20), np.concatenate([model.texts([x]) for x in some]))


def brute_rules(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c d").strip() for _ in range(n)) for n in (0, 7, 8, 9, 15, 30, 60)]
    texts += [None, "", "\n\n", "a\na\n a\na", "# $ <b>\n# $ <b>", "é ß\x0b日本 \x0c", "one two three four five six seven eight " * 30]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(df).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    empty = spark.createDataFrame([], "doc_id long, quality int")
    verdict = rules.judge(df, empty).collect()
    assert len(verdict) == len(texts) and all(r.kept != r.base_failed for r in verdict)
    assert rules.judge(df.limit(0), empty).count() == 0


def test_cutoffs_hold_the_risk(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) + (" #" * 30 if i % 400 == 0 else "")) for i in range(1500)]
    rows += [(i, "bad# " * 3 + " ".join(f"w{j}#" for j in range(40))) for i in range(1500, 1600)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1 if i < 1500 else 0) for i, _ in rows], "doc_id long, quality int")
    chosen = {(r.stratum, r.rule): r.cutoff for r in rules.cutoffs(rules.statistics(df), labels).collect()}
    assert chosen["en", "symbols_per_word"] <= 0.5
    out = rules.judge(df, labels).collect()
    assert sum(not r.kept for r in out if r.doc_id < 1500) <= 0.05 * 1500
    assert not any(r.kept for r in out if r.doc_id >= 1500)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10), (3, 50), (9, 900), (12, 900)]
    df = spark.createDataFrame(cases, "k long, n long")
    got = df.select("k", "n", rules._tail(df.k, df.n, 0.01).alias("p")).collect()
    for r in got:
        want = sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert abs(r.p - want) < 1e-9


def test_licences(spark):
    mit = licenses.TEXTS["MIT"][0]
    texts = [mit, "Copyright (c) 2020 A. Nother\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace(" ", "  \n"), mit + " more", None, "", "x\nReleased under the  MIT licence\ny", "Released under the MIT License.", "the copyright (c) is law"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, known string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i in range(9)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT", None]
    assert got[6] == (None, "MIT") and got[7] == ("MIT", "MIT") and got[4] == (None, "")
    assert licenses.scan(df.limit(0)).count() == 0


LANGS = {"en": "the of and to in is that was for with".split(), "de": "der die und das nicht ein eine zu von mit".split(), "fr": "le la les des une est que dans pour avec".split(), "es": "el los las una que por para con del como".split()}


def test_language_fuses_evidence(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    say = lambda g, n: " ".join(rng.choice(LANGS[g]) for _ in range(n))
    rows = [(i, say(g, 60), g, f"www.{g}{i % 3}.example.com") for i, g in enumerate(list(LANGS) * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = language.train(train)
    probe = rows[:100] + [(900, "", "de", "x.org"), (901, None, None, None), (902, "", None, "www.fr1.example.com"), (903, "12 34 !!", None, "y.de"), (904, say("es", 50), "en", None), (904, say("es", 50), "en", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in probe], "doc_id long, text string, lang string, host string, confidence double")
    out = language.identify(df, model, F.col("text"), F.col("lang"), F.col("host")).collect()
    got = {r.doc_id: r.language for r in out}
    assert len(out) == len(probe) and all(abs(sum(r.posterior) - 1) < 1e-9 for r in out)
    assert all(got[i] == g for i, _, g, _ in rows[:100])
    assert got[900] == "de" and got[901] == "und" and got[902] == "fr" and got[903] == "de" and got[904] == "es"
    assert language.identify(df.limit(0), model, F.col("text"), F.col("lang"), F.col("host")).count() == 0


@pytest.fixture(scope="module")
def scan():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Scan(pieces.Pieces(f.read()))


def odd_texts():
    rng = random.Random(1)
    return ["", " ", "a  b   c", " lead", "trail ", "ab\ncd\t\te", "日本語 テキスト😀😀 x", "a" * 300, "".join(rng.choice("abcdeé \n") for _ in range(3000)), "".join(rng.choice("aabn t") for _ in range(2000)), "\u0000", "nationalization"]


def test_pieces_equal_the_library(scan):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in odd_texts():
        assert scan.encode(text) == library.encode(text)
        assert scan.decode(scan.encode(text)) == text


def test_chunks_and_max_plus(scan):
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.4, -np.inf, rng.random(s)) for s in ((3, 4), (4, 5), (5, 2)))
    assert np.allclose(pieces.compose(pieces.compose(a, b), c), pieces.compose(a, pieces.compose(b, c)))
    for text in odd_texts()[1:]:
        for size in (1, 7, 64):
            marked, more, parts = scan.marked(text), scan.p.longest, []
            for at in range(0, len(marked), size):
                to, low = min(len(marked), at + size), max(0, at - more)
                parts.append((marked[low : to + more], at - low, to - low, to == len(marked)))
            at = pieces.borders([scan.matrix(*p) for p in parts])
            ids = [i for k, p in enumerate(parts) for i in scan.trace(p[0], p[1], p[2], at[k], at[k + 1], p[3])]
            assert ids == scan.encode(text)


def test_pairs_and_runs_equal_merging(scan, monkeypatch):
    p, rng = scan.p, np.random.default_rng(5)
    names = sorted(p.id)
    pairs = [(names[a], names[b]) for a, b in rng.integers(0, len(names), (4000, 2))]
    pairs += [(x[:k], x[k:]) for x in names[::40] for k in range(1, len(x)) if x[:k] in p.id and x[k:] in p.id]
    pairs += [(x, x) for x in names[::40]]
    assert [p.apart(a, b) for a, b in pairs] == [p.merge(a + b) == [a, b] for a, b in pairs]
    runs = ["▁" + "".join(rng.choice(list("aeinrstaaé"), n)) for n in rng.integers(1, 40, 300)]
    want = [tuple(p.id[x] for x in p.merge(run)) for run in runs]
    assert [scan._run(run) for run in runs] == want
    monkeypatch.setattr(pieces, "SHORT", 0)
    assert [scan._run(run) for run in runs] == want


def test_pieces_in_spark(spark, scan):
    texts = [*odd_texts(), None, odd_texts()[8], odd_texts()[8]]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: (r.ids, r.round_trip) for r in pieces.encode(df, giant=200, chunk=90).collect()}
    assert got == {i: (None, None) if t is None else (scan.encode(t), True) for i, t in enumerate(texts)}
    assert pieces.encode(df.limit(0)).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(neighbours.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    data[100:400] = data[7]
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    bad = [(10_000, None), (10_100, [0.0] * 16), (10_200, [1.0] * 15 + [None]), (10_300, [float("nan")] * 16), (10_400, [1.0] * 5), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = neighbours.search(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 100))
    hits, wide = 0, data.astype(float)
    for q, found in by.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hits += len({r.vec_id for r in found} & set(want.tolist()))
        assert [r.rank for r in found] == list(range(1, 11)) and all(r.score == d[r.vec_id] for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    assert hits / (10 * len(by)) >= 0.9
    assert [r.vec_id for r in by[100]] == [7, *range(101, 110)]
    assert neighbours.search(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in neighbours.search(few).collect()] == [(0, 1)]


def test_neighbours_of_repeated_ids_in_blocks(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 4))
    rows = [(i % 250, x.tolist()) for i, x in enumerate(points)] + [(0, points[0].tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df.repartition(7), every=10, k=3, block=6, ranges=1).collect()
    want = []
    for q in range(0, 250, 10):
        for own in (q, q + 250)[: 1 + (q < 150)]:
            d = np.sqrt(((points - points[own]) ** 2).sum(axis=1))
            d[own] = np.inf
            want += [(q, k + 1, int(j) % 250, d[j]) for k, j in enumerate(np.lexsort((np.arange(400) % 250, d))[:3])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_neighbours_recall_in_windows(spark):
    """Windows hold a part of the rows only; the data has clusters, as vectors of texts do."""
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(40, 32))[rng.integers(0, 40, 12_000)] * 3 + rng.normal(size=(12_000, 32))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, every=400, curves=16, range_rows=64, ranges=100).collect()
    hits = 0
    for q in range(0, 12_000, 400):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 300


def test_typographic_variants_of_a_licence(spark):
    text = licenses.TEXTS["MIT"][0]
    odd = text.replace('"Software"', "\u201cSoftware\u201d").replace(" of ", "\u00a0of\u2003").replace(", ", " \u2014 ")
    rows = [(1, odd), (2, "\ufeff" + text), (3, text + " and more")]
    found = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None}


def test_whole_words_count_in_bags():
    """Words that differ after their fortieth byte have different rows."""
    long_ = "ab" * 30
    buffer = np.frombuffer(f" {long_}x {long_}y {long_}x ".encode(), np.uint8)
    first, past = np.array([1, 63, 125]), np.array([62, 124, 186])
    rows = list(toxicity._grams(buffer, first, past))[-1][0]
    assert rows[0] == rows[2] != rows[1]


def test_bags_equal_plain_averages():
    """A word's log-odds are the mean over its n-grams and itself, a document's the greatest of its words'."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), -0.5)
    words = ["badger", "ox", "caterpillar", "badger"]
    odds = []
    for w in words:
        buffer = np.frombuffer(f" {w} ".encode(), np.uint8)
        picked = [model.weights[r[a[0] : b[0]]] for r, a, b in toxicity._grams(buffer, np.array([1]), np.array([1 + len(w)]))]
        flat = np.concatenate(picked).astype(float)
        assert len(flat) == 1 + sum(max(0, len(w) + 3 - n) for n in toxicity.ORDERS)
        odds.append(flat.mean() - 0.5)
    text = toxicity.plain("Badger, ox! caterpillar badger")
    assert np.allclose(model.texts([text, b"", text]), 1 / (1 + np.exp(-np.array([max(odds), -0.5, max(odds)]))))


def test_hinge_by_dual_descent_is_optimal():
    """Ratios equal plain counting, and no primal step improves the hinge objective."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(80)]
    y = np.where([(r < 12).sum() > (r >= 18).sum() for r in rows], 1, -1)
    model = quality._fit_hinge(rows, y, rounds=400)
    counts = {k: np.ones(1 << quality.BITS) for k in (1, -1)}
    for ids, label in zip(rows, y):
        counts[label][ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    assert np.allclose(model.squares, ratio**2, rtol=1e-5)
    x = np.zeros((80, 31))
    for i, ids in enumerate(rows):
        x[i, ids] = ratio[ids] / max(1.0, np.sqrt((ratio[ids] ** 2).sum()))
    x[:, 30] = 1
    cost = np.where(y == 1, 80 / (2 * (y == 1).sum()), 80 / (2 * (y == -1).sum()))
    goal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w = np.append(model.weights[:30] / np.where(ratio[:30] == 0, 1, ratio[:30]), model.bias)
    best, at = goal(w), np.zeros(31)
    for step in range(1, 30_000):  # plain subgradient descent, from nothing
        active = (1 - y * (x @ at)) > 0
        at = at - (at - (cost * y * active) @ x) / step
        best = min(best, goal(at))
    assert goal(w) <= best * 1.01 + 1e-6


def test_fusion_equals_bayes_row_by_row(spark):
    """Priors without a row's own posterior at any level, smoothed down to the host, times all likelihoods."""
    rng = np.random.default_rng(7)
    hosts = ["a.x.de", "b.x.de", "c.y.fr", "c.y.fr", "a.x.de", "", "z.w.de"]
    ll, k, strength = rng.normal(size=(7, 4)), 4, 5.0
    own = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True)
    group = lambda f: [f(h) for h in hosts]
    keys = [group(lambda h: h.rpartition(".")[2]), group(lambda h: ".".join(h.split(".")[-2:])), hosts]
    levels = np.array([[own[[x == key[i] for x in key]].sum(axis=0) for key in keys] for i in range(7)])
    tables = [np.log(rng.dirichlet(np.ones(4), 4)) for _ in range(2)]
    declared, suffix = np.array([0, -1, 2, 3, -1, 1, 0]), np.array([1, 1, 2, -1, 1, -1, 1])
    got = language.Evidence(own.sum(axis=0), *tables).posterior(ll, np.array([h != "" for h in hosts]), levels, declared, suffix, strength)
    for i in range(7):
        others = [j for j in range(7) if j != i]
        prior = own[others].sum(axis=0) + 1
        prior /= prior.sum()
        if hosts[i]:
            for key in keys:
                left = sum((own[j] for j in others if key[j] == key[i]), np.zeros(k))
                prior = (left + strength * prior) / (left.sum() + strength)
        score = ll[i] + np.log(prior) + (tables[0][declared[i]] if declared[i] >= 0 else 0) + (tables[1][suffix[i]] if suffix[i] >= 0 else 0)
        want = np.exp(score - score.max())
        assert np.allclose(got[i], want / want.sum())


def test_entire_texts_of_usual_licences(spark):
    folder = pathlib.Path(licenses.__file__).parent / "texts"
    want = {x.name.removesuffix(".txt"): x.read_text() for x in folder.iterdir()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(want)
    rows = [(name, some) for name, x in want.items() for some in (x, " ".join(x.upper().split(" ")))]
    assert all(r.license_id == r.name for r in licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect())
