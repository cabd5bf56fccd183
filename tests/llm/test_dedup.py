import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from factloom.llm import codes, graph, mixing, simhash, substrings

DOC = "doc_id long, text string, source string, bucket string"


def texts(seed=3, n=60):
    """Documents with copies, near copies, shared passages, repeats, ties, nulls, an empty and a very long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cde f ghij klm no pqr s tuv wx yz Ä ß".split()) + str(rng.randrange(40))
    passage = [word() for _ in range(40)]
    out = []
    for i in range(n):
        body = [word() for _ in range(rng.randrange(0, 120))]
        if i % 4 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(5) :]
        out.append(rng.choice([" ", "\n", " \t", "\x0b"]).join(body))
    out[5] = out[2]
    out[7] = out[2].upper() if out[2] else "X"
    out[9], out[11], out[13] = None, "", "  \n "
    out[15] = " ".join(passage * 300)
    out[17] = "one two"
    out[19] = " ".join(passage[:13])
    return out


def brute_substrings(rows, width):
    seen = defaultdict(set)
    parts = {i: (t or "").encode().split() for i, t in rows}
    for i, w in parts.items():
        for a in range(len(w) - width + 1):
            seen[tuple(w[a : a + width])].add(i)
    out = {}
    for i, w in parts.items():
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if min(seen[tuple(w[a : a + width])]) < i:
                gone[a : a + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, tmp_path):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "s", "kept") for i, t in rows], DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_digest(spark, str(tmp_path)).collect()}
    assert got == brute_substrings(rows, 13)
    small = substrings.dedup_substrings(df, 3, bucket_bytes=500, group_suffixes=50)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest()) for r in small.collect()}
    assert got == brute_substrings(rows, 3)
    assert small.columns[:4] == df.columns and {r.bucket for r in small.select("bucket").collect()} == {"kept"}
    assert small.where("text is null and kept_text is not null").count() == 0


def test_substrings_null_ids_and_empty_tables(spark):
    long_ = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, long_), (1, long_), (1, long_), (2, long_)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in substrings.dedup_substrings(df).collect())
    assert got == [(1, 0), (1, 0), (2, 20), (99, 20)]
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_substrings_of_colliding_words(spark):
    """Words whose polynomial hashes are equal modulo any power of 2, for any base, are different words."""
    letters = "a"
    for _ in range(10):
        letters += letters.translate(str.maketrans("ab", "ba"))
    other = letters.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{shared} {letters}"), (2, f"{shared} {other}"), (3, f"{shared} {letters}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup_substrings(df).collect()} == {1: 0, 2: 0, 3: 13}


def test_substrings_of_hot_ids(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(rng.choice([7, 7, 7, None, None, rng.randrange(100)]), f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(20))} {passage}") for _ in range(600)]
    ids = [r[0] for r in rows if r[0] is not None]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), bucket_bytes=2000, group_suffixes=500).collect()
    assert len(got) == 600 and all(r.n_removed == (0 if r.doc_id == min(ids) else 15) for r in got)


def test_equal_codes_are_told_apart_by_their_checks():
    code, check = np.array([5, 5, 3, 5, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint32)
    order, head = codes.sort_codes(code, check)
    assert order.tolist() == [2, 0, 3, 1, 4] and head.tolist() == [True, True, False, True, False]
    packed = substrings._unpack(substrings._pack(np.array([1, 2**63, 2**64 - 1], np.uint64), np.array([7, 8, 9], np.uint32)))
    assert packed[0].tolist() == [1, 2**63, 2**64 - 1] and packed[1].tolist() == [7, 8, 9]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def near(rng, fp, bits):
    for k in rng.sample(range(64), bits):
        fp ^= 1 << k
    return fp


def test_fingerprints_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOC)
    got = {r.doc: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in rows}


def test_simhash_components(spark, tmp_path):
    rows = list(enumerate(texts(8, 50)))
    spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(spark, str(tmp_path)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_components([(a, b) for a in fps for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    empty = spark.createDataFrame([], DOC)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_join_all_pairs_in_any_bucket_size(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {near(rng, centre, rng.randrange(7)) for _ in range(120)}
    ordered = sorted(fps)
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in ordered], "fp long")
    found = [(r.a, r.b) for r in simhash.links(df, 4, most=20).collect()]
    all_ = [(signed(a), signed(b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert brute_components(found) == brute_components(all_)


def test_masks_cover_the_radius():
    rng = random.Random(2)
    for family in range(3):
        every = [m & (2**64 - 1) for m in simhash.masks(4, family)]
        assert len(every) == 31
        for _ in range(500):
            difference = near(rng, 0, 4)
            assert any(m & difference == 0 for m in every)


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(1, 1), (3, 2), (2, 3)]
    for most in (0, 10**6):
        got = graph.components(spark.createDataFrame(pairs, "a long, b long"), most).collect()
        assert {r.node: r.root for r in got} == {k: v for k, v in brute_components(pairs).items() if k != 1} and len(got) == len({r.node for r in got})
        assert graph.components(spark.createDataFrame([], "a long, b long"), most).count() == 0


def test_mixing(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "x") for i, t in enumerate(texts(4, 90))]
    rows += [(i, "lone " * 9, "rare", "x") for i in range(200, 203)]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mix(df, block=8).collect()
    again = mixing.mix(df.repartition(5).orderBy("text"), block=8).collect()
    key = lambda r: r.doc_id
    assert sorted(got, key=key) == sorted(again, key=key)
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    order = ["rare", "s0", "s1", "s2", None]
    total = {s: sum(size[i] for i, _, k, _ in rows if k == s) for s in order}
    target = dict(zip(order, mixing.fill(np.array([total[s] for s in order]), np.array([5, 2, 1, 5, 2]), 1.5 * sum(total.values()), 2)))
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6 and target["rare"] == 54
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 8
    assert mixing.mix(df.limit(0)).count() == 0


def test_sainte_lague_by_quotients():
    rng = np.random.default_rng(3)
    for _ in range(200):
        votes, seats = rng.integers(0, 50, rng.integers(1, 9)), int(rng.integers(0, 60))
        if not votes.sum():
            continue
        want = np.zeros(len(votes), int)
        for _ in range(seats):
            want[int(np.argmax(votes / (2 * want + 1)))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want.tolist()


def test_near_copies_and_clashing_names(spark):
    rng = random.Random(9)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(n)) for n in (120, 300, 800)]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        return " ".join(w)

    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, edited(base[k % 3], 1 + (k % 3))) for k in range(30)]
    rows += [(100 + k, " ".join(f"z{rng.randrange(2000)}" for _ in range(150))) for k in range(40)]
    rows += [(200, None), (201, ""), (0, base[0]), (None, base[1])]
    df = spark.createDataFrame([(*r, 1, 2, "g") for r in rows], "doc_id long, text string, h int, k int, gone string")
    kept = sorted(r.doc_id for r in simhash.without_copies(df).collect())
    assert kept == [0, 1, 2, *range(100, 140), 200, 201]
    assert simhash.without_copies(df.limit(0)).count() == 0
    mixed = mixing.mix(df.withColumn("source", df.gone))
    assert mixed.count() == len(rows) and {r.k for r in mixed.collect()} == {2}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute_copies(rows):
    """Components of documents with a similarity of 0.8 or more, in integers."""
    sets = {i: shingles(t) for i, t in rows}
    return brute_components([(a, b) for a in sets for b in sets if a <= b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def partly(rng, words, share):
    """The words with a run of them replaced."""
    n = int(len(words) * share)
    at = rng.randrange(len(words) - n + 1)
    return words[:at] + [f"n{rng.randrange(10**6)}" for _ in range(n)] + words[at + n :]


def test_near_copies_miss_no_pair(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 150]))]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(partly(rng, words, rng.uniform(0.03, 0.12))))]
    template = [f"t{k}" for k in range(100)]
    for k in range(60):  # about 0.75 from each other; some have a copy at 0.8 or more
        words = partly(rng, template, 0.08)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(partly(rng, words, 0.05)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_copies(rows)
    assert 100 < len(set(want.values())) < 300
    assert {r.doc: r.component for r in simhash.near_copies(df).collect()} == want
    assert {r.doc: r.component for r in simhash.near_copies(df, most=16).collect()} == want


def test_near_copies_go_by_covering_fingerprints(spark, monkeypatch):
    rng = random.Random(12)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [fps[rng.randrange(150)] ^ sum(1 << k for k in rng.sample(range(64), rng.choice([0, 1, 3, 4, 5, 6]))) for _ in range(300)]
    nodes = [(rng.getrandbits(63), int(np.array([x], np.uint64).view(np.int64)[0])) for x in fps]
    near = [(a, b) for a, x in nodes for b, y in nodes if a <= b and ((x ^ y) & (2**64 - 1)).bit_count() <= 4]
    found = [(r.a, r.b) for r in simhash._by_fingerprint(spark.createDataFrame(nodes, "node long, fp long")).collect()]
    assert all(a < b for a, b in found) and brute_components(found + [(a, a) for a, _ in nodes]) == brute_components(near)

    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius: asked.append((fps.count(), radius)) or links(fps, radius))
    words = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *words])), (3, " ".join(words[:6]))]
    kept = simhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and [radius for _, radius in asked] == [4]


def test_near_copies_judge_long_texts_on_whole_sets(spark):
    rng = random.Random(6)
    rows = []
    for k in range(80):  # similarity just above and just below 0.8
        words = [f"w{rng.randrange(9**6)}" for _ in range(900)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(partly(rng, words, (0.1, 0.114)[k % 2])))]
    want = brute_copies(rows)
    assert len(set(want.values())) == 120
    assert {r.doc: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_count_repeated_shingles_once(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["na"] * 200 + [f"w{rng.randrange(9**6)}" for _ in range(60)])) for k in range(20)]
    words = [f"v{k}" for k in range(80)]
    rows += [(30, " ".join(words)), (31, " ".join(words + words[:9] * 40))]
    want = brute_copies(rows)
    assert want[31] == 30 and len(set(want.values())) == 21
    assert {r.doc: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_copies_without_ids(spark):
    rng = random.Random(8)
    new = lambda: [f"w{rng.randrange(9**6)}" for _ in range(100)]
    join = " ".join
    named, alone, other = new(), new(), new()
    rows = [(1, join(named), "a"), (None, join(partly(rng, named, 0.03)), "b"), (None, join(named), "c")]
    rows += [(None, join(alone), "d"), (None, join(alone), "e"), (None, join(partly(rng, alone, 0.03)), "f"), (None, join(other), "g")]
    rows += [(None, None, "h"), (None, " ", "i"), (None, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    least = min((hashlib.md5(t.encode()).hexdigest(), s) for _, t, s in rows[3:6])[1]
    for some in (df, df.repartition(5).orderBy("text")):
        assert sorted(r.source for r in simhash.without_copies(some).collect()) == sorted(["a", least, "g", "h", "h", "i"])


def test_mixing_meets_targets_of_small_sources(spark):
    rows = [(i, "one two three four five", "s1", "x") for i in range(12000)]
    rows += [(20000 + i, "w " * (30 + i % 40), "s0", "x") for i in range(60)] + [(30000, "w " * 40, "s2", "x")]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 3 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes, block = rng.integers(0, 90, rng.integers(1, 9)), int(rng.integers(1, 60))
        total = int(rng.integers(0, 2 * sizes.sum() + 1))
        words = mixing.deal(sizes, total, 2, block)
        assert words.sum() == total and (words <= 2 * sizes).all() and (words >= 0).all()
