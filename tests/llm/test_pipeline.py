import hashlib
from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
from factloom.llm import language, mixing, pieces
from tests.llm.test_dedup import brute_copies, brute_substrings


def test_stages_keep_their_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert out and all(r.round_trip for r in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeats", "mix", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_keep_columns_of_any_name(spark, sf):
    """Columns named like what a stage adds, nulls, empty texts, repeated rows and rows without ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    own = ["language", "Confidence", "posterior", "kept_text", "n_words", "n_removed", "size", "target", "taken", "source_size", "words_taken", "top_", "k__", "gone", "host_of"]
    extra = docs.selectExpr("*", *[f"'mine' AS {c}" for c in own])
    odd = spark.createDataFrame([(None, "the cat sat on the mat and the dog " * 5, "en", None, 1), (9001, None, None, "src1", 0), (9002, "", "xx", "src1", 0), (9003, " \n ", "en", "src1", 0)] + [(9004, "this is the very same row with a few words in it", "en", "src2", 9)] * 2, docs.schema)
    rows = extra.unionByName(odd.selectExpr("*", *[f"'mine' AS {c}" for c in own]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf)
        assert out.columns == rows.columns, name
        found = out.collect()
        assert found and all(r[c] == "mine" for r in found for c in own), name
    again = corpus_pipeline.without_near_copies(spark, rows, sf).collect()
    assert sum(r.doc_id == 9004 for r in again) == 1 and {9001, 9002, 9003} <= {r.doc_id for r in again}


def brute_languages(rows):
    """Language (or und) of each row, by trigrams counted one by one and Bayes' rule."""
    names = list(language.LANGUAGES)

    def cells(text):
        t = b" " + language._letters(text) + b" "
        grams = [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != 32 and not (t[i] == 32 and t[i + 2] == 32)]
        return [int((int.from_bytes(g, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 17) for g in grams]

    counts = np.full((4, 1 << 15), 0.5)
    every = [cells(r.text) for r in rows]
    for r, c in zip(rows, every):
        if r.text is not None and (r.lang or "").lower() in names:
            for cell, n in Counter(c).items():
                counts[names.index(r.lang.lower()), cell] += n
    model = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).astype(float)
    ll = np.array([model[:, c].sum(axis=1) * min(1, 200 / max(1, len(c))) if c else np.zeros(4) for c in every])
    own = np.exp(ll - ll.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    said = [names.index(r.lang[:2].lower()) if (r.lang or "")[:2].lower() in names else -1 for r in rows]
    table = np.array([sum((own[i] for i in range(len(rows)) if said[i] == c), np.zeros(4)) for c in range(4)]) + 2 + 18 * np.eye(4)
    table = np.log(table / table.sum(axis=0))
    total, by_host = own.sum(axis=0), {h: sum(own[i] for i, r in enumerate(rows) if (r.source or "") == h) for h in {r.source or "" for r in rows}}
    out = []
    for i, r in enumerate(rows):
        prior = total - own[i] + 1
        prior /= prior.sum()
        if r.source:
            for sums in (total, total, by_host[r.source]):  # sources have no domain and no suffix: all share one
                left = np.maximum(sums - own[i], 0)
                prior = (left + 5 * prior) / (left.sum() + 5)
        score = ll[i] + np.log(prior) + (table[said[i]] if said[i] >= 0 else 0)
        p = np.exp(score - score.max())
        p /= p.sum()
        out.append(names[int(p.argmax())] if p.max() >= 0.6 else "und")
    return out


def test_each_stage_equals_brute_force(spark, sf):
    """Each stage on what the one before kept."""
    rows = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    before = rows(docs)
    assert all("." not in (r.source or "") for r in before)

    told = [(r.doc_id, x) for r, x in zip(before, brute_languages(before)) if x != "und"]
    kept = corpus_pipeline.by_language(spark, docs, sf)
    kept = spark.createDataFrame(rows(kept), docs.schema)
    assert [(r.doc_id, r.lang) for r in rows(kept)] == told

    copies = brute_copies([(r.doc_id, r.text) for r in rows(kept) if r.text and r.text.split()])
    alone = spark.createDataFrame([r for r in rows(kept) if copies.get(r.doc_id, r.doc_id) == r.doc_id], docs.schema)
    assert rows(corpus_pipeline.without_near_copies(spark, kept, sf)) == rows(alone)

    want = brute_substrings([(r.doc_id, r.text) for r in rows(alone)], corpus_pipeline.PASSAGE)
    cut = corpus_pipeline.without_repeats(spark, alone, sf)
    cut = spark.createDataFrame(rows(cut), docs.schema)
    got = {r.doc_id: hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in rows(cut)}
    assert got == {i: h for i, (n, gone, h) in want.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in rows(cut))

    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows(cut)}
    text = {r.doc_id: r.text for r in rows(cut)}
    mixed = corpus_pipeline.mixed(spark, cut, sf)
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)
    taken = Counter()
    for r in mixed.collect():
        words = r.text.encode().split()
        taken[r.doc_id] += len(words)
        assert r.text == text[r.doc_id] or words == text[r.doc_id].encode().split()[: len(words)]
    assert all(n <= 2 * size[i] for i, n in taken.items())
    source = {r.doc_id: r.source for r in rows(cut)}
    names = sorted({x for x in source.values() if x is not None}) + [None] * (None in source.values())
    sizes = np.array([sum(size[i] for i in size if source[i] == x) for x in names])
    target = mixing.fill(sizes, np.array([(5, 2, 1)[i % 3] for i in range(len(names))]), 1.5 * sizes.sum(), 2)
    assert all(abs(sum(taken[i] for i in size if source[i] == x) - t) <= 1 for x, t in zip(names, target))

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = corpus_pipeline.encoded(spark, mixed, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r.doc_id, tuple(library.encode(r.text))) for r in mixed.collect()) and all(r.round_trip for r in out)
