"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Base rules reject a text of under 20 words, or with over 30 % of its words in repeated runs of eight. Further rules
reject where a statistic reaches a cutoff, and the cutoffs are not guessed: for each rule and stratum (language) the
labelled good documents are the holdout, cutoffs are tried from the loosest to the strictest, and one is accepted
while the exact binomial test rejects "it wrongly rejects more than `risk` / rules of good documents" at level
`delta` / (rules * strata). The first failure ends a rule's sequence, so the sequence itself costs no level; rules
and strata share it by Bonferroni. With probability 1 - delta all accepted cutoffs together wrongly reject at most
`risk` of good documents in every stratum. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_WHITE = " \t\n\x0b\x0c\r"
#: Cutoffs of each rule, loosest first; a text is rejected where its statistic is at least the cutoff.
RULES: dict[str, list[float]] = {
    "symbols_per_word": [4.0, 2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeated_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeated_word_share": [0.29, 0.27, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1],
    "long_words": [50.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
    "short_words": [-1.0, -1.5, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5],
}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words in 8-word windows that occur twice or more, from the windows' hashes in order."""

    def covered(pairs: Column) -> Column:
        def twin(pair: Column, i: Column) -> Column:
            same = lambda other: F.coalesce(other["h"] == pair["h"], F.lit(False))
            return F.when(same(F.get(pairs, i - 1)) | same(F.get(pairs, i + 1)), pair["p"])

        places = F.array_sort(F.filter(F.transform(pairs, twin), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last"))
        add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, add, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(pairs, covered)).otherwise(0)


def statistics(docs: DataFrame, text: str = "text", stratum: str = "lang", doc: str = "doc_id") -> DataFrame:
    """doc_id, stratum and the base counts of each text; a null text has no words; a null stratum is one of its own."""
    raw = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = raw.withColumn("w", common.words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _WHITE, "")) > 0)
    n = F.size("w")
    hashes = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("w", i, 8)))).otherwise(F.expr("array(cast(null as bigint))"))
    sized = cut.select(
        "doc_id", "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("line"),
        _let(hashes, _repeat_words).cast("long").alias("n_repeat_words"),
    )
    return sized.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", F.col("line.dup").cast("long").alias("n_dup_lines"), F.col("line.n").cast("long").alias("n_lines"), "n_repeat_words")


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "repeated_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeated_word_share": F.col("n_repeat_words") / n,
        "long_words": F.col("word_chars") / n,
        "short_words": -F.col("word_chars") / n,
    }


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), by the ratio of neighbouring terms in logarithms."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("t"), F.lit(0.0).alias("s"))

    def add(acc: Column, j: Column) -> Column:
        return F.struct((acc["t"] + F.log(F.greatest(n - j, F.lit(1)).cast("double") / (j + 1)) + F.lit(odds)).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, add, lambda acc: acc["s"])


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """stratum, rule, cutoff: the strictest accepted cutoff of each rule and stratum that has one.

    labels: doc_id, quality (1: good). A document is good if any of its labels is; a null label counts for nothing.
    """
    rules = rules or RULES
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    held = stats.where(~_base_failed()).join(good, "doc_id", "left_semi")
    measures = _measures()
    reached = lambda r, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: measures[r] >= c))
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), reached(r, grid).alias("from_end")) for r, grid in rules.items()])
    # a statistic that reaches the last `from_end` cutoffs of a grid (they grow ever easier to reach) is rejected by those
    counts = held.select("stratum", F.explode(steps).alias("s")).groupBy("stratum", "s.rule", "s.from_end").count()
    sizes = held.groupBy("stratum").agg(F.count("*").alias("n"))
    grids = F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.array(*map(F.lit, g)) for g in rules.values()]))
    tried = sizes.select("stratum", "n", F.explode(grids).alias("rule", "grid")).select("stratum", "n", "rule", F.posexplode("grid").alias("place", "cutoff"), F.size("grid").alias("length"))
    wrong = tried.join(counts, ["stratum", "rule"], "left").groupBy("stratum", "n", "rule", "place", "cutoff").agg(
        F.coalesce(F.sum(F.when(F.col("from_end") >= F.col("length") - F.col("place"), F.col("count"))), F.lit(0)).alias("k")
    )
    part = risk / len(rules)
    level = sizes.agg((F.lit(delta) / (len(rules) * F.greatest(F.count("*"), F.lit(1)))).alias("level"))
    # beyond its mean a binomial's lower tail is over any level in use, so the sum need not go there
    safe = F.when(F.col("k") > F.col("n") * part, F.lit(False)).otherwise(_tail(F.least(F.col("k"), F.ceil(F.col("n") * part)), F.col("n"), part) <= F.col("level"))
    judged = wrong.crossJoin(F.broadcast(level)).withColumn("safe", safe)  # level is one row
    ends = judged.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("safe"), F.col("place"))).alias("fails"))
    return judged.join(ends, ["stratum", "rule"]).where("fails is null or place < fails").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, text: str = "text", stratum: str = "lang", doc: str = "doc_id") -> DataFrame:
    """The statistics of each document, base_failed and kept. Repeated rows, ties and null ids are judged like others."""
    stats = common.cut(statistics(docs, text, stratum, doc))
    chosen = cutoffs(stats, labels, risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    chosen = common.cut(chosen)
    if chosen.count() <= 10_000:
        chosen = F.broadcast(chosen)
    both = stats.join(chosen, "stratum", "left")
    failed = F.lit(False)
    for rule, value in _measures().items():
        failed = failed | F.coalesce(value >= F.col("limits")[rule], F.lit(False))
    return both.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~failed).drop("limits")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base counts and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(risk: float = 0.05, delta: float = 0.05) -> str:
    measure = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)::double",
        "repeated_line_share": "n_dup_lines / greatest(n_lines, 1)::double",
        "repeated_word_share": "n_repeat_words / greatest(n_words, 1)::double",
        "long_words": "word_chars / greatest(n_words, 1)::double",
        "short_words": "-word_chars / greatest(n_words, 1)::double",
    }
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, {i} AS place, {c}::double AS cutoff" for r, g in RULES.items() for i, c in enumerate(g))
    values = " UNION ALL ".join(f"SELECT rid, stratum, '{r}' AS rule, {m} AS v FROM s WHERE NOT base_failed" for r, m in measure.items())
    p = risk / len(RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[ \t\n\x0B\f\r]+', '', 'g')) > 0) AS l FROM documents),
g AS (SELECT rid, p, array_to_string(w[p:p+7], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8) x),
f AS (SELECT rid, p, p - lag(p) OVER (PARTITION BY rid ORDER BY p) AS gap FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) x WHERE c > 1),
r AS (SELECT rid, sum(least(8, coalesce(gap, 8))) AS n FROM f GROUP BY rid),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (SELECT d.rid, doc_id, stratum, len(w)::bigint AS n_words,
  length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::bigint AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
  (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, len(l)::bigint AS n_lines, coalesce(r.n, 0)::bigint AS n_repeat_words FROM d LEFT JOIN r ON d.rid = r.rid) x),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
v AS ({values}),
held AS (SELECT v.* FROM v JOIN s ON v.rid = s.rid WHERE s.doc_id IN (SELECT doc_id FROM good)),
n AS (SELECT stratum, count(DISTINCT rid) AS n FROM held GROUP BY stratum),
k AS (SELECT n.stratum, n.n, grid.rule, place, cutoff, (SELECT count(*) FROM held h WHERE h.stratum = n.stratum AND h.rule = grid.rule AND h.v >= cutoff) AS k FROM n, ({grid}) grid),
z AS (SELECT *, k <= n * {p!r} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) <= {delta!r} / ({len(RULES)} * (SELECT greatest(count(*), 1) FROM n)) AS safe FROM k),
c AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, min(CASE WHEN NOT safe THEN place END) OVER (PARTITION BY stratum, rule) AS fails FROM z) x WHERE fails IS NULL OR place < fails GROUP BY ALL),
b AS (SELECT DISTINCT v.rid FROM v JOIN c ON v.stratum = c.stratum AND v.rule = c.rule WHERE v.v >= c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND s.rid NOT IN (SELECT rid FROM b) AS kept FROM s
"""
