"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, fresh, let, table, words_of

#: Fewest words, and the highest share in percent of words in repeated three-word windows.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Metric, least distance of its fence from the quartiles (thousandths), whether low values are fenced too.
METRICS = (("mean_length", 1000, True), ("symbols", 250, False), ("dup_lines", 300, False), ("repeated", 250, False))
#: Fences lie this many interquartile ranges beyond the quartiles.
REACH = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A sketch of fewer texts is too thin; the next wider one serves: source and language, language, all.
LEAST = 50


def _repeated(grams: Column) -> Column:
    """Words covered by the windows whose fingerprint comes twice or more, from an array of fingerprints by position."""

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["g"] == p["g"], F.lit(False))
        starts = F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"])
        return let(F.sort_array(starts), covered)

    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, twice))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of each whole text: ``n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words``.

    A text of any length is counted whole, in one row; it takes about 50 bytes a word. Columns of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines, triples = fresh(docs, "words", "lines", "grams")
    df = docs.withColumns({words: words_of(F.col(text)), lines: F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    n = F.size(words)
    grams = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn(triples, grams)
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(F.col(triples)).cast("long"),
    }).drop(words, lines, triples)


def bin_of(v: Column) -> Column:
    """The sketch's bin of a whole number from 0 on: exact below 64, then 32 bins to each power of two."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(e * 32 + F.expr("shiftright(v, length(bin(v)) - 6)")).cast("long")


def bin_end(b: Column) -> Column:
    """The highest value of a bin."""
    return F.expr("CASE WHEN b < 64 THEN b ELSE shiftleft(b - (b div 32 - 1) * 32 + 1, CAST(b div 32 - 1 AS INT)) - 1 END")


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key, metric and bin. Sketches merge by adding counts, so they come from partial sums and no key is gathered whole."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("v")) for m, _, _ in METRICS)))
    df = measured.select(*keys, each.alias("x")).select(*keys, "x.metric", F.col("x.v").alias("v"))
    return df.withColumn("b", bin_of(F.col("v"))).groupBy(*keys, "metric", "b").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile by key and metric. A window holds the bins of one sketch, some 2,000 rows at most."""
    by = Window.partitionBy(*keys, "metric")
    run = sketch.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("b"))}).withColumn("end", bin_end(F.col("b")))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("end")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(measured: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per pair of keys with ``lo_``/``hi_`` of each metric, from the narrowest sketch with enough texts."""
    one, both = [keys[0]], list(keys)
    fine = cut(sketches(measured, both))
    levels = [_quartiles(fine, both)] + [_quartiles(fine.groupBy(*k, "metric", "b").agg(F.sum("n").alias("n")), k) for k in (one, [])]
    df = levels[0].select(*both, "metric", F.struct("total", "q1", "q3").alias("x0"))
    for i, k in ((1, one), (2, [])):
        wide = levels[i].select(*(F.col(c).alias(f"_{c}") for c in k), F.col("metric").alias("_m"), F.struct("total", "q1", "q3").alias(f"x{i}"))
        on = F.col("metric") == F.col("_m")
        for c in k:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        df = df.join(wide, on).drop("_m", *(f"_{c}" for c in k))
    x = F.when(F.col("x0.total") >= LEAST, F.col("x0")).when(F.col("x1.total") >= LEAST, F.col("x1")).otherwise(F.col("x2"))
    df = df.withColumn("x", x)
    reach = REACH * (F.col("x.q3") - F.col("x.q1"))
    pick = lambda m, v: F.max(F.when(F.col("metric") == m, v))
    return df.groupBy(*both).agg(*(pick(m, F.col("x.q3") + F.greatest(reach, F.lit(slack))).alias(f"hi_{m}") for m, slack, _ in METRICS), *(pick(m, F.col("x.q1") - F.greatest(reach, F.lit(slack))).alias(f"lo_{m}") for m, slack, low in METRICS if low))


def judge(docs: DataFrame, keys: tuple[str, str] = ("lang", "source"), text: str = "text") -> DataFrame:
    """Adds counts (``COUNTS``), ``base_failed`` and ``kept`` to the columns of ``docs`` but ``text``.

    A text fails the base rules with under 50 words or over half of its words in repeated three-word windows. The
    sketches hold the texts that pass them. A text is kept if it passes and no metric lies beyond the fences of its
    language and source; where a sketch has fewer than ``LEAST`` texts, the fences of its language serve, and those of
    all texts where that has too few as well. Null text counts as empty (base_failed); null keys form groups of their
    own; an empty table gives no rows; repeated rows are judged each alike; texts of any length are judged whole.
    Other columns stay, whatever their names, unless named as one of those added.
    """
    # columns go by number meanwhile, so none can be taken for one of the operator's own
    own = {c: f"u{i}" for i, c in enumerate(docs.columns)}
    stay = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "kept") and (c != text or text in keys)]
    df = measure(docs.select(*(F.col(c).alias(u) for c, u in own.items())), own[text])
    by = (own[keys[0]], own[keys[1]])
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(F.lit(0)).cast("long")
    df = df.withColumns({
        "m_mean_length": per("word_chars", "n_words"), "m_symbols": per("n_symbols", "n_words"), "m_dup_lines": per("n_dup_lines", "n_lines"), "m_repeated": per("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED),
    })
    df = cut(df.select(*dict.fromkeys([*(own[c] for c in stay), *by]), *COUNTS, "base_failed", *(f"m_{m}" for m, _, _ in METRICS)))
    limits = thresholds(df.filter(~F.col("base_failed")), by)
    limits = limits.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), *(c for c in limits.columns if c not in by))
    on = F.col(by[0]).eqNullSafe(F.col("k0")) & F.col(by[1]).eqNullSafe(F.col("k1"))
    fine = F.lit(True)
    for m, _, low in METRICS:
        fine &= F.col(f"m_{m}") <= F.col(f"hi_{m}")
        if low:
            fine &= F.col(f"m_{m}") >= F.col(f"lo_{m}")
    df = df.join(limits, on, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))
    return df.select(*(F.col(own[c]).alias(c) for c in stay), *COUNTS, "base_failed", "kept")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    spaces = "'[\\x20\\x09-\\x0D]+'"
    fence = lambda m, slack: f"max(CASE WHEN metric = '{m}' THEN q3 + greatest({REACH} * (q3 - q1), {slack}) END) AS hi_{m}, max(CASE WHEN metric = '{m}' THEN q1 - greatest({REACH} * (q3 - q1), {slack}) END) AS lo_{m}"
    quart = lambda src, keys: f"SELECT {keys} metric, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN e END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN e END) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} metric) AS total, sum(n) OVER (PARTITION BY {keys} metric ORDER BY b) AS upto, CASE WHEN b < 64 THEN b ELSE ((b - (b // 32 - 1) * 32 + 1) << (b // 32 - 1)) - 1 END AS e FROM {src}) GROUP BY {keys} metric"
    fails = " AND ".join([f"m_{m} <= hi_{m}" for m, _, _ in METRICS] + [f"m_{m} >= lo_{m}" for m, _, low in METRICS if low])
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, m_{m} AS v FROM m WHERE NOT base_failed" for m, _, _ in METRICS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT rid, doc_id, lang, source, t, list_filter(regexp_split_to_array(t, {spaces}), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3),
h AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM h) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
f AS (SELECT a.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN rep USING (rid)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS m_mean_length, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS m_symbols,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS m_dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS m_repeated,
  n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM f),
k AS (SELECT lang, source, metric, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS b, count(*) AS n FROM ({each}) GROUP BY ALL),
k1 AS (SELECT lang, metric, b, sum(n) AS n FROM k GROUP BY ALL), k2 AS (SELECT metric, b, sum(n) AS n FROM k GROUP BY ALL),
x0 AS ({quart("k", "lang, source,")}), x1 AS ({quart("k1", "lang,")}), x2 AS ({quart("k2", "")}),
x AS (SELECT x0.lang, x0.source, x0.metric, CASE WHEN x0.total >= {LEAST} THEN x0.q1 WHEN x1.total >= {LEAST} THEN x1.q1 ELSE x2.q1 END AS q1,
  CASE WHEN x0.total >= {LEAST} THEN x0.q3 WHEN x1.total >= {LEAST} THEN x1.q3 ELSE x2.q3 END AS q3
  FROM x0 JOIN x1 ON x0.lang IS NOT DISTINCT FROM x1.lang AND x0.metric = x1.metric JOIN x2 ON x0.metric = x2.metric),
y AS (SELECT lang, source, {", ".join(fence(m, slack) for m, slack, _ in METRICS)} FROM x GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({fails}, false) AS kept
FROM m LEFT JOIN y ON m.lang IS NOT DISTINCT FROM y.lang AND m.source IS NOT DISTINCT FROM y.source"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": oracle()}
