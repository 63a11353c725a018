import re
from collections import Counter

from weft.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c a b c", "x" * 100_000, "line\nline\n\nline \n", "a a a a a", "é ñ <b> & \U0001f600 |", "w " * 60, " ".join(f"w{i}" for i in range(80)), "a b c"]


def test_counts_by_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in enumerate(TEXTS + TEXTS[3:5])], "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(df.collect())
    for i, t in enumerate(TEXTS + TEXTS[3:5]):
        r, want = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_thresholds_follow_language_and_source(spark):
    clean = [(i, " ".join(f"w{i + 100}x{k + 10}" for k in range(60 + i % 9)), "en", None) for i in range(120)]
    odd = [(999, " ".join(f"{'y' * 90}{k}" for k in range(60)), "en", None), (1000, " ".join(f"##{k}" for k in range(60)), "en", None)]
    df = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.judge(df).filter("kept").collect()}
    assert kept == set(range(120))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(df).collect() == []


def test_clashing_columns_stay(spark):
    text = " ".join(f"w{k}" for k in range(80))
    names = "n_lines hi_symbols lo_mean_length m_repeated _words words v b metric x k0 u0 total"
    df = spark.createDataFrame([(i, text, "en", "s", *range(13)) for i in range(3)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names.split()))
    rows = quality.judge(df).collect()
    assert len(rows) == 3 and all(r.kept and [r[n] for n in names.split()] == list(range(13)) for r in rows)
