import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.llm import repeats
from weft.llm.common import Spans

N = repeats.LENGTH


def brute(rows):
    first, out = {}, {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        own, gone = {}, np.zeros(len(data), bool)
        for s in range(len(data) - N + 1):
            w = data[s : s + N]
            if w in own or (w in first and first[w] != key):
                gone[s : s + N] = True
            own.setdefault(w, s)
        for w in own:
            first.setdefault(w, key)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        out[key, text] = (len(data), int(gone.sum()), len(edge), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_spans", F.lit("x"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    out = repeats.remove_repeats(df.select("doc_id", "text", "n_spans"), into="sha", as_=repeats.digest, whole=sha)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out.collect()), key=str)


def check(spark, rows):
    want = brute(rows)
    assert run(spark, rows) == sorted(((k, *want[k, t]) for k, t in rows), key=str)


def words(rng, n, alphabet="abcdefghij é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_by_brute_force(spark):
    rng = random.Random(1)
    passages = [words(rng, k) for k in (99, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 120)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(0, 8))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 350), (101, "ab" * 200), (102, rows[3][1]), (103, None), (104, ""), (105, passages[4][:99])]
    check(spark, rows)


def test_long_period_and_order(spark):
    rng = random.Random(2)
    line = words(rng, 130) + "\n"
    check(spark, [(5, line * 40), (1, line + "tail"), (9, "x" + line), (None, line), (2, words(rng, 3000))])


def test_repeated_rows_and_keys(spark):
    rng = random.Random(3)
    t = words(rng, 300)
    check(spark, [(4, t), (4, t), (6, t + "z")])
    got = run(spark, [(4, t), (4, t + "more")])
    assert [r[2] for r in got] == [0, 0]  # rows of one key don't precede each other


def test_small_chunks_send_alike(spark, monkeypatch):
    rng = random.Random(4)
    p = words(rng, 500)
    rows = [(i, words(rng, 50) + p[i * 3 :] + words(rng, 50)) for i in range(30)]
    check(spark, rows)


def test_text_form_keeps_characters(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t), (2, "x" + t + "y"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.remove_repeats(df, into="text").collect()}
    assert got[3] == "short" and got[2].startswith("x") and got[2].endswith("y") and "�" not in "".join(got.values())


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def crowd_rows(n, seed=5):
    """A shared passage and a shared short string, each between other bytes in every document."""
    rng = random.Random(seed)
    passage, short = words(rng, 180), words(rng, 60)
    return [(i, words(rng, 90) + passage + words(rng, 90) + short + words(rng, 90)) for i in range(n)]


def test_crowded_anchor_is_no_single_group(monkeypatch):
    def deal(batches, key):
        """Batches by bucket, as an exchange makes them."""
        all_ = pa.Table.from_batches(list(batches))
        return [all_.filter(pa.compute.equal(all_.column(key), b)).combine_chunks().to_batches() for b in range(4)]

    rows = crowd_rows(12000)
    texts = pa.RecordBatch.from_pydict({"rid": pa.array([i for i, _ in rows]), "_order": pa.array([i for i, _ in rows]), "_text": pa.array([t for _, t in rows])})
    most, index = [0], repeats.in_order
    monkeypatch.setattr(repeats, "in_order", lambda text, *a: most.append(len(text)) or index(text, *a))
    sent = deal(repeats._send(4)(iter([texts])), "bucket")
    again = deal((b for x in sent for b in repeats._again(4, repeats.CROWD)(iter(x))), "bucket")
    answers = [(r, i) for x in again for b in repeats._gather(iter(x)) for r, i in zip(*(b.column(c).to_pylist() for c in ("rid", "items")), strict=True)]
    hot = np.concatenate([np.frombuffer(i, np.uint64) for r, i in answers if r == repeats.ALL])
    items = {r: i for r, i in answers if r != repeats.ALL}
    assert len(hot)
    hot = repeats.Crowd.of(hot)
    some = texts.append_column("items", pa.array([items.get(i, b"") for i, _ in rows], pa.binary()))
    met = deal(repeats._stretches(4, hot)(iter([some])), "bucket")
    gone = [b for x in met for b in repeats._first(4)(iter(x))]
    assert gone and max(most) <= 2 * repeats.HELD


def test_crowded_anchors_by_brute_force(spark):
    rng = random.Random(6)
    rows = crowd_rows(300)
    line = words(rng, 130)
    rows += [(5, rows[7][1][:200] + rows[9][1]), (5, rows[11][1] * 2), (None, line * 30), (400, line * 3 + rows[0][1])]
    want = brute(rows)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    for crowd in (0, 1, 64):
        out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), into="sha", as_=repeats.digest, whole=sha, crowd=crowd)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in out.collect()), key=str)
        assert got == sorted(((k, *want[k, t]) for k, t in rows), key=str)


def test_clashing_columns_stay(spark):
    rng = random.Random(8)
    t = words(rng, 300)
    rows = [(1, t, 3, "w", "r"), (2, "x" + t, 4, "w", "r"), (3, None, 5, "w", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, whole string, _text string")
    out = repeats.remove_repeats(df, into="text")
    assert out.columns == ["doc_id", "rid", "whole", "_text", "n_bytes", "n_removed", "n_spans", "text"]
    n = len(t.encode())
    assert sorted(map(tuple, out.collect())) == [(1, 3, "w", "r", n, 0, 0, t), (2, 4, "w", "r", n + 1, n, 1, "x"), (3, 5, "w", "r", 0, 0, 0, "")]


def test_buckets_follow_the_bytes(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(repeats, "BUCKET", 500)
    check(spark, [(i, words(rng, 40) + "p" * 20 + words(random.Random(1), 150)) for i in range(25)])


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    monkeypatch.setattr(repeats, "PIECE", 700)
    rng = random.Random(10)
    p = words(rng, 900)
    sent = [(1, words(rng, 4000) + p), (2, p[:450] + words(rng, 2500) + p), (3, words(rng, 1500) + p[:99]), (4, p * 3), (5, "z" * 2500)]
    check(spark, sent)
    assert sum(1 for _ in repeats._pieces(iter([pa.RecordBatch.from_pydict({"_text": [t for _, t in sent]})]))) > 10


def test_fingerprints_of_spans_are_those_of_their_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 600_000).astype(np.uint8)
    whole = Spans(data)
    for a, b in [(0, 5), (4090, 4100), (262_140, 262_150), (524_000, 600_000), (7, 599_999)]:
        assert whole.of(np.array([a]), np.array([b]))[0] == Spans(data[a:b].copy()).of(np.array([0]), np.array([b - a]))[0]
    every = whole.every(32)
    assert len(every) == len(data) - 31 and all(every[a] == Spans(data[a : a + 32].copy()).every(32)[0] for a in (0, 4095, 262_143, 262_144, len(every) - 1))
    assert len(Spans(data[:10]).every(32)) == 0 and Spans(data[:0]).sums.tolist() == [0]


def test_map_of_crowded_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    crowd = repeats.Crowd.of(h[:2500])
    assert crowd.has(h[:2500]).all() and crowd.has(h[2500:]).mean() < 0.01
    assert not repeats.Crowd.of(h[:0]).has(h).any()
    monkeypatch.setattr(repeats, "WORDS", 4)  # many anchors share a bit: more are dealt by window, none is missed
    small = repeats.Crowd.of(h[:2500])
    assert len(small.words) == 4 and small.has(h[:2500]).all()
