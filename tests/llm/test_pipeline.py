import re
from collections import Counter

import corpus_pipeline as pipeline


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def first_of_groups(docs):
    """Brute force: of the documents that hang together by a similarity of 0.8 the one with the least id."""
    docs = sorted(docs, key=lambda r: r.doc_id)
    sets, root = [shingles(r.text) for r in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 5 * both >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {docs[i].doc_id for i in range(len(docs)) if find(i) == i}


def without_repeats(docs):
    """Brute force: texts without the bytes of 100-byte strings that start earlier; None where nothing is left."""
    seen, out = {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        data = (r.text or "").encode()
        gone, own = bytearray(len(data)), set()
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in own or w in seen:
                gone[s : s + 100] = b"\x01" * 100
            own.add(w)
        seen.update(dict.fromkeys(own))
        out[r.doc_id] = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
    return {k: t for k, t in out.items() if t}


def test_stages_one_by_one(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == list(pipeline.COLUMNS)
        before, docs = docs, out
        rows, were = out.collect(), before.collect()
        if k == 0:
            assert len(rows) >= 0.97 * len(were) and set(rows) <= set(were)
        elif k == 1:
            assert set(rows) <= set(were) and len(rows) == len({r.doc_id for r in rows})
            assert {r.doc_id for r in rows} == first_of_groups(were)
        elif k == 2:
            assert {r.doc_id: r.text for r in rows} == without_repeats(were)
            assert all(r.n_chars == len(r.text) for r in rows)
        elif k == 3:
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
            words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rs)
            assert abs(words(rows) - 1.5 * words(were)) < 0.02 * words(were)
        else:
            assert {r.doc_id for r in rows} == {r.doc_id for r in were}
    # the query runs the same stages, and reruns agree
    of = lambda df: sorted((r.doc_id, r.sample, r.n_ids, r.log_prob) for r in df.collect())
    assert of(pipeline.run(spark, data)) == of(docs)
