"""Near duplicates by the Jaccard similarity of word n-grams: a MinHash LSH forest, then exact verification.

Texts with the same set of shingles form a class; only classes are compared. Each of the forest's trees is the sorted
prefix trie of the classes' labels, which are stretches of their MinHash signatures. A class looks for company in each
tree in one node of its own path. It begins with the deepest nodes, and where that doesn't reach the target recall it
shortens its matched prefixes one value at a time, always where the recall gained costs the fewest further members:
nodes without company are free, crowded nodes stay deep. A pair of similarity s meets in a tree where it shares a
prefix of k values with probability s**k, so trees of depths k(1), k(2) ... miss it with the product of 1 - s**k(t);
the descent ends when that is at most 1 - ``RECALL`` for the least similarity.

What meets in a node is compared by signature, then by its sets, both inside tasks and in blocks of bounded bytes: no
row is ever made for a pair, and a node of M members, all different texts, is sent M / ``MEMBERS`` times. The links
among M different texts that are all alike are M * M / 2, and each is verified. A pair that meets in several trees
counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Spans, U, append, cut, fresh, grouped, mix, table, utf8, word_spans, written
from weft.sources.shared import remove

#: Words of a shingle; least similarity, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Trees of the forest; shortest prefix, and values of a label; share of pairs of the least similarity to be found.
TREES, SHORTEST, DEPTH, RECALL = 16, 3, 6, 0.9997
#: Pairs are dropped unseen when their signatures agree in fewer of TREES * DEPTH values: at the least similarity
#: that is six standard deviations below the mean.
AGREE = int(TREES * DEPTH * LEAST[0] / LEAST[1] - 6 * (TREES * DEPTH * LEAST[0] / LEAST[1] * (1 - LEAST[0] / LEAST[1])) ** 0.5)
#: Members of a node are compared in blocks of so many and of sets of so many bytes, each pair of blocks a group.
MEMBERS, SET_BYTES = 2048, 16 << 20
BLOCK, EDGES = 1 << 20, 100_000
STEP = U(0xD1342543DE82EF95)
SALTS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def missed(depth: np.ndarray) -> np.ndarray:
    """Logarithm of the chance that a pair of the least similarity shares no prefix of these lengths; trees are the last axis."""
    return np.log1p(-((LEAST[0] / LEAST[1]) ** np.asarray(depth, float))).sum(-1)


def descend(sizes: np.ndarray) -> np.ndarray:
    """Lengths of the prefixes that each class looks up in each tree, given the members (class, tree, ``SHORTEST`` to
    ``DEPTH``) of the nodes on its paths.

    From the full depth they are shortened where the recall gained costs least, to the target recall or the shortest.
    """
    depth = np.full(sizes.shape[:2], DEPTH, np.int64)
    gain = np.array([0.0] * (SHORTEST + 1) + [missed([k]) - missed([k - 1]) for k in range(SHORTEST + 1, DEPTH + 1)])
    open_ = np.arange(len(sizes))
    while len(open_ := open_[missed(depth[open_]) > np.log1p(-RECALL)]):
        k = depth[open_]
        here = np.take_along_axis(sizes[open_], k[..., None] - SHORTEST, 2)[..., 0]
        more = np.take_along_axis(sizes[open_], np.maximum(k - 1 - SHORTEST, 0)[..., None], 2)[..., 0] - here
        price = np.where(k > SHORTEST, (more + 1e-3) / np.maximum(gain[k], 1e-9), np.inf)
        tree = price.argmin(1)
        rest = np.isfinite(price[np.arange(len(open_)), tree])
        open_, tree = open_[rest], tree[rest]
        depth[open_, tree] -= 1
    return depth


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit fingerprints, and where those of each text begin.

    A text of one to four words has one: all its words.
    """
    data, at = utf8(column)
    start, end, first = word_spans(data, at)
    words = Spans(data).of(start, end)
    n = np.diff(first)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(n)), many)
    i = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    last = first[1:][doc]
    h = np.zeros(len(i), np.uint64)
    for j in range(SHINGLE):
        there = i + j < last
        h = h * STEP + np.where(there, words[np.minimum(i + j, max(len(words) - 1, 0))] if len(words) else 0, U(j + 1))
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _signed(batch_column: pa.Array) -> list[pa.Array]:
    """Class, number of shingles, and signature: the labels of all trees, two bytes of each value."""
    h, at = shingle_sets(batch_column)
    n = np.diff(at)
    some = np.flatnonzero(n)
    add = lambda x: np.add.reduceat(x, at[some]) if len(some) else np.zeros(0, np.uint64)
    classes = np.zeros((len(n), 2), np.uint64)
    classes[some] = np.stack([add(mix(h)), add(mix(h ^ SALTS[0]))], 1) if len(some) else classes[some]
    values = np.zeros((len(n), TREES * DEPTH), np.uint64)
    for j in range(TREES * DEPTH):
        if len(some):
            x = h * SALTS[j]
            values[some, j] = np.minimum.reduceat(x ^ (x >> U(32)), at[some])
    values = mix(values)
    null = n == 0
    pack = lambda x: pa.array([None if e else v.tobytes() for v, e in zip(x, null, strict=True)], pa.binary())
    return [pack(classes), pa.array(n), pack((values & U(0xFFFF)).astype(np.uint16))]


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix lengths of each class, one byte a tree, from the nodes on its paths that have company."""
    for batch in batches:
        nodes = batch.column("nodes").to_pylist()
        sizes = np.ones((len(nodes), TREES, DEPTH - SHORTEST + 1))
        for x, of in enumerate(nodes):
            for n in of:
                sizes[x, n["t"], n["k"] - SHORTEST] = n["m"]
        depth = descend(sizes).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array([d.tobytes() for d in depth], pa.binary()), pa.array(depth.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["class", "depth", "looks"])


def _array(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of equal size."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _first_tree(sig_x: np.ndarray, sig_y: np.ndarray, depth_x: np.ndarray, depth_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tree in which pairs meet, and the length of the prefix of that node."""
    same = np.minimum.accumulate((sig_x == sig_y).reshape(-1, TREES, DEPTH), 2).sum(2)
    need = np.minimum(depth_x, depth_y)  # either looks the other up
    tree = (same >= need).argmax(1)
    return tree, need[np.arange(len(tree)), tree]


def _sides(lo: int, hi: int, i: np.ndarray, j: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both sides of a group: of a block with itself, or of two blocks."""
    return (np.arange(lo, hi),) * 2 if i[lo] == j[lo] else (lo + np.flatnonzero(b[lo:hi] == i[lo]), lo + np.flatnonzero(b[lo:hi] == j[lo]))


def _own_nodes(sig: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Fingerprint of the node that each member looks up in each tree; where two members' agree, they meet in that tree."""
    values = sig.reshape(-1, TREES, DEPTH).astype(np.uint64)
    path, own = np.zeros((len(sig), TREES), np.uint64), np.zeros((len(sig), TREES), np.uint64)
    for j in range(DEPTH):
        path = mix(path * STEP + values[:, :, j] + U(j + 1))
        own = np.where(depth == j + 1, path, own)
    return own


def _agree(sig: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose signatures agree enough, without such as look up the same node of one of the first trees before."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        row = left[a : a + step]
        open_ = row[:, None] != right[None]
        for e in range(min(tree, 6)):
            open_ &= own[row, e][:, None] != own[right, e][None]
        if open_.mean() > 0.25:
            few = max(1, (1 << 21) // max(1, len(right) * TREES * DEPTH))
            for b in range(0, len(row), few):
                part = row[b : b + few]
                x, y = np.nonzero(((sig[part][:, None] == sig[right][None]).sum(2, dtype=np.int32) >= AGREE) & open_[b : b + few])
                yield part[x], right[y]
        else:
            x, y = np.nonzero(open_)
            for b in range(0, len(x), 1 << 14):
                i, j = row[x[b : b + (1 << 14)]], right[y[b : b + (1 << 14)]]
                fine = (sig[i] == sig[j]).sum(1, dtype=np.int32) >= AGREE
                yield i[fine], j[fine]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of groups (node and pair of blocks) that have a promising partner in them."""
    names = ["g", "i", "j", "b", "t", "k", "class"]
    for batch in grouped(batches, "g"):
        g, i, j, b, t, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in names[:-1])
        sig, depth = _array(batch.column("sig"), np.uint16, TREES * DEPTH), _array(batch.column("depth"), np.uint8, TREES)
        own, hit = _own_nodes(sig, depth), np.zeros(len(g), bool)
        for lo, hi in _runs(g):
            if hi - lo < 2:
                continue
            for x, y in _agree(sig, own, *_sides(lo, hi, i, j, b), int(t[lo])):
                if len(x):
                    tree, prefix = _first_tree(sig[x], sig[y], depth[x], depth[y])
                    here = (tree == t[lo]) & (prefix == k[lo])
                    hit[x[here]] = hit[y[here]] = True
        some = np.flatnonzero(hit)
        yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (g, i, j, b, t, k)), batch.column("class").take(pa.array(some)).cast(pa.binary())], names)


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member that each of ``n`` is linked with, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each member inside its group, counted with copies, and a member it hangs together with."""
    num, den = LEAST
    for batch in grouped(batches, "g"):
        batch = batch.take(pc.sort_indices(batch, [("g", "ascending"), ("class", "ascending")]))
        g, i, j, b, t, k, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j", "b", "t", "k", "copies"))
        sig, depth = _array(batch.column("sig"), np.uint16, TREES * DEPTH), _array(batch.column("depth"), np.uint8, TREES)
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
        links, hub = np.zeros(len(g), np.int64), np.arange(len(g))
        for lo, hi in _runs(g):
            m = hi - lo
            if m < 2:
                continue
            size = np.array([len(s) for s in sets[lo:hi]])
            all_, code, times = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(m), size)
            shared = times[code] > 1  # what one member alone has is in no intersection
            owner, code = owner[shared], code[shared]
            left, right = (x - lo for x in _sides(lo, hi, i, j, b))
            common = np.zeros((len(left), len(right)), np.float32)
            _, code = np.unique(code, return_inverse=True)
            width = int(code.max()) + 1 if len(code) else 0
            step = max(64, (1 << 23) // m)
            order = np.argsort(code, kind="stable")
            owner, code = owner[order], code[order]
            for a in range(0, width, step):
                s, e = np.searchsorted(code, (a, a + step))
                dense = np.zeros((m, min(step, width - a)), np.float32)
                dense[owner[s:e], code[s:e] - a] = 1
                common += dense[left] @ dense[right].T
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a in range(0, len(left), 64):
                part = left[a : a + 64]
                near = common[a : a + 64] * (den + num) >= num * (size[part][:, None] + size[right][None]) - 0.5
                near &= part[:, None] != right[None]
                x, y = np.nonzero(near)
                x, y = part[x], right[y]
                tree, prefix = _first_tree(sig[lo + x], sig[lo + y], depth[lo + x], depth[lo + y])
                here = (tree == t[lo]) & (prefix == k[lo])
                x, y = x[here], y[here]
                np.add.at(links, lo + x, copies[lo + y])
                if i[lo] != j[lo]:
                    np.add.at(links, lo + y, copies[lo + x])
                found.append((np.arange(m), _components(m, x, y)))
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            hub[lo:hi] = lo + _components(m, x, y)
        some = np.flatnonzero(links)
        label = batch.column("label")
        yield pa.RecordBatch.from_arrays([label.take(pa.array(some)), pa.array(links[some]), label.take(pa.array(hub[some]))], ["label", "links", "hub"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node it hangs together with, for all nodes of the edges.

    Alternates large-star and small-star steps, each two aggregations; stars are written out after each round, in files
    of about ``EDGES`` rows.
    """
    files = edges.count() // EDGES + 1
    e, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), files)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("m < u")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, new = written(small.filter("u != v").distinct(), files)
        remove(e.sparkSession, path)
        path = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``class_id`` and ``n_links``.

    ``n_links`` is the number of other rows whose text is a near duplicate of this one's (equal sets of shingles
    included), ``class_id`` the least ``key`` it is linked with, directly or not. A text of one to four words counts
    as one shingle; null texts and such without a word are linked with nothing. Texts of any length are compared
    whole. Null keys come last; rows that repeat a key are rows of their own; ties go to the least key; an empty table
    gives no rows; other columns don't matter, whatever their names.
    """
    return _linked(docs, key, text).select(F.col("key").alias(key), F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("root.key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _node(t: Column, k: Column, label: Column) -> Column:
    """Hash of the node of a tree that holds a label's first ``k`` values."""
    return F.xxhash64(t, k, F.substring(label, F.lit(1), k * 2))


def _linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key rid n_links root`` of each row. ``rid`` is a hash of key and text, ``root`` the first row (``last key rid``)
    of those that hang together; null where the text has no word."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("rid"), F.col(text).alias("_text"))
    work = lambda batch: _signed(batch.column("_text"))
    signed = cut(append(rows, {"class": "binary", "n": "bigint", "sig": "binary"}, work, "_text", BLOCK, ("_text",)))
    # a class is named by its first row, so that the least name of what hangs together tells its least key
    name = F.struct(F.col("key").isNull().alias("last"), "key", "rid")
    classes = cut(signed.filter("n > 0").groupBy("class").agg(F.min(name).alias("label"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("t"), F.substring("sig", t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("path"))))
    paths = classes.select("class", "n", trees.alias("w")).select("class", "n", "w.t", "w.path")
    # nodes at the shortest prefix that have company; only paths through them go deeper
    paths = paths.withColumn("node", _node(F.col("t"), F.lit(SHORTEST), F.col("path")))
    company = paths.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
    paths = paths.join(company, "node").select("class", "n", "t", "path")
    deep = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.lit(DEPTH)), lambda k: F.struct(k.alias("k"), _node(F.col("t"), k, F.col("path")).alias("node"))))
    nodes = paths.select("class", "n", "t", deep.alias("w")).select("class", "n", "t", "w.k", "w.node")
    crowd = nodes.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("all")).filter("m > 1")
    nodes = cut(nodes.join(crowd, "node"))
    depths = nodes.groupBy("class").agg(F.collect_list(F.struct("t", "k", "m")).alias("nodes")).mapInArrow(_chosen, "class binary, depth binary, looks array<int>")
    depths = cut(depths)
    wanted = nodes.join(depths, "class").filter(F.col("k") == F.get("looks", F.col("t"))).select("node").distinct()
    depths = depths.drop("looks")
    blocks = F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("all") * 8 / SET_BYTES)).cast("int")
    members = nodes.join(wanted, "node", "left_semi").withColumn("blocks", blocks)
    members = members.withColumn("b", F.pmod(F.xxhash64("class"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).withColumn("g", F.xxhash64("node", "i", "j"))
    signs = classes.select("class", "sig").join(depths, "class")
    members = members.select("g", "i", "j", "b", "t", "k", "class").join(signs, "class")
    met = cut(members.repartition("g").sortWithinPartitions("g").mapInArrow(_meet, "g bigint, i int, j int, b int, t int, k int, class binary"))
    # the sets of those that have a promising partner, from the text of one row of the class
    needed = met.select("class").distinct().join(classes.select("class", "label", "copies", F.col("label.rid").alias("rid"), "sig"), "class").join(depths, "class")
    sets = lambda batch: [_packed(batch.column("_text"))]
    needed = append(rows.select("rid", "_text").join(needed, "rid").dropDuplicates(["rid"]), {"set": "binary"}, sets, "_text", BLOCK, ("_text", "rid"))
    kind = classes.schema["label"].dataType.simpleString()
    found = cut(met.join(needed, "class").repartition("g").sortWithinPartitions("g").mapInArrow(_verify, f"label {kind}, links bigint, hub {kind}"))
    roots = components(found.select(F.col("label").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("label").agg(F.sum("links").alias("links"))
    known = classes.select("class", "label", "copies").join(links, "label", "left").join(roots.withColumnRenamed("node", "label"), "label", "left")
    known = known.select("class", F.coalesce("root", "label").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("key", "rid", "class").join(known, "class", "left").drop("class")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near duplicates one row, that with the least ``key`` (nulls last), then hash of the text.

    Rows without words are groups of their own. Columns stay as they are, whatever their names.
    """
    rid, stays = fresh(docs, "rid", "stays")
    flags = cut(_linked(docs, key, text).filter("n_links > 0").select(F.col("rid").alias(rid), (F.col("rid") == F.col("root.rid")).alias(stays))).distinct()
    rows = docs.withColumn(rid, F.xxhash64(key, text)).join(flags, rid, "left")
    return rows.filter(F.col(stays).isNull()).unionByName(rows.filter(stays).dropDuplicates([rid])).select(*docs.columns)


def _packed(column: pa.Array) -> pa.Array:
    h, at = shingle_sets(column)
    return pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
ORACLE_SQL = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
h AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
k AS (SELECT c.a AS r, min(d.doc_id) AS class_id FROM c JOIN d ON c.b = d.r GROUP BY c.a),
m AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(k.class_id, doc_id) AS class_id, coalesce(m.n, 0) AS n_links FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)""",
}
