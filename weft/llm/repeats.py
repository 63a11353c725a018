"""Removal of long byte strings that occur earlier in the corpus.

A window of ``LENGTH`` bytes is removed where an equal one starts earlier. Every window has an anchor, the
``GRAM``-byte string in it whose fingerprint is least, which its content alone decides; so equal windows have equal
anchors. Anchors that occur once drop out after one exchange of fingerprints. The stretches of windows around the
others meet by anchor. The windows of stretches that meet are put in the order of their bytes, as suffixes of a suffix
array are, and of each group of equal ones all but the earliest are marked. Whatever a task can settle by itself it
does before it sends anything, so a passage in a third of all documents sends one record a task.

Near the edge of a shared passage, or in a short shared string, an anchor has another stretch in every document. The
windows of anchors that occur more than ``CROWD`` times are therefore dealt by anchor and fingerprint, each settled by
its sender first; so no anchor is ever one group. Buckets are as many as the bytes of the table ask for.

This is not the run-length index that the operator is named after; README.md says why, with figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import Spans, U, append, cut, fresh, mix, partitions_for, slices, table, utf8

#: Bytes of a string that is removed where it repeats, and of an anchor.
LENGTH, GRAM = 100, 32
#: Starts of anchors in a window.
STARTS = LENGTH - GRAM + 1
#: Bytes of texts worked on at once, and of a piece of a longer text; anchors or bytes of stretches held before they are sent.
BLOCK, PIECE, HELD = 1 << 17, 1 << 19, 1 << 19
#: Bytes of texts for each bucket: a task's anchors or stretches are about as many bytes.
BUCKET = 8 << 20
LAST = np.iinfo(np.int64).max
#: The lowest bits of an anchor's fingerprint hold its count, as a power of two. Anchors above ``CROWD`` are dealt by
#: window; they are sent as answers to row ``ALL``.
COUNT, BITS, CROWD, ALL = U(31), U(5), 2048, np.iinfo(np.int64).min
#: Words of the map of crowded anchors.
WORDS = 1 << 20


class Crowd:
    """A map with a bit for each of 64 * ``WORDS`` anchors; only words that have one are held.

    Some anchors share a bit with a crowded one and are dealt by window as well, which every task sees alike: that is
    right for any anchor. So the map has at most 16 bytes for each of its words, however many anchors are crowded.
    """

    def __init__(self, words: np.ndarray, masks: np.ndarray):
        order = np.argsort(words)
        self.words, self.masks = words[order], masks[order].astype(np.uint64)

    @staticmethod
    def bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and mask of each anchor."""
        x = mix(h)
        return (x % U(WORDS)).astype(np.int64), U(1) << (x >> U(58))

    @classmethod
    def of(cls, h: np.ndarray) -> Crowd:
        word, mask = cls.bits(h)
        order = np.argsort(word, kind="stable")
        begin, _ = _split(word[order])
        return cls(word[order][begin], np.bitwise_or.reduceat(mask[order], begin) if len(begin) else mask)

    def has(self, h: np.ndarray) -> np.ndarray:
        word, mask = self.bits(h)
        k = np.minimum(np.searchsorted(self.words, word), max(0, len(self.words) - 1))
        return (self.words[k] == word) & ((self.masks[k] & mask) != 0) if len(self.words) else np.zeros(len(h), bool)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the map for lists of crowded anchors."""
    for batch in batches:
        for items in batch.column("items").to_pylist():
            some = Crowd.of(np.frombuffer(items, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(some.words), pa.array(some.masks.view(np.int64))], ["word", "mask"])


def _slide(x: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``k`` neighbours."""
    width = 1
    n = len(x) - k + 1
    while width * 2 <= k:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:n], x[k - width : k - width + n]) if k > width else x[:n]


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts: fingerprint, text, and first and last start of the windows they serve.

    Of equal fingerprints in a window the first is its anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), none, none, none
    grams = Spans(data).every(GRAM)
    value = (grams >> U(32)).astype(np.uint32)
    least = _slide(value, STARTS, np.minimum)
    pad = np.zeros(STARTS - 1, np.uint32)
    chosen = _slide(np.concatenate([pad, least, pad]), STARTS, np.maximum)[: len(grams)] == value
    before = np.cumsum(chosen, dtype=np.int32) - chosen
    chosen = np.flatnonzero(chosen)
    # each window takes the first chosen place from its start on that holds its least; windows don't leave their text
    text = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    inside = np.flatnonzero(text[: len(least)] == text[LENGTH - 1 :])
    if not len(inside):
        return np.zeros(0, np.uint64), none, none, none
    least, k = least[inside], before[inside]
    off = np.flatnonzero(value[chosen[k]] != least)
    while len(off):
        k[off] += 1
        off = off[value[chosen[k[off]]] != least[off]]
    edge = np.ones(len(inside), bool)
    edge[1:] = (k[1:] != k[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(inside)) - 1
    return mix(grams[chosen[k[first]]]), text[inside[first]], inside[first], inside[last]


def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and one more: the end."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.append(begin, len(keys))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Batches with their bytes and where each text begins in them. A long text comes in pieces, alone, with the place
    of the piece in it; pieces share bytes, so that each window lies in one, whole."""
    for batch in slices(batches, "_text", BLOCK):
        data, at = utf8(batch.column("_text"))
        if len(data) <= PIECE or batch.num_rows > 1:
            yield batch, data, at, 0
            continue
        for a in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[a : a + PIECE + LENGTH - 1]
            yield batch, part, np.array([0, len(part)]), a


def _send(buckets: int):
    """Anchors of documents as records by bucket: fingerprints with the rows that have them.

    The lowest bits of a fingerprint tell how many occurrences are known to the sender. Those it knows to be
    repeated need no answer: they go as kind 1, to any bucket, and in their bucket one record stands for them.
    """

    def flush(parts: list[tuple[np.ndarray, np.ndarray]], turn: int) -> pa.RecordBatch:
        h, rid = (np.concatenate(x) for x in zip(*parts, strict=True))
        h &= ~COUNT
        order = np.lexsort((rid, h))
        h, rid = h[order], rid[order]
        begin, ends = _split(h)
        many = np.repeat(np.diff(ends) > 1, np.diff(ends))
        power = np.log2(np.diff(ends)).astype(np.uint64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])
        rows = []
        known = np.flatnonzero(many & new)
        rows += [(turn % buckets, 1, rid[known], h[known])] if len(known) else []
        lone = begin
        bucket = (h[lone] >> BITS) % U(buckets)
        sent = h[lone] | np.minimum(power, COUNT)
        order = np.argsort(bucket, kind="stable")
        lone, bucket, sent = lone[order], bucket[order], sent[order]
        b, e = _split(bucket)
        rows += [(int(bucket[x]), 0, rid[lone[x:y]], sent[x:y]) for x, y in zip(b, e[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3].tobytes() for r in rows], pa.binary())], ["bucket", "kind", "rids", "hashes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, turn = [], 0, 0
        for batch, data, at, _ in _pieces(batches):
            h, text, _, _ = anchors(data, at)
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[text]
            parts.append((h, rid))
            held += len(h)
            if held >= HELD:
                turn += len(parts) + int(rid[0] & 0xFFFF)
                yield flush(parts, turn)
                parts, held = [], 0
        if held:
            yield flush(parts, turn + int(parts[0][1][0] & 0xFFFF) if len(parts[0][1]) else turn)

    return work


def _deal(rid: np.ndarray, items: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Answers to rows, items of eight bytes each, as records by bucket of the row."""
    bucket = mix(rid.astype(np.uint64)) % U(buckets)
    order = np.argsort(bucket, kind="stable")
    rid, items, bucket = rid[order], items[order], bucket[order]
    begin, ends = _split(bucket)
    cut_ = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begin, ends[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), cut_(rid), cut_(items)], ["bucket", "rids", "items"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All items of each row of a bucket; those without a row go on, each record by itself, as items of row ``ALL``."""
    got = []
    for b in batches:
        for r, i in zip(b.column("rids").to_pylist(), b.column("items").to_pylist(), strict=True):
            if r:
                got.append((np.frombuffer(r, np.int64), np.frombuffer(i, np.uint64)))
            else:
                yield pa.RecordBatch.from_arrays([pa.array([ALL]), pa.array([i], pa.binary())], ["rid", "items"])
    if got:
        rid, items = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(rid, kind="stable")
        rid, items = rid[order], items[order]
        begin, ends = _split(rid)
        yield pa.RecordBatch.from_arrays([pa.array(rid[begin]), pa.array([items[a:b].tobytes() for a, b in zip(begin, ends[1:], strict=True)], pa.binary())], ["rid", "items"])


def _again(buckets: int, crowd: int):
    """Rows and those of their anchors that occur more than once; without a row, those that occur above ``crowd`` times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles = []
        for batch in batches:
            for kind, rids, hashes in zip(*(batch.column(c).to_pylist() for c in ("kind", "rids", "hashes")), strict=True):
                rid, h = np.frombuffer(rids, np.int64), np.frombuffer(hashes, np.uint64)
                if kind:
                    yield _deal(rid, h, buckets)
                else:
                    singles.append((rid, h))
        if singles:
            rid, h = (np.concatenate(x) for x in zip(*singles, strict=True))
            order = np.argsort(h, kind="stable")
            rid, h = rid[order], h[order]
            begin, ends = _split(h & ~COUNT)
            many = (np.diff(ends) > 1) | (h[ends[1:] - 1] & COUNT).astype(bool)
            keep = np.repeat(many, np.diff(ends))
            if keep.any():
                yield _deal(rid[keep], h[keep] & ~COUNT, buckets)
            # a count is known to less than twice its power of two
            if len(hot := h[begin][2 * np.add.reduceat(U(1) << (h & COUNT), begin) > crowd] & ~COUNT):
                yield pa.RecordBatch.from_arrays([pa.array([int(hot[0] >> BITS) % buckets], pa.int32()), pa.array([b""], pa.binary()), pa.array([hot.tobytes()], pa.binary())], ["bucket", "rids", "items"])

    return work


def _settle(h: np.ndarray, print_: np.ndarray, doc: np.ndarray, rid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches with equal anchor and content: those to go on with, and those of which all windows are repeated.

    The earliest goes on. What another document or the same row has before is repeated; another row of the least
    document is not, where it is first in that row.
    """
    order = np.lexsort((first, rid, doc, print_, h))
    same, own = np.zeros(len(h), bool), np.zeros(len(h), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (print_[order][1:] == print_[order][:-1])
    own[1:] = same[1:] & (rid[order][1:] == rid[order][:-1])
    lead, mine = (order[np.maximum.accumulate(np.where(x, 0, np.arange(len(h))))] for x in (same, own))
    gone = same & ((doc[order] > doc[lead]) | (first[order] > first[mine]))
    return order[~gone], order[gone]


def _windows(rid: np.ndarray, first: np.ndarray, size: np.ndarray, buckets: int) -> pa.RecordBatch:
    """All windows of stretches as removed ones."""
    n = size.astype(np.int64) - LENGTH + 1
    return _gone(np.repeat(rid, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), buckets)


def _runs(rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as stretches: row, first start and size of each run of starts."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    a = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)]))
    b = np.append(a[1:], len(rid)) - 1
    return rid[a], start[a], start[b] - start[a] + np.int32(LENGTH)


def _stretches(buckets: int, crowd: Crowd):
    """Stretches of windows around repeated anchors, as records by bucket.

    Equal stretches that one sender has are sent once, for the earliest; the windows of the others are known to be
    repeated, unless they belong to another row of the same least document, and go as kind 1. Stretches of the anchors
    in ``crowd`` go as kind 2: window by window, with fingerprints for text, by anchor and fingerprint.
    """

    def flush(parts: list[tuple], turn: int) -> pa.RecordBatch | None:
        h, doc, rid, first, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(h):
            return None
        at = np.concatenate([[0], np.cumsum(size)])
        print_ = Spans(text).of(at[:-1], at[1:])
        keep, drop = _settle(h, print_, doc, rid, first)
        rows = []
        if len(drop):
            d = drop[np.lexsort((first[drop], rid[drop]))]
            rows.append((turn % buckets, 1, h[:0], doc[:0], rid[d], first[d], size[d], b""))
        crowded = crowd.has(h[keep])
        keep, i = keep[~crowded], keep[crowded]
        if len(i):
            n = size[i].astype(np.int64) - LENGTH + 1
            i, k = np.repeat(i, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hw, dw, rw, sw = h[i], doc[i], rid[i], first[i] + k.astype(np.int32)
            window = Spans(text).of(at[i] + k, at[i] + k + LENGTH)
            on, drop = _settle(hw, window, dw, rw, sw)
            if len(drop):
                rows.append((turn % buckets, 1, h[:0], doc[:0], *_runs(rw[drop], sw[drop]), b""))
            bucket = mix(hw[on] ^ window[on]) % U(buckets)
            on = on[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket, kind="stable")
            b, e = _split(bucket)
            rows += [(int(bucket[x]), 2, hw[o := on[x:y]], dw[o], rw[o], sw[o], size[:0], window[o].tobytes()) for x, y in zip(b, e[1:], strict=True)]
        bucket = (h[keep] >> BITS) % U(buckets)
        keep = keep[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket, kind="stable")
        b, e = _split(bucket)
        for x, y in zip(b, e[1:], strict=True):
            k = keep[x:y]
            rows.append((int(bucket[x]), 0, h[k], doc[k], rid[k], first[k], size[k], b"".join(text[at[i] : at[i + 1]].tobytes() for i in k)))
        pack = lambda n: pa.array([r[n].tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pack(n) for n in range(2, 7)), pa.array([r[7] for r in rows], pa.binary())], STRETCH)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, turn = [], 0, 0
        for batch, data, at, offset in _pieces(batches):
            h, text, lo, hi = anchors(data, at)
            h = h & ~COUNT
            wanted = batch.column("items").to_pylist()
            of = np.repeat(np.arange(len(wanted)), [len(w) // 8 for w in wanted])
            pairs = mix(np.frombuffer(b"".join(wanted), np.uint64) ^ mix(of.astype(np.uint64)))
            own = mix(h ^ mix(text.astype(np.uint64)))
            k = np.flatnonzero(np.isin(own, pairs))
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[text[k]]
            doc = batch.column("_order").to_numpy(zero_copy_only=False)[text[k]]
            size = hi[k] - lo[k] + LENGTH
            span = np.repeat(lo[k] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(k) else np.zeros(0, np.int64)
            parts.append((h[k], doc, rid, (lo[k] - at[text[k]] + offset).astype(np.int32), size.astype(np.int32), data[span]))
            held += len(span)
            if held >= 2 * HELD:
                turn += 1 + int(rid[0] & 0xFFFF) if len(rid) else 1
                if (out := flush(parts, turn)) is not None:
                    yield out
                parts, held = [], 0
        if parts and (out := flush(parts, turn)) is not None:
            yield out

    return work


STRETCH = ["bucket", "kind", "hashes", "docs", "rids", "firsts", "sizes", "text"]


def _gone(rid: np.ndarray, start: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows with the runs of starts of removed windows."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order].astype(np.int64)
    edge = np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)]) if len(rid) else np.zeros(0, bool)
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(rid)) - 1 if len(a) else a
    return _deal(rid[a], np.stack([start[a], start[b]], 1).astype(np.int32).reshape(-1).view(np.uint64), buckets)


def in_order(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``LENGTH`` bytes at ``start``, in the order of their bytes, and where the groups of equal ones begin.

    Ranks of 8 bytes double up to 64, and two ranks of 64 overlap to ``LENGTH``.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + n]
    width = 8
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        if width == 64:
            break
        key = (rank << U(32)) | np.concatenate([rank[width:], np.zeros(min(width, n), np.uint64)])
        width *= 2
    key = (rank[start] << U(32)) | rank[start + (LENGTH - width)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _first(buckets: int):
    """Windows that are not the first of their kind."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, single = [], []
        for batch in batches:
            for kind, *rest in zip(*(batch.column(c).to_pylist() for c in STRETCH[1:]), strict=True):
                h, doc, rid, first, size, text = (np.frombuffer(x, t) for x, t in zip(rest, (np.uint64, np.int64, np.int64, np.int32, np.int32, np.uint8), strict=True))
                if kind == 1:
                    yield _windows(rid, first, size, buckets)
                elif kind == 2:
                    single.append((h, text.view(np.uint64), doc, rid, first))
                else:
                    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                    got.append((h, doc, rid, first, size, Spans(text).of(at[:-1], at[1:]), text))
        if single:
            h, window, doc, rid, first = (np.concatenate(x) for x in zip(*single, strict=True))
            del single
            _, drop = _settle(h, window, doc, rid, first)
            if len(drop):
                yield _gone(rid[drop], first[drop], buckets)
        if not got:
            return
        h, doc, rid, first, size, print_, text = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        order, drop = _settle(h, print_, doc, rid, first)
        if len(drop):
            yield _windows(rid[drop], first[drop], size[drop], buckets)
        # anchors with their stretches in parts of bounded size; an anchor's stretches, up to CROWD, stay together
        begin, ends = _split(h[order])
        weight = np.concatenate([[0], np.cumsum(size[order], dtype=np.int64)])
        x = 0
        while x < len(begin):
            y = max(x + 1, int(np.searchsorted(weight[ends], weight[ends[x]] + 2 * HELD, "right")) - 1)
            i = order[ends[x] : ends[y]]
            x = y
            if len(i) < 2:
                continue
            n = size[i].astype(np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            local = text[np.repeat(at[i] - off[:-1], n) + np.arange(off[-1])]
            m = n - LENGTH + 1
            owner = np.repeat(np.arange(len(i)), m)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
            d, r, s = doc[i][owner], rid[i][owner], first[i][owner] + k
            windows, groups = in_order(local, off[:-1][owner] + k)
            place = np.empty(len(d), np.int64)  # in the order of documents, rows and starts
            place[by := np.lexsort((s, r, d))] = np.arange(len(d))
            lead = by[np.repeat(np.minimum.reduceat(place[windows], groups), np.diff(np.append(groups, len(d))))]
            d, r, s, lead_d, lead_r, lead_s = d[windows], r[windows], s[windows], d[lead], r[lead], s[lead]
            gone = (d > lead_d) | ((r == lead_r) & (s > lead_s))  # a smaller document has it, or the row itself before
            other = np.flatnonzero((d == lead_d) & (r != lead_r))  # another row of the least document looks at itself
            if len(other):
                g = np.searchsorted(groups, other, "right")
                other = other[o := np.lexsort((s[other], r[other], g))]
                new = np.concatenate([[True], (g[o][1:] != g[o][:-1]) | (r[other][1:] != r[other][:-1])])
                gone[other] = s[other] > s[other][np.maximum.accumulate(np.where(new, np.arange(len(other)), 0))]
            yield _gone(r[gone], s[gone], buckets)

    return work


def cut_spans(runs: bytes) -> list[tuple[int, int]]:
    """Maximal removed spans of a text, from runs of starts of removed windows."""
    if not runs:
        return []
    x = np.frombuffer(runs, np.int32).reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1] + LENGTH)
    new = np.concatenate([[True], x[1:, 0] > end[:-1]])
    a = np.flatnonzero(new)
    return list(zip(x[a, 0].tolist(), end[np.append(a[1:], len(x)) - 1].tolist(), strict=True))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest(text: bytes, rest: bytes) -> str:
    return hashlib.sha256(rest).hexdigest()


def plain(text: bytes, rest: bytes) -> str:
    """As text; of characters that a cut has split nothing is left."""
    return rest.decode("utf-8", "ignore")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "rest", as_: Callable[[bytes, bytes], str] = plain, whole: Column | None = None, crowd: int = CROWD) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``into`` to the columns of ``docs`` but ``text``.

    ``into`` is ``as_`` of a text and of what is left of it, or ``whole`` (the text itself by default) where all is
    left. Rows are in the order of ``key``, nulls last. Rows that repeat a key don't count as earlier than each other;
    each looks back at itself and at all smaller keys. Null texts are empty; shorter texts than ``LENGTH`` lose
    nothing; texts of any length are worked on whole. An empty table stays empty; other columns stay, unless one is
    named as an added one. Of equal texts only the first goes on; the others are removed whole. Anchors that occur
    above ``crowd`` times (counted within a factor of two) are dealt by window; a map of them, of 16 MB at most, passes
    through the driver.
    """
    added = ("n_bytes", "n_removed", "n_spans", into)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    marks = {"rid": F.xxhash64(key, text), "_order": F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))}
    narrow = cut(docs.select(*(v.alias(k) for k, v in marks.items()), F.sha2(body, 256).alias("_sha"), F.length(body).cast("bigint").alias("n")).filter(F.col("n") >= LENGTH))
    size = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, answers = partitions_for(docs, size, BUCKET), "bucket int, rids binary, items binary"
    # a table of its own: so the join can split the rows of a text that many documents have
    firsts = cut(narrow.groupBy("_sha").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    copied = cut(narrow.join(firsts, "_sha").filter("_order > _first").select("rid"))
    rows = docs.select(*(v.alias(k) for k, v in marks.items()), F.col(text).alias("_text")).filter(F.octet_length("_text") >= LENGTH)
    sent = rows.select("rid", "_text").mapInArrow(_send(n), "bucket int, kind int, rids binary, hashes binary")
    again = sent.repartitionById(n, F.col("bucket")).drop("bucket").mapInArrow(_again(n, crowd), answers).repartitionById(n, F.col("bucket")).mapInArrow(_gather, "rid bigint, items binary")
    again = cut(again.join(copied, "rid", "left_anti"))
    hot = again.filter(F.col("rid") == ALL).select("items").mapInArrow(_bits, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    hot = Crowd(hot.column("word").to_numpy(), hot.column("mask").to_numpy().view(np.uint64))
    # both uses of ``some`` take all its columns, so that its exchange of texts is made once
    some = rows.join(again, "rid")
    met = some.mapInArrow(_stretches(n, hot), "bucket int, kind int, hashes binary, docs binary, rids binary, firsts binary, sizes binary, text binary")
    gone = met.repartitionById(n, F.col("bucket")).mapInArrow(_first(n), answers).repartitionById(n, F.col("bucket")).mapInArrow(_gather, "rid bigint, items binary").withColumnRenamed("items", "runs")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for data, runs in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
            spans = cut_spans(runs)
            rest = kept_bytes(data, spans)
            out.append((len(data) - len(rest), len(spans), as_(data, rest)))
        removed, spans, rest = zip(*out, strict=True) if out else ((), (), ())
        return [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(rest, pa.string())]

    lost = append(some.join(gone, "rid"), {"removed": "bigint", "spans": "bigint", "rest": "string"}, work, "_text", 1 << 20, ("_text", "runs", "items")).drop("_order")
    lost = lost.unionByName(copied.select("rid", F.lit(-1).cast("bigint").alias("removed"), F.lit(1).cast("bigint").alias("spans"), F.lit(as_(b"", b"")).alias("rest"))).dropDuplicates(["rid"])
    own = {c: c for c in docs.columns if c not in added and c != text}
    rid, size, left, *names = fresh(docs, "rid", "n_bytes", "whole", "removed", "spans", "rest")
    lost = lost.select(F.col("rid").alias(rid), *(F.col(c).alias(x) for c, x in zip(("removed", "spans", "rest"), names, strict=True)))
    removed, spans, rest = map(F.col, names)
    out = docs.select(*own, marks["rid"].alias(rid), F.length(body).cast("bigint").alias(size), (F.coalesce(F.col(text), F.lit("")) if whole is None else whole).alias(left)).join(lost, rid, "left")
    none = F.lit(0).cast("bigint")
    return out.select(*own, F.col(size).alias("n_bytes"), F.when(removed < 0, F.col(size)).otherwise(F.coalesce(removed, none)).alias("n_removed"), F.coalesce(spans, none).alias("n_spans"), F.coalesce(rest, F.col(left)).alias(into))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return remove_repeats(docs, into="kept_sha256", as_=digest, whole=sha).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL = {
    "op10_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, s, substr(h, 2 * s + 1, {2 * LENGTH}) AS g FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS s FROM d WHERE len(h) >= {2 * LENGTH})),
f AS (SELECT r, doc_id, s, min(coalesce(doc_id, {LAST})) OVER (PARTITION BY g) AS lead, row_number() OVER (PARTITION BY g, r ORDER BY s) AS k FROM w),
x AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH} THEN 1 ELSE 0 END AS new FROM f WHERE lead < coalesce(doc_id, {LAST}) OR k > 1),
y AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS i FROM x),
z AS (SELECT r, i, min(s) AS a, max(s) + {LENGTH} AS b FROM y GROUP BY ALL),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM z),
t AS (SELECT q.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM q JOIN d USING (r) GROUP BY q.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)""",
}
