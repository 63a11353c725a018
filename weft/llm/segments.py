"""Sampled segmentations of texts into pieces, without replacement, and back.

A text's lattice has an edge for every piece at every place. Pieces weigh by their rank in the vocabulary, and a
segmentation's probability is the product of its pieces' weights over that of all. Gumbel top-k draws k distinct
segmentations as the k highest of all perturbed log-probabilities, which perturbed A* search finds without listing
them: a node of the search is a set of segmentations with a common beginning, its key the highest perturbed value in
it. The set with the highest key is split: one segmentation gets the key, the others fall into a set for each token
of it, with keys from Gumbels that are cut off at the parent's.

No piece goes beyond a word, so lattices are made once for each distinct word of a block of texts, and all words of
the block are walked in step. A long word is cut where no piece of its lattice crosses.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import U, append, fresh, mix, slices, table, utf8
from weft.llm.tokens import SPACE, default_model

#: Segmentations of each text; how sharply pieces weigh by rank.
SAMPLES, SHARPNESS = 2, 1.0
#: Longer words are cut into parts of at least so many characters.
LONG = 64
BLOCK = 1 << 19
#: Bits of the table that finds trie edges: 4 MB, nearly all edges alone in their slot.
SLOTS = 20
#: Stands for a word's end among characters; no trie edge has it.
NONE = (1 << 21) - 1
#: Shares are summed up in parts of this size.
FINE = float(1 << 40)
_WORD = regex.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    """Pieces by trie node: keys are (node, character), sorted."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        order = np.argsort([-sp.get_score(i) for i in ids], kind="stable")
        rank = np.empty(len(ids))
        rank[order] = np.arange(len(ids))
        nodes: dict[tuple[int, str], int] = {}
        piece_at: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            at = 0
            for char in piece:
                at = nodes.setdefault((at, char), len(nodes) + 1)
            piece_at[at] = k
        keys = np.array([(a << 21) | ord(c) for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.inner = np.zeros(len(nodes) + 1, bool)  # nodes that have children
        self.inner[self.keys >> 21] = True
        # of each slot the place of its key; -1 if several keys fall in it
        slots = self._slot(self.keys)
        self.place = np.zeros(1 << SLOTS, np.int32)
        self.place[slots] = np.arange(len(self.keys))
        self.place[np.bincount(slots, minlength=1 << SLOTS) > 1] = -1
        self.root = np.zeros(max(ord(c) for a, c in nodes if not a) + 2, np.int64)
        for (a, c), child in nodes.items():
            if not a:
                self.root[ord(c)] = child
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(piece_at)] = list(piece_at.values())
        self.ids = np.array(ids, np.int64)
        weight = SHARPNESS * np.log(1 / (1 + rank))
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.rare = weight.min()  # of each byte of a character that no piece holds
        self.weight = weight
        self.lattice: Lattice | None = None
        texts = [b""] * sp.get_piece_size()
        for i in range(len(texts)):
            texts[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
        #: What a piece's number takes in the results.
        self.kind = "<u2" if len(texts) <= 1 << 16 else "<u4"
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - SLOTS)).view(np.int64)

    def find(self, trie: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of trie nodes by characters lie, and whether there are any: looked up by slot, searched for in crowded ones."""
        key = (trie << 21) | codes
        k = self.place[self._slot(key)]
        crowded = np.flatnonzero(k < 0)
        if len(crowded):
            k[crowded] = np.minimum(np.searchsorted(self.keys, key[crowded]), len(self.keys) - 1)
        return k, self.keys[k] == key

    def parts(self, word: str) -> list[str]:
        """The word cut where no piece crosses: its segmentations are those of the parts, one after another."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(codes)
        crossed = np.zeros(n + 1, np.int32)
        for a in range(0, n, 1 << 16):
            here, depth = np.arange(a, min(a + (1 << 16), n)), 1
            trie = self.root[np.minimum(codes[here], len(self.root) - 1)]
            here, trie = here[trie > 0], trie[trie > 0]
            while len(here):
                has = here[self.piece[trie] >= 0]
                if depth > 1:
                    np.add.at(crossed, has + 1, 1)
                    np.add.at(crossed, has + depth, -1)
                more = here + depth < n
                here, trie = here[more], trie[more]
                k, ok = self.find(trie, codes[here + depth])
                here, trie, depth = here[ok], self.child[k[ok]], depth + 1
        free = np.flatnonzero(np.cumsum(crossed)[1:n] == 0) + 1
        out, a = [], 0
        while (k := int(np.searchsorted(free, a + LONG))) < len(free):
            out.append(word[a : int(free[k])])
            a = int(free[k])
        return [*out, word[a:]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def split_words(text: str) -> list[str]:
    """A word is a run of spaces and what follows it; the text has a space before it."""
    if "  " in text or SPACE in text or text[:1] in ("", " ") or text[-1] == " ":
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []
    return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another: from each beginning so many."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """Of distinct words: nodes are places in words, edges are sorted by the node they leave. It grows by new words."""

    #: Beyond so many words a task's lattice keeps the half of them that was used most (about 160 MB).
    MOST = 200_000

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.room: dict[str, np.ndarray] = {}
        self.begin, self.first = np.zeros(1, np.int64), np.zeros(1, np.int64)  # first node of each word, first edge of each node
        self.used = np.zeros(0, np.int64)  # how often each word occurred
        self.is_end = np.zeros(0, bool)
        # of each edge: nodes, piece id (below 0: minus one minus a character that no piece holds), share among the
        # edges of its node, sum of the shares up to it, log of the share and of that of the others
        self.start, self.to, self.ids = (np.zeros(0, np.int32) for _ in range(3))
        self.share, self.upto, self.log, self.other = np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros(0), np.zeros(0, np.float32)

    def _put(self, name: str, more: np.ndarray) -> None:
        """Appends to an array, in room that grows by halves."""
        old = getattr(self, name)
        n = len(old) + len(more)
        room = self.room.get(name, old)
        if len(room) < n:
            room = self.room[name] = np.empty(n + n // 2, old.dtype)
            room[: len(old)] = old
        room[len(old) : n] = more
        setattr(self, name, room[:n])

    def grow(self) -> None:
        """Adds the words that have become known."""
        new = list(itertools.islice(self.known, len(self.begin) - 1, None))
        if not new:
            return
        nodes, edges = int(self.begin[-1]), int(self.first[-1])
        begin, first, is_end, start, to, *rest = self._of(new)
        self._put("used", np.zeros(len(new), np.int64))
        for name, more in zip(("begin", "first", "is_end", "start", "to"), (begin[1:] + nodes, first[1:] + edges, is_end, start + nodes, to + nodes), strict=True):
            self._put(name, more)
        for name, more in zip(("ids", "share", "upto", "log", "other"), rest, strict=True):
            self._put(name, more)

    def thin(self) -> None:
        """Keeps the half of ``MOST`` words that was used most; what they were used counts half from now on."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.MOST // 2])
        names = list(self.known)
        self.known = defaultdict(itertools.count(len(keep)).__next__, zip([names[w] for w in keep.tolist()], range(len(keep))))
        at, nodes = self.begin[keep], self.begin[keep + 1] - self.begin[keep]
        node, begin = ragged(at, nodes), np.concatenate([[0], np.cumsum(nodes)])
        edges = self.first[at + nodes] - self.first[at]
        edge, moved = ragged(self.first[at], edges), np.repeat(at - begin[:-1], edges)
        self.first = np.concatenate([[0], np.cumsum(self.first[node + 1] - self.first[node])])
        self.begin, self.used, self.is_end = begin, self.used[keep] // 2, self.is_end[node]
        self.start, self.to = ((x[edge] - moved).astype(np.int32) for x in (self.start, self.to))
        self.ids, self.share, self.upto, self.log, self.other = (x[edge] for x in (self.ids, self.share, self.upto, self.log, self.other))
        self.room = {}

    def _of(self, words: list[str]) -> tuple[np.ndarray, ...]:
        v = self.v
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])  # a word has one node more than characters
        n = int(begin[-1])
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes[begin[1:] - 1] = NONE
        is_end = codes == NONE
        place = np.flatnonzero(~is_end)
        found: list[tuple[np.ndarray, ...]] = []
        trie, depth = v.root[np.minimum(codes[place], len(v.root) - 1)], 1
        single = is_end.copy()
        single[place[v.piece[trie] >= 0]] = True
        here = place
        while True:
            on = np.flatnonzero(trie)
            here, trie = here[on], trie[on]
            piece = v.piece[trie]
            has = np.flatnonzero(piece >= 0)
            found.append((here[has], depth, piece[has]))
            on = np.flatnonzero(v.inner[trie])
            here, trie = here[on], trie[on]
            if not len(here):
                break
            k, ok = v.find(trie, codes[here + depth])
            trie, depth = np.where(ok, v.child[k], 0), depth + 1
        odd = np.flatnonzero(~single)
        # edges by node, within it by length; those of odd characters last
        many = np.bincount(np.concatenate([*(h for h, *_ in found), odd]), minlength=n)
        first = np.concatenate([[0], np.cumsum(many)])
        free = first[:-1].copy()
        to, ids, weight = np.empty(int(first[-1]), np.int64), np.empty(int(first[-1]), np.int32), np.empty(int(first[-1]))
        for at, depth, piece in found:
            e = free[at]
            free[at] = e + 1
            to[e], ids[e], weight[e] = at + depth, v.ids[piece], v.weight[piece]
        e, code = free[odd], codes[odd]
        to[e], ids[e] = odd + 1, -1 - code
        weight[e] = v.rare * np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        start = np.repeat(np.arange(n), many)
        # beta: log of the weight of all ways from a node to the word's end, from the ends backwards
        beta = np.zeros(n)
        left = np.repeat(begin[1:] - 1, size + 1) - np.arange(n)
        most = int(left.max(initial=0))
        by = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")
        level = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=most + 1))])
        for a, b in zip(level[1:-1].tolist(), level[2:].tolist(), strict=True):
            nodes = by[a:b]
            e = ragged(first[nodes], many[nodes])
            beta[nodes] = np.logaddexp.reduceat(weight[e] + beta[to[e]], np.cumsum(many[nodes]) - many[nodes])
        log = weight + beta[to]
        log -= beta[start]
        share = np.exp(log)
        # sums in whole numbers: what other words stand before doesn't matter
        total = np.cumsum(np.rint(share * FINE).astype(np.int64))
        upto = (total - np.concatenate([[0], total])[first[start]]) / FINE
        log[alone := (many == 1)[start]] = 0.0
        other = np.log(np.maximum(1 - share, 1e-300))
        other[alone] = -np.inf
        return begin, first, is_end, start, to, ids, share.astype(np.float32), upto.astype(np.float32), log, other.astype(np.float32)

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node by its share."""
        e, end = self.first.take(node), self.first.take(node + 1) - 1
        open_ = np.flatnonzero((e < end) & (u > self.upto.take(e)))
        at, end, u = e.take(open_), end.take(open_), u.take(open_)
        last = u > self.upto.take(end - 1)  # the longest piece, often the likeliest
        e[open_[last]] = end[last]
        on = np.flatnonzero(~last)
        while len(on):
            open_, at, u = open_.take(on), at.take(on) + 1, u.take(on)
            e[open_] = at
            on = np.flatnonzero(u > self.upto.take(at))
        return e

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to its word's end: the edges of all walks one after the other, and their number in each."""
        active = np.argsort(node)  # reading the lattice from its beginning to its end is faster
        active = active[~self.is_end[node[active]]]
        which, edges, at, seed, count, step = [], [], node[active], seed[active], np.zeros(len(node), np.int64), 0
        while len(active):
            e = self.choose(at, uniform(seed, step))
            which.append(active)
            edges.append(e)
            step += 1
            count[active] = step
            at = self.to.take(e)
            on = np.flatnonzero(~self.is_end.take(at))
            active, at, seed = active.take(on), at.take(on), seed.take(on)
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (w, e) in enumerate(zip(which, edges, strict=True)):
            out[begin.take(w) + t] = e
        return out, count


def uniform(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """In (0, 1), from seed and step alone."""
    if isinstance(step, int):
        add = U((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    else:
        add = (step + 1).astype(U) * U(0x9E3779B97F4A7C15)
    return ((mix(seed + add) >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


@dataclass
class Turn:
    """The segmentations that the texts ``docs`` get in one turn: edges or ids of all, where those of each begin (one
    more: the end), log-probability, perturbed log-probability, log of the probability that it is among the chosen."""

    docs: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray
    log_prob: np.ndarray
    value: np.ndarray
    included: np.ndarray


def numbered(texts: pa.Array, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words of all texts (null: none), and where each text's begin (one more: the end)."""
    texts = texts.fill_null("")
    parts = pc.split_pattern(texts, " ")
    at = parts.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    coded = parts.flatten().dictionary_encode()
    which, different = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    # runs of spaces, U+2581 and words to be cut
    size = pc.utf8_length(different).to_numpy()
    odd = (size == 0) | (size >= LONG) | pc.match_substring(different, SPACE).to_numpy(zero_copy_only=False)
    if odd.any():
        different = different.filter(pa.array(~odd))
    number = np.full(len(odd), -1)
    if n := len(different):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), different), f" {SPACE}")[0].as_py()
        number[~odd] = np.fromiter(map(lattice.known.__getitem__, f"{SPACE}{joined}".split(" ")), np.int64, n)
    word = number[which]
    if not odd.any():
        return word, at
    out, count, done = [], np.diff(at), 0
    for d in np.unique(np.searchsorted(at, np.flatnonzero(word < 0), "right") - 1).tolist():
        own = split_words(texts[d].as_py())
        own = [p for w in own for p in (lattice.v.parts(w) if len(w) > LONG else (w,))]
        out += [word[done : at[d]], np.fromiter(map(lattice.known.__getitem__, own), np.int64, len(own))]
        count[d], done = len(own), at[d + 1]
    return np.concatenate([*out, word[done:]]), np.concatenate([[0], np.cumsum(count)])


def draw(texts: pa.Array, seeds: np.ndarray, k: int, v: Vocabulary) -> list[Turn]:
    """For each text up to ``k`` distinct segmentations, one a turn; what is among the chosen is told given the
    threshold: the next perturbed value."""
    if v.lattice is None:
        v.lattice = Lattice(v)
    lattice = v.lattice
    if len(lattice.known) > lattice.MOST:
        lattice.thin()
    word, first = numbered(texts, lattice)
    lattice.grow()
    lattice.used += np.bincount(word, minlength=len(lattice.used))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    number = np.arange(len(word)) - first[:-1][doc]
    word_seed = mix(seeds[doc] ^ mix(number.astype(np.uint64) + U(1)))
    start = lattice.begin[word]
    turns: list[Turn] = []
    fronts: list[list[tuple]] = [[] for _ in texts]

    def take(docs: np.ndarray, e: np.ndarray, bounds: np.ndarray, at: np.ndarray, value: np.ndarray, skips: list[tuple[int, ...]]) -> None:
        """Adds a segmentation of each of the texts; the sets they leave behind, from token ``at`` on, join the fronts."""
        turn, begin, size = len(turns), bounds[:-1], np.diff(bounds)
        log = lattice.log[e]
        sums = np.zeros(len(e) + 1)  # up to each token; those of a text alone, so they hang on nothing else
        for a, b in zip(begin.tolist(), bounds[1:].tolist(), strict=True):
            np.cumsum(log[a:b], out=sums[a + 1 : b + 1])
        log_prob = np.where(size > 0, sums[bounds[1:]], 0.0)
        turns.append(Turn(docs, e, bounds, log_prob, value, log_prob))
        own = ragged(begin + at, size - at)
        place, size, before = own - np.repeat(begin, size - at), size - at, sums[own]
        before[place == 0] = 0.0
        rest = before + lattice.other[e[own]]
        head = np.cumsum(size) - size
        if turn:
            new = e[begin + at]
            left = 1 - np.array([sum(lattice.share[list(s)].tolist()) for s in skips]) - lattice.share[new].astype(np.float64)
            node = lattice.start[new]
            all_out = np.array([len(s) + 1 for s in skips]) == lattice.first[node + 1] - lattice.first[node]
            rest[head] = np.where(all_out, -np.inf, before[head] + np.log(np.maximum(left, 1e-300)))
        # sets of a text stand in the order of their Gumbels, whatever their bound; no more are needed than turns are left
        spare = np.log(-np.log(uniform(mix(place.astype(np.uint64) ^ np.repeat(seeds[docs], size)), 1000 + turn))) - rest
        need = k - turn
        best = [np.zeros(0, np.int64)]
        for a, n in zip(head.tolist(), size.tolist(), strict=True):
            best.append(a + (spare[a : a + n].argpartition(need - 1)[:need] if n > need else np.arange(n)))
        which, best = np.repeat(np.arange(len(docs)), np.minimum(size, need)), np.concatenate(best)
        with np.errstate(over="ignore"):
            keys = np.logaddexp(-value[which], spare[best])  # Gumbels around ``rest``, none above ``value``, negative
        for j, key, b, i in zip(which.tolist(), keys.tolist(), best.tolist(), place[best].tolist(), strict=True):
            if key < np.inf:
                heapq.heappush(fronts[docs[j]], (key, turn, i, skips[j] if turn and b == head[j] else ()))

    edges, count = lattice.walk(start, word_seed)
    root = -np.log(-np.log(uniform(seeds, 0)))
    none = np.zeros(len(texts), np.int64)
    take(np.arange(len(texts)), edges, np.concatenate([[0], np.cumsum(count)])[first], none, root, [])
    row = [np.arange(len(texts))]  # of each turn: where a text stands in it
    for turn in range(1, k):
        docs = np.array([d for d, front in enumerate(fronts) if front], np.int64)
        if not len(docs):
            break
        keys, of, place, skips = zip(*(heapq.heappop(fronts[d]) for d in docs.tolist()), strict=True)
        at = np.array(place, np.int64)
        seed = mix(seeds[docs] ^ U(turn * 0x10001 + 7))
        u, new, old, word_at = uniform(seed, at), [], [], []
        for j, (d, t, i) in enumerate(zip(docs.tolist(), of, place, strict=True)):
            r = row[t][d]
            e = turns[t].ids[turns[t].bounds[r] : turns[t].bounds[r] + i + 1]
            node, out = int(lattice.start[e[i]]), (*skips[j], int(e[i]))
            near = np.array([x for x in range(lattice.first[node], lattice.first[node + 1]) if x not in out])
            share = lattice.share[near]
            new.append(near[min(int(np.searchsorted(np.cumsum(share), u[j] * share.sum())), len(near) - 1)])
            old.append((e[:i], out))
            word_at.append(first[d] + np.count_nonzero(lattice.is_end[lattice.to[e[:i]]]))
        # on from the new edge to its word's end, then through the words after it
        words_left = first[docs + 1] - np.array(word_at)
        own, head = ragged(np.array(word_at), words_left), np.cumsum(words_left) - words_left
        nodes, node_seeds, new = start[own], word_seed[own], np.array(new)
        nodes[head], node_seeds[head] = lattice.to[new], 0  # the turn's own seed, when that is mixed in
        edges, count = lattice.walk(nodes, mix(node_seeds ^ np.repeat(seed, words_left)))
        upto = np.concatenate([[0], np.cumsum(count)])[np.append(head, len(own))]
        paths = [x for j, (e, _) in enumerate(old) for x in (e, new[j : j + 1], edges[upto[j] : upto[j + 1]])]
        row.append(np.full(len(texts), -1))
        row[turn][docs] = np.arange(len(docs))
        take(docs, np.concatenate(paths), np.concatenate([[0], np.cumsum(at + 1 + np.diff(upto))]), at, -np.array(keys), [out for _, out in old])
    bar = np.array([-front[0][0] if front else -np.inf for front in fronts])
    for t in turns:
        t.included = _included(t.log_prob - bar[t.docs])
        t.ids, size = _ids(lattice.ids[t.ids], v)
        if size is not None:
            t.bounds = np.concatenate([[0], np.cumsum(size)])[t.bounds]
    return turns


def sample(texts: list[str], seeds: np.ndarray, k: int, v: Vocabulary) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its segmentations: ids, log-probability, perturbed log-probability, log of the probability that it is chosen."""
    out: list[list[tuple[np.ndarray, float, float, float]]] = [[] for _ in texts]
    for t in draw(pa.array(texts, pa.string()), seeds, k, v):
        for d, a, b, *x in zip(t.docs.tolist(), t.bounds[:-1], t.bounds[1:], t.log_prob.tolist(), t.value.tolist(), t.included.tolist(), strict=True):
            out[d].append((t.ids[a:b], *x))
    return out


def _included(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(x)))"""
    with np.errstate(divide="ignore"):
        return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))))


def _ids(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray | None]:
    """With the bytes of characters that no piece holds, and how many ids each has become (None: one each)."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, None
    chars, char = np.unique(ids[odd], return_inverse=True)
    raw = [v.byte[np.frombuffer(chr(-1 - p).encode("utf-8", "surrogatepass"), np.uint8)] for p in chars.tolist()]
    many = np.array([len(x) for x in raw])
    size = np.ones(len(ids), np.int64)
    size[odd] = n = many[char]
    out = np.repeat(ids, size)
    out[ragged(np.cumsum(size)[odd] - n, n)] = np.concatenate(raw)[ragged((np.cumsum(many) - many)[char], n)]
    return out, size


def encode(df: DataFrame, key: str, text: str = "text", k: int = SAMPLES, path: str | None = None, drop: tuple[str, ...] = (), round_trip: bool = False) -> DataFrame:
    """For each row up to ``k`` rows with ``sample`` (from 0, the highest perturbed first), ``ids`` (little endian, 16
    bits each, or 32 where the model has more than 65,536 pieces), ``n_ids``, ``log_prob``, ``perturbed`` and ``log_inclusion``, seeded by ``key`` alone; on request also
    ``round_trip``: whether decoding the ids gives the text back.

    A text has fewer samples only if it has fewer segmentations; null texts are empty, and an empty text has one, of no
    pieces. Texts are segmented whole, whatever their length; the lattice of a run of characters in which pieces overlap
    throughout, such as a rule of dashes, takes about 40 bytes for each place and piece, one step a character. Rows that repeat key and text get the same; a null key
    is a seed like others; an empty table stays empty; columns named as an added one are replaced, those in ``drop`` go.
    """
    path = path or default_model()
    added = {"sample": "int", "ids": "binary", "n_ids": "bigint", "log_prob": "double", "perturbed": "double", "log_inclusion": "double"} | ({"round_trip": "boolean"} if round_trip else {})
    seed, *_ = fresh(df, "seed")
    df = df.select(*(c for c in df.columns if c not in added or c == text), F.xxhash64(key).alias(seed))
    keep = [c for c in df.columns if c not in (seed, *drop, *added)]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep), *(f"{n} {t}" for n, t in added.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        try:
            for batch in slices(batches, text, BLOCK):
                seeds = batch.column(seed).to_numpy(zero_copy_only=False).astype(np.uint64)
                turns = draw(batch.column(text), seeds, k, v)
                which = np.concatenate([t.docs for t in turns])
                order = np.argsort(which, kind="stable")
                n = np.repeat(np.arange(len(turns), dtype=np.int32), [len(t.docs) for t in turns])
                size = np.concatenate([np.diff(t.bounds) for t in turns])
                ids = np.concatenate([t.ids for t in turns]).astype(v.kind)
                ends = np.concatenate([[0], np.cumsum(size)]) * ids.itemsize
                binary = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                columns = [pa.array(n), binary, pa.array(size), *(pa.array(np.concatenate([getattr(t, x) for t in turns])) for x in ("log_prob", "value", "included"))]
                if round_trip:
                    columns.append(pa.array(np.concatenate([gives_back(t, batch.column(text), v) for t in turns])))
                rows, order = pa.array(which[order]), pa.array(order)
                out = [c.take(order) for c in columns]
                out[1] = out[1].cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in keep] + out, [*keep, *added])
        finally:  # workers outlive their tasks: what runs in them next needs the memory
            v.lattice = None

    return df.mapInArrow(work, fields)


def gives_back(t: Turn, texts: pa.Array, v: Vocabulary) -> np.ndarray:
    """Whether decoding a turn's ids gives the bytes of its texts (null: none), U+2581 taken as a space."""
    data, at = utf8(pc.replace_substring(texts, SPACE, " "))
    size, start = v.size[t.ids], v.start[t.ids]
    head = t.bounds[:-1][np.diff(t.bounds) > 0]  # without the space that was put before
    size[head] -= 1
    start[head] += 1
    back = v.bytes[ragged(start, size)]
    begin = np.concatenate([[0], np.cumsum(size)])[t.bounds]
    want = np.diff(at)[t.docs]
    same = np.diff(begin) == want
    rows = np.flatnonzero(same)
    if len(rows) < len(t.docs) or len(rows) < len(texts):
        back, data = back[ragged(begin[:-1][rows], want[rows])], data[ragged(at[t.docs[rows]], want[rows])]
    same[rows[np.searchsorted(np.cumsum(want[rows]), np.flatnonzero(back != data), "right")]] = False
    return same


def texts_of(ids: Sequence[np.ndarray], v: Vocabulary) -> Iterator[str]:
    for x in ids:
        size = v.size[x]
        ends = np.cumsum(size)
        data = v.bytes[np.repeat(v.start[x] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        yield data[1:].tobytes().decode("utf-8", "replace")  # without the space that was put before


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the text that ``ids`` stand for; null ids give an empty one. What looked like a space (U+2581) is a space."""
    path = path or default_model()

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        v = vocabulary(path)
        rows = [np.frombuffer(r or b"", v.kind).astype(np.int64) for r in batch.column(ids).to_pylist()]
        return [pa.array(list(texts_of(rows, v)), pa.string())]

    return append(df, {into: "string"}, work, ids, BLOCK, drop)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, "doc_id", drop=("text",), round_trip=True).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
