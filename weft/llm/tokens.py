"""Token counts by a deterministic transducer compiled from a piece vocabulary.

The transducer reads one character at a time. A transition says by how many tokens the encoding of the text so far
grows (it can shrink, when a longer piece takes over). Its state holds what later characters can depend on: the end
of the text that may still grow into a longer piece, with the last token and the relative token count before each
of its characters. Transitions are compiled as texts call for them and kept by the Python worker.

Words start at the root. Longer ones are cut into chunks, each with a map from the states it can be entered in to exit
state and tokens. Maps hold the states that occur: the root, and whatever chunks in front leave, until nothing new
turns up; equal chunks share a map. A prefix scan composes them: maps merge pairwise up a tree, and entry states come
down it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import U, append, mix, table, utf8

#: Characters of a chunk; a longer word is cut, and the state maps of its chunks are composed, so many cells at once.
CHUNK, CELLS = 48, 1 << 21
#: The worker's transitions are dropped and compiled anew beyond this many (about 100 MB).
MOST_TRANSITIONS = 2_000_000
#: Texts are worked on in blocks of about this many bytes, words of about this many characters.
BLOCK, SPAN = 2 << 20, 1 << 20
SPACE = "▁"


class Transducer:
    """Counts tokens as greedy best-pair merging over ``scores`` (piece to score) gives them."""

    ROOT = 0

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.alive = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces with a space after another character are not supported")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._pairs.clear()
        self._whole.clear()
        # A state: the end that may still grow, and (last token, tokens) before each of its characters and after it.
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple] = []
        self._id(("", ((None, 0),)))
        self._size = 1 << 16
        self._keys = np.full(self._size, -1, np.int64)
        self._next = np.zeros(self._size, np.int32)
        self._grows = np.zeros(self._size, np.int16)
        self._used = 0

    def _id(self, state: tuple) -> int:
        k = self._ids.setdefault(state, len(self._states))
        if k == len(self._states):
            self._states.append(state)
        return k

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text: again and again the best pair merges, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, last: str | None, piece: str) -> bool:
        """A sequence of pieces is an encoding if each two neighbours are the encoding of their text."""
        if last is None:
            if piece not in self._whole:
                self._whole[piece] = self.merged(piece) == [piece]
            return self._whole[piece]
        if (last, piece) not in self._pairs:
            self._pairs[last, piece] = self.merged(last + piece) == [last, piece]
        return self._pairs[last, piece]

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """Next state and growth of the count."""
        if char not in self.scores:  # falls back to bytes, which never merge
            return self.ROOT, len(char.encode("utf-8", "surrogatepass"))
        end, before = self._states[state]
        if char == SPACE and end.strip(SPACE):  # no piece holds a space after other characters
            end, before = "", ((None, 0),)
        text = end + char
        for i in range(len(text)):
            if text[i:] in self.scores and before[i] and self._follows(before[i][0], text[i:]):
                token, count = text[i:], before[i][1] + 1
                break
        else:
            raise ValueError(f"no encoding ends with {text!r}")
        grows = count - before[-1][1]
        cells = (*before, (token, count))
        k = next(k for k in range(len(text) + 1) if k == len(text) or text[k:] in self.alive)
        # where no piece can begin any more, the state forgets what came before
        return self._id((text[k:], tuple((cells[i][0], cells[i][1] - count) if i == len(text) or text[i:] in self.alive else None for i in range(k, len(text) + 1)))), grows

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where the hash table has each key; -1 if nowhere."""
        mask = self._size - 1
        at = (mix(keys.astype(np.uint64)) & U(mask)).astype(np.int64)
        found = self._keys[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found[open_] = self._keys[at[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] != -1)]
        at[found == -1] = -1
        return at

    def _put(self, keys: np.ndarray, states: np.ndarray, grows: np.ndarray) -> None:
        """Adds new keys; all take their places in step, and of those that want the same place one gets it."""
        self._used += len(keys)
        if self._used * 4 > self._size:
            full = np.flatnonzero(self._keys >= 0)
            keys, states, grows = (np.concatenate(x) for x in ((keys, self._keys[full]), (states, self._next[full]), (grows, self._grows[full])))
            while self._used * 4 > self._size:
                self._size *= 4
            self._keys, self._next, self._grows = np.full(self._size, -1, np.int64), np.zeros(self._size, np.int32), np.zeros(self._size, np.int16)
        mask = self._size - 1
        at = (mix(keys.astype(np.uint64)) & U(mask)).astype(np.int64)
        while len(keys):
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[free]
            won = self._keys[at] == keys
            self._next[at[won]], self._grows[at[won]] = states[won], grows[won]
            keys, states, grows, at = keys[~won], states[~won], grows[~won], (at[~won] + 1) & mask

    def _run(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state map of each chunk at one entry state: exit state and tokens. All chunks advance in step."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], entry[order].astype(np.int64)
        count = np.zeros(len(start), np.int64)
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))  # chunks longer than i
            keys = (state[:n] << 21) | codes[start[:n] + i]
            at = self._find(keys)
            if (at < 0).any():
                new = np.unique(keys[at < 0])
                made = np.array([self._compile(k >> 21, chr(k & 0x1FFFFF)) for k in new.tolist()], np.int64)
                self._put(new, made[:, 0], made[:, 1])
                at = self._find(keys)
            state[:n] = self._next[at]
            count[:n] += self._grows[at]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def _maps(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State maps of chunks, ``head`` of which begin words: of each chunk and place in its list of entry states, the
        place of the exit state in the list of the next chunk, and the tokens; and the number of the chunk's list."""
        n = len(start)
        text = np.full((n, CHUNK), -1, np.int32)
        inside = np.arange(CHUNK) < length[:, None]
        text[inside] = codes[(start[:, None] + np.arange(CHUNK))[inside]]
        _, sample, kind = np.unique(text.view(f"V{4 * CHUNK}").reshape(-1), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([kind[:-1], kind[1:]], 1)[~head[1:]], axis=0) if n > 1 else np.zeros((0, 2), np.int64)
        after = pairs[np.argsort(pairs[:, 0], kind="stable")]  # which chunks follow which
        first = np.searchsorted(after[:, 0], np.arange(len(sample) + 1))
        where: dict[tuple[int, int], int] = {}  # chunk and entry state to the place in its list
        lists: list[list[tuple[int, int]]] = [[] for _ in sample]  # exit state and tokens
        new = np.stack([np.arange(len(sample)), np.zeros(len(sample), np.int64)], 1)
        while len(new):
            leave, count = self._run(codes, start[sample[new[:, 0]]], length[sample[new[:, 0]]], new[:, 1])
            for c, s, out, k in zip(new[:, 0].tolist(), new[:, 1].tolist(), leave.tolist(), count.tolist(), strict=True):
                where[c, s] = len(lists[c])
                lists[c].append((out, k))
            many = first[new[:, 0] + 1] - first[new[:, 0]]
            next_ = after[np.repeat(first[new[:, 0]] - np.cumsum(many) + many, many) + np.arange(many.sum()), 1]
            reached = np.unique(np.stack([next_, np.repeat(leave, many)], 1), axis=0)
            new = np.array([r for r in reached.tolist() if tuple(r) not in where], np.int64).reshape(-1, 2)
        width = max(map(len, lists))
        exits, tokens = np.zeros((len(sample), width), np.int64), np.zeros((len(sample), width), np.int64)
        for c, x in enumerate(lists):
            exits[c, : len(x)], tokens[c, : len(x)] = zip(*x, strict=True)
        place = np.zeros((n, width), np.int32)
        follow = np.flatnonzero(~head[1:])
        _, one, of = np.unique(kind[follow] * len(sample) + kind[follow + 1], return_index=True, return_inverse=True)
        known = [[where.get((c1, s), 0) for s in exits[c0].tolist()] for c0, c1 in zip(kind[follow[one]].tolist(), kind[follow[one] + 1].tolist(), strict=True)]
        if len(follow):
            place[follow] = np.array(known, np.int32)[of]
        return place, tokens, kind

    def _long(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Tokens of each chunk of words that were cut."""
        out, a = np.zeros(len(start), np.int64), 0
        heads = np.flatnonzero(head)
        while a < len(start):  # whole words, as many as come with the first ones
            b = int(np.append(heads, len(start))[np.searchsorted(heads, a + CELLS // 64)])
            place, tokens, kind = self._maps(codes, start[a:b], length[a:b], head[a:b])
            out[a:b] = tokens[kind, _entries(place)]
            a = b
        return out

    def counts(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text, given the code points of all of them, spaces as ``SPACE``, and where each begins."""
        if self._used > MOST_TRANSITIONS:
            self._clear()
        n = len(at) - 1
        if not len(codes):
            return np.zeros(n, np.int64)
        gap = codes == ord(SPACE)
        first = gap.copy()
        first[1:] &= ~gap[:-1]  # a run of spaces begins a word
        first[at[:-1][np.diff(at) > 0]] = True
        words = np.flatnonzero(first)
        size = np.diff(words, append=len(codes))
        ends, tokens, a = np.cumsum(size), np.zeros(len(words) + 1, np.int64), 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPAN, "right")))
            tokens[a + 1 : b + 1] = self._words(codes, words[a:b], size[a:b])
            a = b
        upto, edge = np.cumsum(tokens), np.searchsorted(words, at)
        return upto[edge[1:]] - upto[edge[:-1]]

    def _words(self, codes: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        pieces = -(-size // CHUNK)
        head = np.cumsum(pieces) - pieces
        k = np.arange(pieces.sum()) - np.repeat(head, pieces)
        start = np.repeat(words, pieces) + k * CHUNK
        length = np.minimum(np.repeat(words + size, pieces) - start, CHUNK)
        long_ = np.repeat(pieces > 1, pieces)
        count = np.zeros(len(start), np.int64)
        count[~long_] = self._run(codes, start[~long_], length[~long_], np.zeros(int((~long_).sum()), np.int64))[1]
        if long_.any():
            count[long_] = self._long(codes, start[long_], length[long_], k[long_] == 0)
        return np.add.reduceat(count, head)


def _entries(place: np.ndarray) -> np.ndarray:
    """The place of each chunk's entry state, by a scan over maps (chunk, place of the entry, place of the next entry).

    What begins a word is entered at the root, which is the first place of each list.
    """
    levels = [place]
    while len(levels[-1]) > 1:
        x = levels[-1]
        even, odd = x[: len(x) // 2 * 2 : 2], x[1::2]
        both = np.take_along_axis(odd, even, 1)
        levels.append(np.concatenate([both, x[-1:]]) if len(x) % 2 else both)
    entry = np.zeros(1, np.int64)
    for x in reversed(levels[:-1]):
        down = np.zeros(len(x), np.int64)
        down[::2] = entry
        half = len(x) // 2
        down[1::2] = x[: 2 * half : 2][np.arange(half), entry[:half]]
        entry = down
    return entry


@lru_cache(maxsize=2)
def pieces(path: str) -> Transducer:
    """The transducer of a piece model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return Transducer(scores)


def _normal(text: str) -> str:
    """As the model's normaliser: a space in front of any text, spaces shown as ``SPACE``."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def token_counts(texts: list[str | None], path: str, begin: bool = True) -> np.ndarray:
    """Tokens of each text; without ``begin`` as they are inside a longer one, after a character that no piece holds."""
    counter = pieces(path)
    whole = [_normal(t or "") if begin else (t or "").replace(" ", SPACE) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
    return counter.counts(np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).view(np.int32), at)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, into: str = "n_tokens", size_into: str | None = None) -> DataFrame:
    """Replaces ``text`` by its tokens (``into``, long) and, on request, its UTF-8 bytes (``size_into``, long).

    ``path`` is the model file on every machine. Null counts as empty, an empty text has no tokens, a text of any
    length is counted whole; repeated rows and other columns stay as they are (a column named as a result is
    replaced); an empty table stays empty.
    """
    path = path or default_model()

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        out = [pa.array(token_counts(batch.column(text).to_pylist(), path))]
        return out + ([pa.array(np.diff(utf8(batch.column(text))[1]))] if size_into else [])

    return append(df, {into: "bigint"} | ({size_into: "bigint"} if size_into else {}), work, text, BLOCK, (text,))


#: A document of more tokens than this is over the limit.
LIMIT = 4096


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = count_tokens(docs, size_into="n_bytes")
    return df.select("doc_id", "n_bytes", "n_tokens", (df.n_tokens > LIMIT).alias("over_limit"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
