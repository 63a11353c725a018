"""Chat formatting: conversations as training windows within a token budget.

A conversation's turns stream by in order. Prefix sums of their tokens choose the spans: a window keeps the leading
system turns, repeats whole turns of history up to a limit, and takes new turns while they fit. Loss falls on the
texts of assistant turns where they are new; repeated ones are masked.

The tokens of a turn are those of the turn as it is formatted, marks and escapes included. A turn ends with a line end,
which no piece of the model holds, so the tokens of a window are the sum of those of its turns: the model's own count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import append, slices, table
from weft.llm.tokens import default_model, token_counts

#: Tokens of a window, of the turns it may repeat from before, and of the leading system turns that each window keeps.
BUDGET, HISTORY, SYSTEM = 1024, 256, 512
BLOCK = 1 << 20
OPEN, CLOSE, TARGET = "<|turn:{}|>", "<|end|>\n", "assistant"
#: What follows ``<`` or ``[`` in the control strings of common templates and of this one.
_CONTROL = r"(?=\||/?s>|/?SYS>>|/?INST\])"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[]\\*)" + _CONTROL), re.compile(r"([<\[]\\*)\\" + _CONTROL)
_TURN = re.compile(r"<\|turn:([^|]*)\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    """Breaks every control string by a backslash after its first character; those that have some get one more."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text lies in it."""
    head, body = OPEN.format(quote(role, safe=" ")), escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_back(text: str) -> list[tuple[str, str, int, int]]:
    """Role, text and place of the text of each turn of a window."""
    return [(unquote(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(text)]


class _Windows:
    """Windows of one conversation, made as its turns come. It holds a window and the turns that may be repeated."""

    def __init__(self, conv: int | None):
        self.conv, self.index, self.turns = conv, 0, 0
        self.system: list[tuple[str, str, int]] = []  # role, text, by how many tokens it is longer where a window begins
        self.leading = True
        self.past: list[tuple[str, str, int]] = []  # turns since the leading system turns, their prefix sums of tokens
        self.sums = [0]
        self.first = 0  # the first new turn among them
        self.fixed = 0  # tokens of the leading system turns

    def _used(self, begin: int) -> int:
        """Tokens of a window that shows the past from ``begin`` on."""
        lead = self.system[0] if self.system else self.past[begin] if begin < len(self.past) else None
        return self.fixed + self.sums[-1] - self.sums[begin] + (lead[2] if lead else 0)

    def close(self) -> tuple | None:
        n = len(self.past)
        if n == self.first and (self.index or not self.system):
            return None
        begin = int(np.searchsorted(self.sums[: self.first + 1], self.sums[self.first] - HISTORY, "left"))
        while begin < self.first and self._used(begin) > BUDGET:
            begin += 1  # whole turns of history that fit
        shown = [*((r, t, self.index == 0) for r, t, _ in self.system), *((r, t, i >= self.first) for i, (r, t, _) in enumerate(self.past) if i >= begin)]
        parts, at, loss = [], 0, []
        for role, text, new in shown:
            turn, a, b = turn_text(role, text)
            if new and role == TARGET:
                loss += [at + a, at + b]
            parts.append(turn)
            at += len(turn)
        new = len(self.past) - self.first + (len(self.system) if not self.index else 0)
        out = (self.conv, self.index, self.turns - new, new, self._used(begin), loss, "".join(parts))
        self.index += 1
        keep = int(np.searchsorted(self.sums, self.sums[n] - HISTORY, "left"))  # no later window repeats more
        self.past, self.sums, self.first = self.past[keep:], [x - self.sums[keep] for x in self.sums[keep:]], n - keep
        return out

    def _take(self, role: str, text: str, tokens: int, ahead: int) -> Iterator[tuple]:
        self.past.append((role, text, ahead))
        self.sums.append(self.sums[-1] + tokens)
        if len(self.past) - 1 > self.first and self._used(self.first) > BUDGET:
            self.past.pop(), self.sums.pop()
            out = self.close()
            if out:
                yield out
            self.past.append((role, text, ahead))
            self.sums.append(self.sums[-1] + tokens)

    def add(self, role: str, text: str, tokens: int, first: int) -> Iterator[tuple]:
        """``tokens`` of the turn inside a window, ``first`` if the window begins with it."""
        if self.leading and role == "system" and self.fixed + tokens <= SYSTEM:
            self.system.append((role, text, first - tokens))
            self.fixed += tokens
            self.turns += 1
            return
        self.leading = False
        for out in self._take(role, text, tokens, first - tokens):
            yield out
        self.turns += 1


FIELDS = {"conv_id": "bigint", "window": "int", "first_turn": "bigint", "new_turns": "bigint", "tokens": "bigint", "loss": "array<bigint>", "formatted": "string"}
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("new_turns", pa.int64()), ("tokens", pa.int64()), ("loss", pa.list_(pa.int64())), ("formatted", pa.string())])


def format_windows(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Windows of every conversation: ``conv_id``, ``window``, ``first_turn`` and ``new_turns`` (by position), ``tokens``,
    ``loss`` (start and end of each span of ``formatted`` under the loss, one after another) and ``formatted``.

    ``turns`` has ``conv_id turn role text``; others don't matter. Turns go by ``turn`` (null last), then role and text;
    repeated rows are turns of their own. Null texts and roles are empty; null conversations are one. An empty table
    gives no windows. The rows of a conversation lie together, in the order of the windows. No window has more than
    ``BUDGET`` tokens, unless a turn alone, with the system turns, has: a turn is never split. Leading system turns are
    kept by every window up to ``SYSTEM`` tokens; from the one that goes beyond on they are turns like others. A
    conversation is one stream, held a window at a time; its tokens are counted before, wherever its rows lie.
    """
    path = path or default_model()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = turns.select(F.col("conv_id").cast("bigint"), "turn", empty("role"), empty("text"))

    def sized(batch: pa.RecordBatch) -> list[pa.Array]:
        whole = [turn_text(r, t)[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        return [pa.array(token_counts(whole, path, begin)) for begin in (False, True)]

    turns = append(turns, {"tokens": "bigint", "first": "bigint"}, sized, "text", BLOCK)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Windows | None = None
        rows: list[tuple] = []
        held = 0
        for batch in slices(batches, "text", BLOCK):
            for conv, role, text, n, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens", "first")), strict=True):
                if now is None or now.conv != conv:
                    rows += [w] if now and (w := now.close()) else []
                    now = _Windows(conv)
                rows += now.add(role, text, n, first)
                held += len(text)
                if held > BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)
                    rows, held = [], 0
        rows += [w] if now and (w := now.close()) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    order = [F.asc_nulls_last(c) for c in ("conv_id", "turn", "role", "text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(work, ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def digest(windows: DataFrame) -> DataFrame:
    """What windows say, read back from ``formatted`` and ``loss`` alone, conversation by conversation as they stream by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for conv, new, loss, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "new_turns", "loss", "formatted")), strict=True):
                if now is None or now[0] != conv:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turns = read_back(text)
                for role, body, *_ in turns[len(turns) - new :]:
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for a, b in zip(loss[::2], loss[1::2], strict=True):
                    body = unescape(text[a:b])
                    now[3] += len(body)
                    now[4].update(body.encode())
                now[5] += len(text)
                now[6] += 1
            yield _out(done)
        if now:
            yield _out([now])

    def _out(done: list[list]) -> pa.RecordBatch:
        rows = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in done]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGEST)], schema=_DIGEST)

    return windows.mapInArrow(work, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")


#: The conversation that every run formats as well: control strings inside texts.
PLANTED = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digest(format_windows(turns.unionByName(planted)))


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLE_SQL: dict[str, str] = {}
