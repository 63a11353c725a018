"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.sources.shared import shared_folder

#: What separates words: blank and the characters 0x09 to 0x0D.
SPACES = "[\\x20\\x09-\\x0D]+"

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it.

    What follows starts from files that survive lost executors; unlike checkpoint() it computes ``df`` once.
    """
    return written(df)[0]


def written(df: DataFrame, files: int | None = None) -> tuple[DataFrame, str]:
    """As ``cut``, with the path, for tables that are removed as soon as later ones replace them; in so many files at most."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def partitions_for(df: DataFrame, amount: int, each: int) -> int:
    """Partitions of about ``each`` rows or bytes, and no fewer than the session deals out."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings one after another, and where each begins (one more: the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``most`` bytes of ``column``; a longer text comes alone, whole."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def append(df: DataFrame, added: dict[str, str], work: Callable[[pa.RecordBatch], list[pa.Array]], text: str, most: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns (name to type) that ``work`` computes from batches of up to ``most`` bytes of ``text``.

    Columns in ``drop`` go, and so does a column that is named as an added one, unless it is ``text``'s own.
    """
    keep = [c for c in df.columns if c not in added and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, most):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + work(batch), [*keep, *added])

    return df.select(*(c for c in df.columns if c == text or c not in added)).mapInArrow(run, schema)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all parts. Offsets get 64 bits: with 32, pyarrow deals a column of over 2 GiB to several batches."""
    large = {pa.binary(): pa.large_binary(), pa.string(): pa.large_string()}
    schema = pa.schema([(f.name, large.get(f.type, f.type)) for f in parts[0].schema])
    batches = pa.Table.from_batches(parts).cast(schema).combine_chunks().to_batches()
    if len(batches) != 1:
        raise ValueError("a group doesn't fit one batch")
    return batches[0]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Whole groups out of rows sorted by ``key``, many small groups to a batch; texts and bytes get 64-bit offsets."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last or (rest and rest[-1].column(key)[-1].as_py() != keys[0]):
            yield _whole([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield _whole(rest)


def narrow(batch: pa.RecordBatch, schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts with the types of ``schema``, as Spark takes them."""
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema, strict=True)], schema=schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def crc_mod4(key: str) -> Column:
    """crc32 of a column as text, modulo 4 (null: -1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4, F.lit(-1))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Spans:
    """64-bit fingerprints of any spans of a byte array, from prefix sums of a polynomial modulo 2**64.

    Of the powers only those below ``W`` and the multiples of ``W`` are held.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    BACK = pow(BASE, -1, 1 << 64)
    BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))
    W = 1 << 12
    LOW, ILOW = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, b, np.uint64)]), dtype=np.uint64) for b in (BASE, BACK))
    #: Bytes worked on at once.
    BLOCK = 1 << 18

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.high, self.ihigh = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n // self.W + 1, pow(b, self.W, 1 << 64), np.uint64)]), dtype=np.uint64) for b in (self.BASE, self.BACK))
        self.sums = np.zeros(n + 1, np.uint64)
        for a in range(0, n, self.BLOCK):
            part = self.BYTE[data[a : a + self.BLOCK]]
            part *= self._powers(self.high, self.LOW, a, a + len(part))
            np.cumsum(part, out=self.sums[a + 1 : a + 1 + len(part)])
            self.sums[a + 1 : a + 1 + len(part)] += self.sums[a]

    def _powers(self, high: np.ndarray, low: np.ndarray, a: int, b: int) -> np.ndarray:
        """From ``a``, a multiple of ``W``, to ``b``."""
        k = a // self.W
        return (high[k : -(-b // self.W), None] * low).reshape(-1)[: b - a]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = self.ihigh[start >> 12] * self.ILOW[start & 4095]
        return mix((self.sums[end] - self.sums[start]) * back + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Of the ``k`` bytes from each place on."""
        out = np.zeros(max(0, len(self.sums) - k), np.uint64)
        for a in range(0, len(out), self.BLOCK):
            b = min(a + self.BLOCK, len(out))
            out[a:b] = mix((self.sums[a + k : b + k] - self.sums[a:b]) * self._powers(self.ihigh, self.ILOW, a, b))
        return out


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that lie in ``data`` from ``at`` on, and the first word of each text."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    begins, ends = space[:-1] & ~space[1:], ~space[:-1] & space[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    joined = inner[~space[inner] & ~space[inner + 1]]  # two texts meet without a space
    begins[joined] = ends[joined] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, at)
