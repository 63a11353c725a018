"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import U, append, crc_mod4, cut, table

#: Lengths of the subwords, in characters; buckets of their hashes (a power of two); size of an embedding.
SUBWORDS, BUCKETS, DIM = 4, 1 << 16, 16
#: The sample: at most so many labelled texts of each language, from each a long and a short window of so many characters.
TEXTS_EACH, WINDOWS = 1500, (400, 60)
#: Times that the sample is gone through, and least number of steps; rate of the first step.
EPOCHS, STEPS, RATE = 3, 12_000, 0.5
#: Rejected are at most this share of the calibration windows that are labelled right, and only as far as it takes
#: to have this precision among the rest.
MOST_REJECTED, PRECISION = 0.002, 0.995
#: Languages are left out in turn in so many groups at most; to tell them apart, at most this share of the calibration
#: windows that are labelled right is lost besides.
FOLDS, MOST_LOST = 4, 0.01
BLOCK, STARTS = 2 << 20, 1 << 18
#: Sampling rates go to all tasks as a broadcast for up to so many languages.
MOST_BROADCAST = 10_000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Fixed odd multipliers of the hashes.
STEP, SPREAD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def subwords(codes: np.ndarray, at: np.ndarray, a: int, b: int) -> Iterator[np.ndarray]:
    """Buckets of the subwords of each length that begin at ``a`` to ``b``; ``BUCKETS`` where a text ends before."""
    end = np.repeat(at[1:], np.diff(at))[a:b] if len(at) > 2 else np.full(b - a, at[-1])
    value = np.zeros(b - a, np.uint64)
    for n in range(1, SUBWORDS + 1):
        c = codes[a + n - 1 : b + n - 1]
        value = value * STEP
        value[: len(c)] += c + U(1)
        bucket = ((value * SPREAD) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        bucket[np.arange(a, b) + n > end] = BUCKETS
        yield bucket


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), at


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # what each bucket adds to the score of each language; a last row of zeros
    bias: np.ndarray
    heat: float = 1.0
    least: float = 0.0
    floor: float = -np.inf  # least strength: the greatest logit, which is low where few subwords were learned

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of whole texts, in blocks of starts."""
        codes, at = code_points([t.lower() for t in texts])
        sums, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        filled = np.flatnonzero(np.diff(at))
        for a in range(0, len(codes), STARTS):
            b = min(a + STARTS, len(codes))
            lo, hi = np.searchsorted(at[filled], (a, b - 1), "right") - (1, 0)
            here = filled[lo:hi]
            begin = np.maximum(at[here], a) - a
            for bucket in subwords(codes, at, a, b):
                sums[here] += np.add.reduceat(self.table[bucket], begin)
                n[here] += np.add.reduceat(bucket < BUCKETS, begin)
        return sums / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score, whether it is accepted."""
        known = np.array([bool(t and _LETTER.search(t)) and bool(self.langs) for t in texts], bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), known
        x = self.logits([t or "" for t in texts])
        p = softmax(x / self.heat)
        best = p.argmax(1)
        score = np.where(known, p.max(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score, known & (score >= self.least) & (x.max(1) >= self.floor)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _negatives(rows: list[tuple[str, str, bool]], model: Model) -> np.ndarray:
    """Strengths of calibration windows scored by a model that was trained without their languages, on the scale of ``model``.

    None if that would leave less than two languages: a model of one has nothing to learn.
    """
    held, n = [(t, y) for t, y, h in rows if h and _LETTER.search(t)], min(FOLDS, len(model.langs))
    usual = lambda m, texts: np.median(m.logits(texts).max(1))
    scale, out = usual(model, [t for t, _ in held]), [np.zeros(0)]
    for left_out in (set(model.langs[k::n]) for k in range(n) if len(model.langs) > 2):
        inside, outside = ([t for t, y in held if (y in left_out) is x] for x in (False, True))
        if inside and outside:
            other = train([r for r in rows if r[1] not in left_out])
            out.append(other.logits(outside).max(1) * (scale / usual(other, inside)))
    return np.sort(np.concatenate(out))


def fit(rows: list[tuple[str, str, bool]]) -> Model:
    """The trained model with its temperature and the bounds of rejection, from windows as for ``train``.

    The least strength is the one that sets left-out languages best apart from the windows that are labelled right; it
    loses no more than ``MOST_LOST`` of these. With one or two languages there is none.
    """
    model = train(rows)
    held = [(t, y) for t, y, h in rows if h and _LETTER.search(t)]
    if held:
        x, y = model.logits([t for t, _ in held]), np.array([model.langs.index(v) for _, v in held])
        clean, strange = np.sort(x.max(1)[x.argmax(1) == y]), _negatives(rows, model)
        if len(clean) and len(strange):
            lost = np.arange(int(MOST_LOST * len(clean)) + 1)  # as many are below each of these strengths
            model.floor = float(clean[(np.searchsorted(strange, clean[lost]) / len(strange) - lost / len(clean)).argmax()])
    return model


def train(rows: list[tuple[str, str, bool]]) -> Model:
    """From windows (text, language, whether it serves to calibrate), by stochastic gradient descent with a fixed seed."""
    langs = sorted({y for _, y, _ in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    rng = np.random.default_rng(7)
    e = np.concatenate([rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    data = []
    for text, y, held in rows:
        codes, at = code_points([text.lower()])
        if not held and len(codes):
            grams, n = np.unique(np.concatenate(list(subwords(codes, at, 0, len(codes)))), return_counts=True)
            grams, n = (grams[:-1], n[:-1]) if grams[-1] == BUCKETS else (grams, n)
            data.append((grams, (n / n.sum()).astype(np.float32), langs.index(y)))
    epochs = max(EPOCHS, -(-STEPS // max(1, len(data))))
    steps = epochs * len(data)
    for k, i in enumerate(np.concatenate([rng.permutation(len(data)) for _ in range(epochs)]) if data else []):
        grams, share, y = data[i]
        rows_ = e[grams]
        hidden = share @ rows_
        g = softmax((hidden @ w + bias)[None])[0]
        g[y] -= 1
        rate = RATE * (1 - k / steps)
        back = w @ g
        w -= rate * np.outer(hidden, g)
        bias -= rate * g
        e[grams] = rows_ - rate * DIM * share[:, None] * back
    model = Model(langs, (e @ w).astype(np.float64), bias.astype(np.float64))
    held = [(t, y) for t, y, h in rows if h and _LETTER.search(t)]
    if held:
        x, y = model.logits([t for t, _ in held]), np.array([langs.index(v) for _, v in held])
        loss = {h: -np.log(softmax(x / h)[np.arange(len(y)), y] + 1e-12).mean() for h in np.geomspace(0.05, 5, 41)}
        model.heat = min(loss, key=loss.get)
        p = softmax(x / model.heat)
        right, score = p.argmax(1) == y, p.max(1)
        order = np.argsort(score)
        precise = (np.cumsum(right[order][::-1]) / np.arange(1, len(order) + 1))[::-1] >= PRECISION
        wanted = score[order][precise.argmax()] if precise.any() else 1.0
        model.least = float(min(wanted, np.quantile(score[right], MOST_REJECTED) if right.any() else 0.0))
    return model


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fits the model on a sample of bounded size, the same in each run, of the rows whose text and language aren't null.

    Texts are sampled by their hash at a rate that follows the number of different texts of their language; copies of
    a text count once. Only windows of the sampled texts come to the driver: at most ``TEXTS_EACH`` texts a language,
    ``sum(WINDOWS)`` characters a text.
    """
    df = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("y"))
    df = df.withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 34))
    # a row for each language, as the model has a column for each
    rate = cut(df.groupBy("y").agg(F.least(F.lit(1.0), 1.2 * TEXTS_EACH / F.approx_count_distinct("h", 0.02)).alias("rate")))
    df = df.join(F.broadcast(rate) if rate.count() <= MOST_BROADCAST else rate, "y").filter(F.col("h") < F.col("rate") * (1 << 30))
    n, h = F.length("t"), F.col("h")
    window = lambda size, salt: F.substr("t", (F.pmod(h * salt, F.greatest(n - size + 1, F.lit(1))) + 1).cast("int"), F.lit(size))
    some = df.select("y", "h", *(window(size, 2 * i + 1).alias(f"w{i}") for i, size in enumerate(WINDOWS))).groupBy("y", "h").agg(*(F.min(f"w{i}").alias(f"w{i}") for i in range(len(WINDOWS))))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).filter(F.col("k") <= TEXTS_EACH).drop("k")
    got = some.toPandas().sort_values(["y", "h"])
    return fit([(w, r.y, r.h % 5 == 0) for r in got.itertuples() for w in (r.w0, r.w1)])


def identify(df: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``accepted``, from nothing but the whole text.

    Null texts and such without a letter are ``und`` with score 0 and not accepted, as is all if no language was
    learned. Texts of any length count whole; repeated rows get the same; an empty table stays empty; columns named
    as the added ones are replaced, others stay but those in ``drop``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of languages alone

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, score, accepted = shared.value.predict(batch.column(text).to_pylist())
        return [pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)]

    return append(df, {"lang_pred": "string", "score": "double", "accepted": "boolean"}, work, text, BLOCK, drop)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod4("doc_id") == 2)
    model = learn(docs.filter(~F.col("held_out")))
    return identify(docs.drop("lang"), model, drop=("text",))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
