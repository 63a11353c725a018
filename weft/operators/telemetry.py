"""Analytics over logs of work: spans, states, durations, profiles, stories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.windows import dense_by_first
from weft.sources.shared import stored


def states(df: DataFrame, by: Sequence[str], state: str, names: Sequence[str]) -> DataFrame:
    """Counts of each state as columns."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(state) == n).alias(n) for n in names))


def descendants(spans: DataFrame, id_: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """``root node level`` for every span and all below it, at any depth; spans in a ring are an error.

    Pairs below twice the depth are joined from those known and those at that depth, until none is so deep. What a
    round makes is written out, so that no round is run again by those after it.
    """
    jump = stored(spans.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_p"), F.col(id_).alias("_c")))
    out = stored(spans.select(F.col(id_).alias("root"), F.col(id_).alias("node"), F.lit(0).alias("level")))
    depth = 1
    while not jump.isEmpty():
        deeper = stored(out.join(jump, out.node == jump._p).select("root", F.col("_c").alias("node"), (F.col("level") + depth).alias("level")))
        if not deeper.where("root = node").isEmpty():
            raise ValueError("spans are above themselves")
        out = out.unionByName(deeper)
        jump = stored(jump.alias("a").join(jump.alias("b"), F.col("a._c") == F.col("b._p")).select("a._p", "b._c"))
        depth *= 2
    return out


def subtree_sums(spans: DataFrame, own: DataFrame, values: Sequence[str], by: Sequence[str] = (), id_: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """Sums of ``values`` of ``own`` over each span and all below it, at any depth, also ``by`` further columns; spans in a ring are an error.

    No row is made for each pair of spans. As long as half of the spans left have none below them, those are finished,
    and their sums go to the spans above them, so all rounds together take a few times the input. Deep chains, of which
    that would leave most, are doubled: sums over less than d levels and steps of d levels give sums over less than 2 d.
    Repeated spans and several parents count for each way from span to span, as with ``descendants``.
    """
    keys = [id_, *by]
    sums = lambda df: stored(df.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values)))
    total = sums(own.where(F.col(id_).isNotNull()))
    up = stored(spans.where(F.col(id_).isNotNull() & F.col(parent).isNotNull()).groupBy(id_).agg(F.collect_list(parent).alias("_up")))
    done = []
    while True:
        inner = up.select(F.explode("_up").alias(id_)).distinct().withColumn("_inner", F.lit(True))
        up = stored(up.join(inner, id_, "left"))
        n, leaves = up.agg(F.count("*"), F.count_if(F.col("_inner").isNull())).first()
        if not n or 2 * leaves < n:
            break
        at = stored(total.join(up, id_, "left").withColumn("_leaf", F.col("_up").isNotNull() & F.col("_inner").isNull()))
        done.append(at.where("_leaf").select(*keys, *values))
        lifted = at.where("_leaf").select(F.explode("_up").alias(id_), *by, *values)
        total = sums(at.where("NOT _leaf").select(*keys, *values).unionByName(lifted))
        up = up.where("_inner").drop("_inner")
    steps, depth = up.select(F.explode("_up").alias("_p"), F.col(id_).alias("_c")), 1
    while not steps.isEmpty():
        if depth > n:
            raise ValueError("spans are above themselves")
        below = steps.join(total, steps["_c"] == total[id_]).select(F.col("_p").alias(id_), *by, *values)
        total = sums(total.unionByName(below))
        steps = stored(steps.alias("a").join(steps.alias("b"), F.col("a._c") == F.col("b._p")).select("a._p", "b._c"))
        depth *= 2
    # spans that repeat count each; parents that are no spans go
    times = spans.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.count("*").alias("_times"))
    return reduce(DataFrame.unionByName, done, total).join(times, id_).select(*keys, *((F.col(v) * F.col("_times")).alias(v) for v in values))


def at_or_below(spans: DataFrame, some: DataFrame, id_: str = "span_id", parent: str = "parent_id") -> DataFrame:
    """The ids in ``some`` and those of all spans below them, each once; a ring that none of these leads into is an error.

    Each span that isn't known to be below asks the one d levels above it, which knows of all less than d levels above
    itself; then d doubles.
    """
    known = stored(some.select(id_).where(F.col(id_).isNotNull()).distinct())
    rest = spans.where(F.col(id_).isNotNull() & F.col(parent).isNotNull()).groupBy(id_).agg(F.collect_set(parent).alias("_up"))
    rest = stored(rest.join(known, id_, "left_anti"))
    n, depth = rest.count(), 1
    while not rest.isEmpty():
        if depth > n:
            raise ValueError("spans are above themselves")
        asked = known.select(F.col(id_).alias("_a"), F.lit(True).alias("_hit"), F.lit(None).alias("_next"))
        asked = asked.unionByName(rest.select(F.col(id_).alias("_a"), F.lit(False).alias("_hit"), F.col("_up").alias("_next")))
        got = rest.select(id_, F.explode("_up").alias("_a")).join(asked, "_a").groupBy(id_)
        got = stored(got.agg(F.max("_hit").alias("_hit"), F.array_distinct(F.flatten(F.collect_list("_next"))).alias("_up")))
        known = known.unionByName(got.where("_hit").select(id_))
        rest = got.where("NOT _hit AND size(_up) > 0").drop("_hit")
        depth *= 2
    return known


def by_tags(spans: DataFrame, tags: Sequence[str], id_: str = "span_id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Spans whose name has one of the tags, without those whose parent has."""
    hit = spans.where(F.arrays_overlap(name, F.array(*map(F.lit, tags))))
    return hit.join(hit.select(F.col(id_).alias(parent)), parent, "left_anti").select(*spans.columns)


def story(log: DataFrame, keys: Sequence[str], key: str = "key", stimulus: str = "stimulus_id", time: str = "timestamp") -> DataFrame:
    """Rows of a transition log that touch one of the keys or stimuli, in order."""
    return log.where(F.col(key).isin(*keys) | F.col(stimulus).isin(*keys)).orderBy(time)


def merge_profiles(profiles: DataFrame, path: str = "path", count: str = "count") -> DataFrame:
    """Call trees given by path and own count: for each path the count of it and all below."""
    up = profiles.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(F.col(path), F.lit(1), n))).alias(path), F.col(count).alias("_n"))
    return up.groupBy(path).agg(F.sum("_n").alias(count))


def icicle(profile: DataFrame, path: str = "path", count: str = "count") -> DataFrame:
    """Left and right end of each call among its siblings, by falling count."""
    w = Window.partitionBy(F.slice(F.col(path), F.lit(1), F.size(path) - 1)).orderBy(F.desc(count), path)
    right = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return profile.withColumns({"left": right - F.col(count), "right": right})


def rectangles(tasks: DataFrame, worker: str, start: str, stop: str, position: str) -> DataFrame:
    """Middle and length (milliseconds) of each piece of work and the row of its worker, numbered by first appearance."""
    df = tasks.withColumns({"mid": (F.col(start) + F.col(stop)) / 2, "ms": (F.col(stop) - F.col(start)) * 1000})
    return dense_by_first(df, worker, position, "lane")


def summary(df: DataFrame, state: str, names: Sequence[str], value: str) -> DataFrame:
    """One row: how many, how many in each state, and the sum of a value."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(F.col(state) == n).alias(n) for n in names), F.sum(value).alias("total"))


def time_slice(log: DataFrame, time: str, start=None, stop=None) -> DataFrame:
    """Rows from ``start`` on and before ``stop``."""
    if start is not None:
        log = log.where(F.col(time) >= start)
    return log if stop is None else log.where(F.col(time) < stop)


def profile_of(samples: DataFrame, time: str, start=None, stop=None, path: str = "path", count: str = "count", **where) -> DataFrame:
    """The merged profile of the samples of a range of time, of those with the given values of other columns."""
    some = time_slice(samples, time, start, stop)
    for column, value in where.items():
        some = some.where(F.col(column) == value)
    return merge_profiles(some, path, count)


def subtree_metrics(spans: DataFrame, metrics: DataFrame, active: DataFrame, id_: str = "span_id", parent: str = "parent_id", name: str = "activity", value: str = "value") -> DataFrame:
    """Sums of each metric over a span and all below it, and what of the active seconds (``span_id active``) none of them knows."""
    sums = stored(subtree_sums(spans, metrics, [value], [name], id_, parent))
    known = sums.groupBy(id_).agg(F.sum(value).alias("_known"))
    rest = active.join(known, id_, "left").select(id_, F.lit("idle or other spans").alias(name), F.greatest(F.lit(0.0), F.col("active") - F.coalesce("_known", F.lit(0.0))).alias(value))
    return sums.unionByName(rest)


def merge_by_tags(spans: DataFrame, tags: Sequence[str], values: Sequence[str], id_: str = "span_id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """One row: the sums of ``values`` over the topmost spans that have one of the tags, and all below them."""
    top = by_tags(spans, tags, id_, parent, name)
    return spans.join(at_or_below(spans, top, id_, parent), id_, "left_semi").agg(F.count("*").alias("spans"), *(F.sum(v).alias(v) for v in values))
