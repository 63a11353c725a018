"""Asynchronous actions on a session: submit, map, gather, wait, cancel, publish."""

from __future__ import annotations

import concurrent.futures as cf
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


class Future:
    """A running or finished action. Its Spark jobs carry a tag, by which it can be cancelled."""

    def __init__(self, client: Client, key: str, inner: cf.Future):
        self.client, self.key, self._inner = client, key, inner

    def result(self, timeout: float | None = None):
        return self._inner.result(timeout)

    def exception(self, timeout: float | None = None) -> BaseException | None:
        return self._inner.exception(timeout)

    def done(self) -> bool:
        return self._inner.done()

    def cancelled(self) -> bool:
        return self._inner.cancelled() or self.key in self.client._cancelled

    @property
    def status(self) -> str:
        if self.cancelled():
            return "cancelled"
        if not self.done():
            return "pending"
        return "error" if self._inner.exception() else "finished"

    def cancel(self) -> None:
        self.client._cancelled.add(self.key)
        self._inner.cancel()
        self.client.spark.sparkContext.cancelJobsWithTag(self.key)

    def add_done_callback(self, function: Callable[[Future], None]) -> None:
        self._inner.add_done_callback(lambda _: function(self))


class Client:
    """Runs functions of Python or actions on frames in threads of the driver; the work on rows is Spark's."""

    def __init__(self, spark: SparkSession, threads: int = 16):
        self.spark = spark
        self._pool = cf.ThreadPoolExecutor(threads, thread_name_prefix="weft")
        self._keys: dict[str, Future] = {}
        self._cancelled: set[str] = set()
        self._published: dict[str, object] = {}
        self._lock = threading.Lock()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._pool.shutdown(wait=False, cancel_futures=True)

    def submit(self, function: Callable, *args, key: str | None = None, retries: int = 0, **kwargs) -> Future:
        """Starts ``function`` with futures among the arguments replaced by their results. An equal key gives the running future."""
        key = key or f"{getattr(function, '__name__', 'call')}-{uuid.uuid4().hex}"
        with self._lock:
            if key in self._keys and not self._keys[key].cancelled():
                return self._keys[key]
            run = inheritable_thread_target(self.spark)(self._run)
            future = self._keys[key] = Future(self, key, self._pool.submit(run, key, function, args, kwargs, retries))
        return future

    def _run(self, key: str, function: Callable, args: tuple, kwargs: dict, retries: int):
        sc = self.spark.sparkContext
        value = lambda x: x.result() if isinstance(x, Future) else x
        sc.addJobTag(key)
        try:
            while True:
                try:
                    return function(*map(value, args), **{k: value(v) for k, v in kwargs.items()})
                except Exception:
                    if retries <= 0 or key in self._cancelled:
                        raise
                    retries -= 1
        finally:
            sc.removeJobTag(key)

    def map(self, function: Callable, *lists: Iterable, **kwargs) -> list[Future]:
        return [self.submit(function, *args, **kwargs) for args in zip(*lists)]

    def compute(self, df: DataFrame, key: str | None = None) -> Future:
        """The rows of a frame, collected in the background: for results of bounded size."""
        return self.submit(df.collect, key=key)

    def persist(self, df: DataFrame) -> tuple[DataFrame, Future]:
        """The frame, kept in the cluster's memory, and the future of its first run."""
        kept = df.persist()
        return kept, self.submit(kept.count)

    def scatter(self, rows: Iterable, schema) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def gather(self, futures: Iterable[Future], errors: str = "raise") -> list:
        """Results in order; ``errors="skip"`` leaves failed ones out."""
        out = []
        for f in futures:
            try:
                out.append(f.result())
            except Exception:
                if errors != "skip":
                    raise
        return out

    def cancel(self, futures: Iterable[Future]) -> None:
        for f in futures:
            f.cancel()

    def retry(self, futures: Iterable[Future], function: Callable, *args) -> list[Future]:
        return [self.submit(function, *args) for f in futures if f.status == "error"]

    def publish(self, **data) -> None:
        with self._lock:
            taken = sorted(self._published.keys() & data.keys())
            if taken:
                raise KeyError(f"already published: {', '.join(taken)}")
            self._published |= data

    def unpublish(self, name: str) -> None:
        with self._lock:
            del self._published[name]

    def published(self, name: str | None = None):
        return sorted(self._published) if name is None else self._published[name]


def as_completed(futures: Iterable[Future], timeout: float | None = None) -> Iterator[Future]:
    by = {f._inner: f for f in futures}
    return (by[x] for x in cf.as_completed(by, timeout))


def wait(futures: Iterable[Future], timeout: float | None = None, first: bool = False) -> tuple[set[Future], set[Future]]:
    """Done and not done, when all are done, or one is."""
    by = {f._inner: f for f in futures}
    done, rest = cf.wait(by, timeout, cf.FIRST_COMPLETED if first else cf.ALL_COMPLETED)
    if not first and rest:
        raise TimeoutError(f"{len(rest)} futures have not ended")
    return {by[x] for x in done}, {by[x] for x in rest}


def progress(spark: SparkSession) -> dict[str, int]:
    """Stages that run now, their tasks and how many are done."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    return {"stages": len(stages), "tasks": sum(s.numTasks for s in stages), "done": sum(s.numCompletedTasks for s in stages)}
