"""Events of one stream given to several handlers: each event once for each handler, whatever fails or stops in between."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Handle = Callable[[DataFrame, int], None]


class Handler(NamedTuple):
    name: str  # letters, digits, - and _
    kinds: tuple[str, ...]  # event types it wants; empty for all
    handle: Handle  # gets the events and their batch number; a repeated call with one number must replace what the first left


class Ledger:
    """Which (handler, batch) pairs are done, as empty files in a store that all share; and the events still owed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, tail: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}" if tail else self.root)

    def has(self, handler: str, batch: int) -> bool:
        return self.files.exists(self._path(f"done/{handler}/{batch}"))

    def add(self, handler: str, batch: int) -> None:
        self.files.create(self._path(f"done/{handler}/{batch}"), True).close()

    def owe(self, handler: str, batch: int, events: DataFrame) -> None:
        events.write.mode("overwrite").parquet(f"{self.root}/owed/{handler}/{batch}")

    def owed(self, handler: str) -> list[int]:
        """Batches stored whole for the handler and not done yet, ascending."""
        found = self.files.globStatus(self._path(f"owed/{handler}/*/_SUCCESS")) or []
        return sorted(n for n in (int(f.getPath().getParent().getName()) for f in found) if not self.has(handler, n))

    def paid(self, handler: str, batch: int) -> None:
        self.files.delete(self._path(f"owed/{handler}/{batch}"), True)

    def done(self) -> list[tuple[str, int]]:
        found = self.files.globStatus(self._path("done/*/*")) or []
        return sorted((f.getPath().getParent().getName(), int(f.getPath().getName())) for f in found)


def attempt(handler: Handler, events: DataFrame, batch: int, ledger: Ledger, log: list[tuple[str, int, str]]) -> bool:
    """Call a handler once and note its success; a failure is logged and goes no further."""
    try:
        handler.handle(events, batch)
    except Exception as error:  # one handler must not stop the others
        log.append((handler.name, batch, str(error)[:200]))
        return False
    ledger.add(handler.name, batch)
    return True


def emit(stream: DataFrame, handlers: list[Handler], root: str, state: str, kind_col: str = "event_type", attempts: int = 3) -> list[tuple[str, int, str]]:
    """Give all available events to all handlers; returns the failures as (handler, batch, error).

    Each micro-batch goes to each handler that the ledger under ``root`` does not name for it: after a stop in mid-batch
    only the others are called again. A handler that fails ``attempts`` times is owed the batch: its events are stored and
    offered again before the next batch and at the next run, while the other handlers go on. Handlers get a batch as a
    table of its own, so they can spread their work; one that writes by batch number leaves each event once.
    """
    spark = stream.sparkSession
    ledger, log = Ledger(spark, root), []

    def wanted(h: Handler, batch: DataFrame) -> DataFrame:
        return batch.where(F.col(kind_col).isin(*h.kinds)) if h.kinds else batch

    def settle(h: Handler) -> None:
        for n in ledger.owed(h.name):
            if attempt(h, spark.read.schema(stream.schema).parquet(f"{ledger.root}/owed/{h.name}/{n}"), n, ledger, log):
                ledger.paid(h.name, n)

    def dispatch(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for h in handlers:
                settle(h)
                if ledger.has(h.name, number):
                    continue
                events = wanted(h, batch)
                if not any(attempt(h, events, number, ledger, log) for _ in range(attempts)):
                    ledger.owe(h.name, number, events)
        finally:
            batch.unpersist()

    for h in handlers:
        settle(h)
    stream.writeStream.foreachBatch(dispatch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return log


def table_handler(name: str, root: str, kinds: tuple[str, ...] = (), change: Callable[[DataFrame], DataFrame] | None = None) -> Handler:
    """A handler that writes its events, changed by ``change``, as one folder a batch; a repeated call replaces it."""

    def handle(events: DataFrame, batch: int) -> None:
        (change(events) if change else events).write.mode("overwrite").parquet(f"{root}/batch={batch}")

    return Handler(name, kinds, handle)
