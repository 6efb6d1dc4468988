"""Structured Streaming operators and their runs over stored events.

Each run processes all available input with ``availableNow`` triggers and returns the stored result, so that it can be
compared with the batch query of the same meaning.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import upsert
from weftline.sources.folders import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of a Parquet table, some files a micro-batch; the schema is the stored one.

    The last part of the path is written as a pattern, so that a table may be one file or a folder of files.
    """
    head, _, tail = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{head}/[{tail[0]}]{tail[1:]}")


def keyword_stream(events: DataFrame, kinds: list[str], pattern: str) -> DataFrame:
    """The rows of some kinds whose properties match a pattern: a stateless filter and projection."""
    return events.where(F.col("event_type").isin(kinds) & F.col("props").rlike(pattern))


def once(events: DataFrame, key: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once, in whatever order the input comes: the state holds every key.

    With ``delay`` keys are forgotten behind the watermark of ``time``, and rows later than that are dropped: only for
    input that is known to be no later.
    """
    if delay is None:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts per user and tumbling window; late rows up to ``delay`` still count."""
    w = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def run_append(stream: DataFrame, spark: SparkSession, out: str | None = None, state: str | None = None) -> DataFrame:
    """Append all available rows to ``out``. With the same ``out`` and ``state`` a later run goes on where the last stopped."""
    out, state = out or folder(spark, "stream"), state or folder(spark, "state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions under ``root``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName()) for s in done)


def run_top(stream: DataFrame, spark: SparkSession, key: str, order: str, k: int, root: str | None = None, state: str | None = None) -> DataFrame:
    """The newest ``k`` rows by ``order`` with one row a key: each micro-batch merges into the stored set.

    A batch reads the last version before its own number and writes its own, so a repeated batch gives the same set and
    none writes what it reads. With the same ``root`` and ``state`` a later run goes on where the last stopped. Versions
    before the last two are deleted.
    """
    root, state = root or folder(spark, "top"), state or folder(spark, "state")

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = [v for v in _versions(own, root) if v < number]
        have = own.read.schema(batch.schema).parquet(f"{root}/{before[-1]}") if before else batch.limit(0)
        upsert(have, batch.dropDuplicates([key]), [key], F.col(order)).orderBy(F.desc(order), F.desc(key)).limit(k).write.mode("overwrite").parquet(f"{root}/{number}")
        for v in before[:-1]:
            old = own._jvm.org.apache.hadoop.fs.Path(f"{root}/{v}")
            old.getFileSystem(own._jsc.hadoopConfiguration()).delete(old, True)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    have = _versions(spark, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/{have[-1]}") if have else spark.createDataFrame([], stream.schema)


def run_update(stream: DataFrame, spark: SparkSession, keys: list[str], root: str | None = None, state: str | None = None) -> DataFrame:
    """The last row of each key of an aggregate in update mode: each micro-batch writes only the rows that it changed.

    Batches are folders named by their number, so a repeated batch replaces itself; reading takes the latest of each key.
    With the same ``root`` and ``state`` a later run goes on where the last stopped.
    """
    root, state = root or folder(spark, "updates"), state or folder(spark, "state")
    q = stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}"))
    q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    others = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", batch long").parquet(root)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*(F.col(f"_last.`{c}`").alias(c) if c in others else F.col(c) for c in stream.columns))
