"""Writers: snapshots with history, exports, nested subject data, deliveries with retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_history(snapshot: DataFrame, path: str, as_of: str) -> None:
    """Append a snapshot as one partition of its date; writing the same date again replaces it."""
    snapshot.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Rows as CSV with a header or as JSON lines; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = {f.name for f in df.schema if f.dataType.typeName() in ("struct", "map", "array")}
        df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.option("header", True).csv(path)
    elif kind == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def subject_data(key: str, tables: dict[str, DataFrame], subject: object) -> DataFrame:
    """All rows of one subject as one row: a JSON array per table, in order of the rows' text."""
    out = None
    for name, df in sorted(tables.items()):
        rows = df.where(F.col(key) == F.lit(subject)).agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), ",").alias("_"))
        rows = rows.select(F.concat(F.lit("["), "_", F.lit("]")).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # single rows
    return out


def backoff_seconds(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Delay before a retry: doubled each time, up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def delivery_health(log: DataFrame, failures: int = 10) -> DataFrame:
    """Per subscription of ``log(subscription, attempt_at, ok)``: attempts, share that succeeded, failures since the last success, active."""
    last_ok = log.where("ok").groupBy("subscription").agg(F.max("attempt_at").alias("last_ok"))
    j = log.join(last_ok, "subscription", "left")
    n = j.groupBy("subscription").agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col("ok").cast("double")).alias("success"), F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("attempt_at") > F.col("last_ok")))).alias("failing"))
    return n.withColumn("active", F.col("failing") < failures)


def append_bounded(old: Column, new: Column, most: int = 1000) -> Column:
    """The last ``most`` entries of two arrays in order."""
    both = F.concat(F.coalesce(old, F.array().cast("array<string>")), new)
    return F.slice(both, F.greatest(F.size(both) - (most - 1), F.lit(1)), F.lit(most))


def import_content(new: DataFrame, known: DataFrame, id_col: str, text_col: str, most: int = 10000) -> tuple[DataFrame, DataFrame]:
    """New content, trimmed and cut to the stored length, once per id; and a row of counts (imported, skipped)."""
    fresh = new.dropDuplicates([id_col]).join(known.select(id_col), id_col, "left_anti")
    fresh = fresh.withColumn(text_col, F.substring(F.trim(text_col), 1, most)).where(F.col(text_col) != "")
    counts = fresh.agg(F.count(F.lit(1)).alias("imported")).crossJoin(new.agg(F.count(F.lit(1)).alias("all")))
    return fresh, counts.select("imported", (F.col("all") - F.col("imported")).alias("skipped"))
