"""A ledger of alerts kept over runs: a rule stays silent while an alert of its own is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.streaming.streams import _versions

LEDGER = "alert_id string, alert_type string, severity string, subject string, details string, opened long, resolved long"


class AlertLedger:
    """Alerts as versions of one table under ``root``, in a store that all share.

    Each change reads the last version and writes the next whole one, so a run that stops in the middle leaves the ledger
    as it was, and a repeated run, which finds its own alerts open, adds nothing. One run writes at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        have = _versions(self.spark, self.root)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/{have[-1]}") if have else self.spark.createDataFrame([], LEDGER)

    def _write(self, alerts: DataFrame) -> None:
        have = _versions(self.spark, self.root)
        alerts.write.mode("overwrite").parquet(f"{self.root}/{have[-1] + 1 if have else 0}")

    def open_types(self) -> DataFrame:
        return self.read().where("resolved is null").select("alert_type").distinct()

    def report(self, found: DataFrame, now: int) -> DataFrame:
        """Add the alerts of ``found(alert_type, severity, subject, details)`` whose type has none open; returns those added.

        Alerts of one type found together are all added. ``now`` is the run's time, in any unit that rises.
        """
        fresh = found.join(self.open_types(), "alert_type", "left_anti")
        key = F.sha2(F.concat_ws("\x00", "alert_type", F.coalesce("subject", F.lit("")), F.lit(str(now))), 256)
        added = fresh.select(key.alias("alert_id"), "alert_type", "severity", F.col("subject").cast("string").alias("subject"), "details", F.lit(now).cast("long").alias("opened"), F.lit(None).cast("long").alias("resolved"))
        self._write(self.read().unionByName(added))
        return self.read().where((F.col("opened") == now))

    def resolve(self, which: Column, now: int) -> None:
        """Close the open alerts for which a condition holds."""
        closed = F.when(F.col("resolved").isNull() & which, F.lit(now).cast("long")).otherwise(F.col("resolved"))
        self._write(self.read().withColumn("resolved", closed))


def monoculture_alerts(labels: DataFrame, label: str, threshold: float = 0.70, high: float = 0.85) -> DataFrame:
    """Alerts for each value that more than ``threshold`` of the rows have; null counts as unknown."""
    n = labels.groupBy(F.coalesce(label, F.lit("unknown")).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    hit = n.crossJoin(F.broadcast(total)).where(share > threshold)  # one row
    details = F.to_json(F.struct(F.col("subject").alias("framework"), F.col("n").alias("agent_count"), F.col("total").alias("total_agents"), F.round(share, 4).alias("share"), F.lit(threshold).alias("threshold")))
    return hit.select(F.lit("framework_monoculture").alias("alert_type"), F.when(share >= high, "high").otherwise("medium").alias("severity"), "subject", details.alias("details"))


def flood_alerts(born: DataFrame, operator: str, us: str, now: Column, most: int = 10, hours: int = 24) -> DataFrame:
    """Alerts for each operator with more than ``most`` new entities in the last hours; high from twice as many."""
    n = born.where(F.col(operator).isNotNull() & (F.col(us) >= now - hours * 3_600_000_000)).groupBy(F.col(operator).cast("string").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    details = F.to_json(F.struct(F.col("subject").alias("operator_id"), F.col("n").alias("agent_count"), F.lit(hours).alias("window_hours")))
    return n.select(F.lit("operator_flood").alias("alert_type"), F.when(F.col("n") >= 2 * most, "high").otherwise("medium").alias("severity"), "subject", details.alias("details"))
