"""The social model over the driver's tables: entities, follows, votes, attestations, transactions.

Customers are entities (market segment: framework; nation: operator). Events are edges and facts of the user who
caused them: a click follows entity k, a view votes on post k, a signup attests entity k, a purchase buys listing k,
an error flags post k. SQL holds the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import load

SQL = """
WITH ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value, (props->>'k')::BIGINT AS k FROM events),
clock AS (SELECT max(us) AS now FROM ev),
entities AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS framework, c_nationkey AS operator, c_acctbal AS balance,
  CASE c_custkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'verified' ELSE 'public' END AS tier FROM customer),
follows AS (SELECT DISTINCT user_id AS src, k AS dst FROM ev WHERE event_type = 'click' AND user_id <> k),
votes AS (SELECT event_id, user_id AS voter, k AS post, CASE WHEN event_id % 4 = 0 THEN 'down' ELSE 'up' END AS direction, us FROM ev WHERE event_type = 'view'),
attestations AS (SELECT event_id, user_id AS attester, k AS target, CASE event_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'data' ELSE 'ops' END AS context,
  least(value / 100, 1.0) AS weight, us FROM ev WHERE event_type = 'signup' AND user_id <> k),
flags AS (SELECT event_id, user_id AS reporter, k AS post, us FROM ev WHERE event_type = 'error')
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the time in microseconds and the key of the JSON properties."""
    e = load(spark, d, "events")
    return e.select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def now(spark: SparkSession, d: str) -> DataFrame:
    """The as-of time: one row with the latest event's time."""
    return events(spark, d).agg(F.max("us").alias("now"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("c_custkey") % 4 == 0, "private").when(F.col("c_custkey") % 4 == 1, "verified").otherwise("public")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("framework"), F.col("c_nationkey").alias("operator"), F.col("c_acctbal").alias("balance"), tier.alias("tier"))


def follows(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'click' and user_id <> k").select(F.col("user_id").alias("src"), F.col("k").alias("dst")).distinct()


def votes(spark: SparkSession, d: str) -> DataFrame:
    direction = F.when(F.col("event_id") % 4 == 0, "down").otherwise("up")
    return events(spark, d).where("event_type = 'view'").select("event_id", F.col("user_id").alias("voter"), F.col("k").alias("post"), direction.alias("direction"), "us")


def attestations(spark: SparkSession, d: str) -> DataFrame:
    context = F.when(F.col("event_id") % 3 == 0, "code").when(F.col("event_id") % 3 == 1, "data").otherwise("ops")
    return events(spark, d).where("event_type = 'signup' and user_id <> k").select("event_id", F.col("user_id").alias("attester"), F.col("k").alias("target"), context.alias("context"), F.least(F.col("value") / 100, F.lit(1.0)).alias("weight"), "us")


def flags(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'error'").select("event_id", F.col("user_id").alias("reporter"), F.col("k").alias("post"), "us")
