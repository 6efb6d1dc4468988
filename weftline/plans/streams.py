"""Streams over the event table, each with the batch SQL of the same meaning."""

from pyspark.sql import functions as F

from weftline.plans.registry import load, query
from weftline.streaming import streams as st


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND regexp_matches(props, ': [1-3]\\d?}')")
def stream_filter(spark, d):
    """A keyword filter over the event stream."""
    e = st.read_events(spark, f"{d}/events.parquet")
    return st.run_append(st.keyword_stream(e, ["click", "view"], r": [1-3]\d?\}").select("event_id", "user_id", "event_type"), spark)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 200")
def stream_topk(spark, d):
    """The newest 200 purchases, held as a bounded set."""
    e = st.read_events(spark, f"{d}/events.parquet").where("event_type = 'purchase'").select("event_id", "user_id", "event_type")
    return st.run_top(e, spark, "event_id", "event_id", 200)


@query("SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H') AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_rate(spark, d):
    """Counts per user and six hours: each batch writes the windows that it changed."""
    e = st.read_events(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = e.groupBy(F.window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "user_id", "n")
    return st.run_update(counts, spark, ["start", "user_id"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def stream_once(spark, d):
    """Events once each, in whatever order their files come."""
    e = st.read_events(spark, f"{d}/events.parquet").where("event_type = 'error'")
    return st.run_append(st.once(e, "event_id").select("event_id", "user_id"), spark)


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events), w AS (SELECT user_id, s // 30 * 30 AS start FROM e UNION ALL SELECT user_id, s // 30 * 30 - 30 FROM e)
SELECT user_id, start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1
""")
def stream_sliding(spark, d):
    """Users with more than one event in a sliding minute that moves by half a minute."""
    e = st.read_events(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = e.groupBy(F.window("ts", "60 seconds", "30 seconds"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("window.start").alias("start"), "n").where("n > 1")
    return st.run_update(counts, spark, ["start", "user_id"])


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL")
def stream_matched_subscriptions(spark, d):
    """Events joined with a static table of subscriptions by their kind, counted per subscriber."""
    subs = spark.createDataFrame([("audit", ["signup", "error"])], "name string, kinds array<string>")
    e = st.read_events(spark, f"{d}/events.parquet").join(F.broadcast(subs), F.array_contains("kinds", F.col("event_type"))).select("event_id", "user_id", "event_type")
    return st.run_append(e, spark).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
