"""Operators over whole tables: snapshots, upserts, latest rows, streaks, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.folders import stored


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should be total."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Rows of both tables by key; on conflict the row with the greatest version, the new table's at ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [version.desc_nulls_last(), F.desc("_new")]).drop("_new")


def upsert_counting(old: DataFrame, new: DataFrame, keys: list[str], counter: str, version: str) -> DataFrame:
    """Upsert in which conflicts add up ``counter``; all other columns come from the latest version."""
    others = [c for c in old.columns if c not in (*keys, counter)]
    both = old.unionByName(new)
    kept = F.max_by(F.struct(*others), F.struct(version, *[o for o in others if o != version]))
    return both.groupBy(*keys).agg(F.sum(counter).alias(counter), kept.alias("_kept")).select(*keys, counter, "_kept.*").select(old.columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def prune(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def streaks(df: DataFrame, key: str, day: str) -> DataFrame:
    """Longest and last run of consecutive days per key."""
    days = df.select(key, F.col(day).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"), F.max("day").alias("last"))
    return runs.groupBy(key).agg(F.max("length").alias("longest"), F.max_by("length", "last").alias("current"), F.max("last").alias("last_day"))


def shares(df: DataFrame, by: Column | str, name: str = "label") -> DataFrame:
    """Counts per label and each one's share of all rows: one aggregate, then a one-row total."""
    counts = df.groupBy((F.col(by) if isinstance(by, str) else by).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(name, "n", (F.col("n") / F.col("total")).alias("share"))


def outliers(df: DataFrame, value: str, least: float) -> DataFrame:
    """Rows whose population z-score exceeds ``least``; none where all values are equal. The statistics are one row."""
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).withColumn("z", z).drop("mean", "sd").where(F.abs("z") > least)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)


def maximal_sets(members: DataFrame) -> DataFrame:
    """Sets of ``members(id, item)`` that are part of no other set, with their size n; of equal sets the least id.

    Equal sets become one by their size and two sums of item hashes. A set can only lie inside larger sets that have its
    rarest item and all of its 256 hashed bits: pairs without these never leave the join. A set is first compared with the
    largest that passes, then, where that one does not hold it, with all that do; the items that both have are counted,
    so no set travels as a whole. An item that many sets have is dealt over joins of some 4,096 sets.
    """
    m = members.select("id", "item").distinct()
    sums = [F.sum(F.xxhash64("item", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    bit = F.pmod(F.xxhash64("item"), F.lit(256))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    marks = [f"s{k}" for k in range(4)]
    own = m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *sums, *(F.bit_or(F.when(F.floor(bit / 64) == k, one).otherwise(F.lit(0).cast("long"))).alias(s) for k, s in enumerate(marks)))
    first = own.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), *(F.min(s).alias(s) for s in marks)).drop("h1", "h2")
    m = m.join(first, "id")
    m = stored(m.join(m.groupBy("item").agg(F.count(F.lit(1)).alias("crowd")), "item"), "members")
    rarest = m.groupBy("id", "n", *marks).agg(F.min(F.struct("crowd", "item")).alias("r")).select("id", "n", *marks, "r.item", F.explode(F.sequence(F.lit(0), F.floor((F.col("r.crowd") - 1) / 4096).cast("int"))).alias("part"))
    large = m.select(F.col("id").alias("other"), F.col("n").alias("m"), "item", *(F.col(s).alias(f"o{s}") for s in marks), F.pmod(F.xxhash64("id"), F.floor((F.col("crowd") - 1) / 4096) + 1).cast("int").alias("part"))
    fits = F.col("m") > F.col("n")
    for s in marks:
        fits = fits & (F.col(s).bitwiseAND(F.bitwise_not(F.col(f"o{s}"))) == 0)
    pairs = lambda small: small.join(large, ["item", "part"]).where(fits).select("id", "n", "m", "other")

    def inside(some: DataFrame) -> DataFrame:
        both = some.join(m.select("id", "item"), "id").join(m.select(F.col("id").alias("other"), "item"), ["other", "item"])
        return both.groupBy("id", "other", "n").agg(F.count(F.lit(1)).alias("common")).where("common = n").select("id").distinct()

    best = stored(pairs(rarest).groupBy("id", "n").agg(F.max_by("other", F.struct("m", "other")).alias("other")), "largest")
    held = stored(inside(best), "held")
    open_ = best.select("id").join(held, "id", "left_anti")
    more = inside(pairs(rarest.join(open_, "id", "left_semi")))
    return m.select("id", "n").distinct().join(held.unionByName(more), "id", "left_anti")


def window_counts(df: DataFrame, key: str, seconds: str, width: int) -> DataFrame:
    """For each row, the rows of its key in the last ``width`` seconds, itself included."""
    w = W.partitionBy(key).orderBy(seconds).rangeBetween(-width, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def band_counts(df: DataFrame, id_col: str, time: str, width: int) -> DataFrame:
    """For each row, the other rows at most ``width`` away in ``time``.

    Each row is compared within its own and the two adjacent buckets of that width; whole buckets are counted only
    after counts per distinct time, so rows at one time do not multiply.
    """
    at = df.groupBy(time).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col(time) / width))
    near = at.select(F.col(time).alias("other"), F.col("n").alias("m"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    pairs = at.join(near, "bucket").where(F.abs(F.col(time) - F.col("other")) <= width)
    counts = pairs.groupBy(time).agg((F.sum("m") - 1).alias("nearby"))
    return df.select(id_col, time).join(counts, time).select(id_col, "nearby")
