"""Anomaly, collusion and population detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.folders import stored


def severity_of(z: Column) -> Column:
    return F.when(F.abs(z) >= 4, "high").when(F.abs(z) >= 3, "medium").otherwise("low")


def mutual_pairs(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Pairs with edges in both directions: one aggregate on the normalised pair."""
    pair = edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), (F.col(src) < F.col(dst)).alias("up"))
    return pair.groupBy("a", "b").agg(F.count_if("up").alias("forth"), F.count_if(~F.col("up")).alias("back")).where("forth > 0 and back > 0")


def reciprocity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Per vertex that edges reach: distinct sources, and those of them that it reaches itself.

    One aggregate on the normalised pair tells both directions; there is no self join.
    """
    pair = edges.where(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    both = pair.agg(F.bool_or(F.col(src) < F.col(dst)).alias("up"), F.bool_or(F.col(src) > F.col(dst)).alias("down"))
    ends = both.select(F.explode(F.array(F.when(F.col("up"), F.struct(F.col("b").alias("id"), F.col("down").alias("back"))), F.when(F.col("down"), F.struct(F.col("a").alias("id"), F.col("up").alias("back"))))).alias("e")).where("e is not null")
    return ends.groupBy("e.id").agg(F.count(F.lit(1)).alias("attesters"), F.count_if("e.back").alias("back"))


def voting_pairs(votes: DataFrame, overlap: float = 0.8, least: int = 5) -> DataFrame:
    """Voters whose sets of posts overlap by at least ``overlap`` of both sizes.

    Of each voter, only the rarest posts can be needed: two sets that overlap by the share t have at least k posts in
    common among the n - ceil(t n) + k rarest of each. These are counted for each pair of voters, and only pairs with so
    many are compared whole; with k a fiftieth of the set, and two more, chance meetings go before any set travels.
    ``votes(voter, post)``. Posts are ranked by their number of voters, then id; ``least`` is the smallest set that counts.
    """
    v = votes.select("voter", "post").distinct().withColumn("crowd", F.count(F.lit(1)).over(W.partitionBy("post")))
    sets = v.groupBy("voter").agg(F.array_sort(F.collect_list(F.struct("crowd", "post"))).alias("posts"))
    sets = sets.select("voter", F.size("posts").cast("long").alias("n"), F.transform("posts", lambda p: p["post"]).alias("posts")).where(F.col("n") >= least)
    sets = stored(sets, "sets")
    same = F.ceil(overlap * F.col("n"))
    k = F.least(same, F.floor(F.col("n") / 50) + 2).cast("int")
    keys = sets.select("voter", "n", k.alias("k"), F.explode(F.slice("posts", F.lit(1), (F.col("n") - same).cast("int") + k)).alias("post"))
    other = keys.select(F.col("voter").alias("other"), F.col("n").alias("m"), F.col("k").alias("l"), "post")
    met = keys.join(other, "post").where((F.col("voter") < F.col("other")) & (F.least("n", "m") >= overlap * F.greatest("n", "m")))
    pairs = met.groupBy("voter", "other").agg(F.count(F.lit(1)).alias("met"), F.first(F.least("k", "l")).alias("k")).where("met >= k").select("voter", "other")
    both = pairs.join(sets, "voter").join(sets.select(F.col("voter").alias("other"), F.col("n").alias("m"), F.col("posts").alias("theirs")), "other")
    common = F.size(F.array_intersect("posts", "theirs"))
    return both.select("voter", "other", common.cast("long").alias("common"), "n", "m").where((F.col("common") >= overlap * F.col("n")) & (F.col("common") >= overlap * F.col("m")))


def voting_rings(votes: DataFrame, now: Column, days: int = 30, overlap: float = 0.8, least: int = 5) -> DataFrame:
    """Pairs of entities that give most of their upvotes to each other, with the ring that each pair belongs to.

    ``votes(voter, author, direction, us)``: upvotes of the last ``days`` on posts of others. A pair (a, b) is one where
    each gives the other at least ``least`` votes and the share ``overlap`` of its own. Rings are connected pairs, named by
    the least member; severity is high from three members. One aggregate counts a voter's votes for each author, one more
    the normalised pair: there is no self join, and a popular author is a count like any other.
    """
    from weftline.operators.graph import components

    up = votes.where((F.col("direction") == "up") & (F.col("us") >= now - days * 86_400_000_000) & (F.col("voter") != F.col("author")))
    n = up.groupBy("voter", "author").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("voter").agg(F.sum("n").alias("total"))
    strong = n.where(F.col("n") >= least).join(total, "voter").where(F.col("n") >= overlap * F.col("total"))
    forth = F.col("voter") < F.col("author")
    pair = strong.groupBy(F.least("voter", "author").alias("a"), F.greatest("voter", "author").alias("b")).agg(
        F.max(F.when(forth, F.col("n"))).alias("forth"), F.max(F.when(~forth, F.col("n"))).alias("back"), F.max(F.when(forth, F.col("total"))).alias("total_a"), F.max(F.when(~forth, F.col("total"))).alias("total_b"),
    )
    pair = pair.where("forth is not null and back is not null")
    ring = components(pair.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "ring")
    sizes = ring.groupBy("ring").agg(F.count(F.lit(1)).alias("members"))
    out = pair.join(ring.select(F.col("id").alias("a"), "ring"), "a").join(sizes, "ring")
    share = lambda x, t: F.round(F.col(x) / F.col(t), 4)
    return out.select("ring", "members", F.when(F.col("members") >= 3, "high").otherwise("medium").alias("severity"), "a", "b", "forth", "back", share("forth", "total_a").alias("overlap_a"), share("back", "total_b").alias("overlap_b"))


def sybil_score(nearby: Column, similar: Column, active: Column, verified: Column) -> Column:
    """Risk from creation bursts, similar names, inactivity and an unverified address, at most 1."""
    risk = F.when(nearby >= 3, 0.35).when(nearby >= 1, 0.15).otherwise(0.0) + F.when(similar >= 2, 0.3).when(similar >= 1, 0.1).otherwise(0.0)
    risk = risk + F.when(active, 0.0).otherwise(0.15) + F.when(verified, 0.0).otherwise(0.1)
    return F.least(risk, F.lit(1.0))


def gateway(tier_rank: Column, minimum: Column, categories: Column, age: Column, most_age: Column) -> Column:
    """Allow where the tier reaches the minimum, no category scores below 40, and the scan is fresh enough."""
    lowest = F.array_min(F.map_values(categories))
    return F.when(tier_rank < minimum, "tier").when(lowest < 40, "category").when(age > most_age, "stale").otherwise("allow")
