"""Behaviour vectors of entities over a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import ratio
from weftline.operators.tables import top_per_key


def behaviour(acts: DataFrame, interactions: DataFrame, scores: DataFrame, days: int, partners: int = 5) -> DataFrame:
    """Twelve metrics per entity that acted or took part.

    ``acts(id, kind, length, reply)`` with kinds post, vote, follow, attested, received, change; ``interactions(a, b)``;
    ``scores(id, score)``. Counts come from one aggregate; interactions are counted per pair before they are ranked, and
    only the ``partners`` most frequent (then the least) are gathered, as ``partner:count``.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    n = acts.groupBy("id").agg(
        kind("post").alias("posts"), kind("vote").alias("votes"), kind("follow").alias("follows"), kind("attested").alias("given"), kind("received").alias("received"), kind("change").alias("changes"),
        F.count_if((F.col("kind") == "post") & F.col("reply")).alias("replies"), F.avg(F.when(F.col("kind") == "post", F.col("length"))).alias("length"),
    )
    either = interactions.select(F.col("a").alias("id"), F.col("b").alias("partner")).unionByName(interactions.select(F.col("b").alias("id"), F.col("a").alias("partner")))
    pairs = either.groupBy("id", "partner").agg(F.count(F.lit(1)).alias("times"))
    met = pairs.groupBy("id").agg(F.count("partner").alias("partners"))
    top = top_per_key(pairs, ["id"], [F.desc("times"), F.col("partner")], partners)
    best = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "partner", "times").alias("p")))).alias("best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_day = lambda c: F.round(zero(c) / days, 2)
    return n.join(met, "id", "full").join(best, "id", "left").join(scores, "id", "left").select(
        "id", per_day("posts").alias("posts_per_day"), per_day("votes").alias("votes_per_day"), per_day("follows").alias("follows_per_day"),
        zero("given").alias("attestations_given"), zero("received").alias("attestations_received"), F.round(F.coalesce("length", F.lit(0.0)), 1).alias("avg_post_length"),
        F.round(ratio(F.col("replies"), F.col("posts")), 4).alias("reply_ratio"), zero("partners").alias("unique_partners"),
        F.coalesce(F.array_join(F.transform("best", lambda x: x["p"]), ","), F.lit("")).alias("top_partners"), zero("changes").alias("capability_changes"),
        F.lit(0.0).alias("trust_score_delta"), F.round("score", 4).alias("trust_score"),
    )
