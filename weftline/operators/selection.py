"""Exact percentiles by selection: rounds of histograms narrow the range that holds a rank, so no group holds its values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.folders import stored


def _match(left: DataFrame, right: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """A join on keys of which null is one; the right keys go."""
    right = right.select(*(F.col(c).alias(f"_r{c}") if c in names else F.col(c) for c in right.columns))
    both = [F.col(n).eqNullSafe(F.col(f"_r{n}")) for n in names] + list(more)
    return left.join(right, reduce(Column.__and__, both) if both else F.lit(True)).drop(*(f"_r{n}" for n in names))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float = 0.5, bins: int = 4096, few: int = 10_000) -> DataFrame:
    """(keys, percentile) of each group, by linear interpolation between its two nearest ranks; exact, of doubles.

    Each round counts a group's values in ``bins`` parts of its present range, with each part's least and greatest value;
    the part that holds a wanted rank is the next range. A range of one value is done; one with at most ``few`` values is
    sorted. The least and the greatest value of a range fall into different parts, so ranges always shrink; on most data
    two passes do, whatever the groups' sizes, and one hot group is spread over all tasks. Nulls and NaN don't count;
    groups without values are left out; a null key is a key, and without keys all rows are one group.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    size = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    place = (F.col("n") - 1) * F.lit(float(p))
    ranks = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))
    open_ = stored(size.select(*names, ranks.alias("wanted"), (place - F.floor(place)).alias("share"), "low", "high", F.col("n").alias("count")).withColumn("rank", F.col("wanted")))
    found: list[DataFrame] = []
    kept = [*names, "wanted", "share"]
    inside = F.col("v").between(F.col("low"), F.col("high"))
    while True:
        found.append(open_.where("low = high").select(*kept, F.col("low").alias("v")))
        some = _match(rows, open_.where(f"low < high and count <= {few}"), names, inside).groupBy(*kept, "rank").agg(F.array_sort(F.collect_list("v")).alias("all"))
        found.append(some.select(*kept, F.get("all", F.col("rank").cast("int")).alias("v")))
        wide = open_.where(f"low < high and count > {few}")
        if wide.isEmpty():
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        parts = _match(rows, wide, names, inside).groupBy(*kept, "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("count").over(Window.partitionBy(*names, "wanted").orderBy("part")) - F.col("count")
        open_ = stored(parts.withColumn("before", before).where("before <= rank and rank < before + count").select(*kept, "low", "high", "count", (F.col("rank") - F.col("before")).alias("rank")))
    both = reduce(DataFrame.unionByName, found).groupBy(*names).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("share").alias("share"))
    answer = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - F.col("share")) + F.col("high") * F.col("share"))
    return both.where("low is not null").select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), answer.alias("percentile"))
