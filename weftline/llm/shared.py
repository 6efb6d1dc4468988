"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where a local session names none (tests), a temporary one.

    On a cluster executors would each write to their own disk, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs start from files, not from lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    root = shared_dir(df.sparkSession)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not folder.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            continue
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def with_row(docs: DataFrame, text_col: str) -> DataFrame:
    """``text`` beside all other columns in a struct ``row``, whose names cannot clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others or [F.lit(None).cast("int").alias("_")]).alias("row"), F.col(text_col).alias("text"))


def row_type(carried: DataFrame) -> str:
    return carried.schema["row"].dataType.simpleString()


def unpacked(docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of ``docs`` again from ``row`` and ``text``."""
    return [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def held_out(id_col: str) -> Column:
    """True for the fold that is kept out of learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def hash_sample(df: DataFrame, by: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, one for each value of ``by``: the values with the least hash, whatever the order and partitions.

    Rows that share a value count once, with the least of their other columns. The hashes of distinct values are even,
    so a bound on them leaves about twice the limit to sort, however often a value is repeated.
    """
    others = [c for c in df.columns if c != by]
    one = df.groupBy(by).agg(F.min(F.struct(*others)).alias("_least")) if others else df.distinct()
    one = one.select(by, *(F.col(f"_least.`{c}`").alias(c) for c in others))
    total = one.count()
    hashed = F.shiftrightunsigned(F.xxhash64(by), 1)
    if total > 4 * limit:
        one = one.where(hashed < int(2**63 * (2 * limit + 200) / total))
    return one.orderBy(hashed, by).limit(limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """(id, label, text) of at most ``limit`` labelled ids, stored: those with the least hash, one row each.

    Of several labels or texts of an id the least counts, so neither repeated labels nor copies of a document can widen
    what is learned from. Null ids and labels take no part; a null text is an empty one.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    chosen = hash_sample(chosen, "id", limit)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stash(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")
