"""A streaming source over captured firehose frames, with its own offsets.

A capture is a folder of files in the order of their names, each a frame (one JSON object) a line; only the last file still
grows, by whole lines. An offset is (file, byte): all files before it and its first bytes are read. A capture from a
stored cursor (a time in microseconds) skips what is earlier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, frame string"


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class FrameReader(DataSourceStreamReader):
    """Partitions are byte ranges of files, cut at the first line end behind ``partition_bytes``; any store that pyarrow can open."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partitionBytes", 16 << 20))
        self.first = options.get("from", "")  # name of the first file

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.base_name >= self.first)

    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"file": files[-1][0], "at": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in self._files():
            if name < start["file"] or name > end["file"]:
                continue
            begin = start["at"] if name == start["file"] else 0
            stop = end["at"] if name == end["file"] else size
            out += [Range(name, at, min(stop, at + self.partition_bytes)) for at in range(begin, stop, self.partition_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Lines that start in the range; a line that passes its end is read whole."""
        from pyarrow import fs

        if partition.start >= partition.stop:
            return
        store, path = fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        with store.open_input_file(f"{path}/{partition.path}") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(_line(f)) - 1  # the rest of the line before, if any
            else:
                f.seek(0)
            rows: list[tuple[int, str]] = []
            size = 0
            for line in _lines(f):
                if at >= partition.stop:
                    break
                rows.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                at, size = at + len(line), size + len(line)
                if size > 4 << 20:
                    yield _batch(partition.path, rows)
                    rows, size = [], 0
            if rows:
                yield _batch(partition.path, rows)

    def commit(self, end: dict) -> None:
        pass


def _lines(f, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := f.read(size):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for p in parts:
            yield p + b"\n"
    if rest:
        yield rest


def _line(f) -> bytes:
    """The bytes up to the next line end, the end included; the file then stands behind them."""
    begin, out = f.tell(), b""
    while block := f.read(4096):
        at = block.find(b"\n")
        if at >= 0:
            out += block[: at + 1]
            break
        out += block
    f.seek(begin + len(out))
    return out


def _batch(name: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["file", "at", "frame"])


class Firehose(DataSource):
    """``spark.readStream.format("firehose").load(folder)``: (file, at, frame)."""

    @classmethod
    def name(cls) -> str:
        return "firehose"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameReader(self.options)


def read_firehose(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(Firehose)
    reader = spark.readStream.format("firehose")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder)


FRAME = "kind string, did string, time_us bigint, commit struct<operation: string, collection: string, rkey: string, record: struct<text: string>>"


def posts(frames: DataFrame, collection: str = "app.bsky.feed.post", cursor: int | None = None) -> DataFrame:
    """(uri, did, rkey, text, time_us) of the frames that create a post with a text; other and malformed frames are left out.

    With ``cursor`` only posts from that time on.
    """
    e = F.from_json("frame", FRAME)
    own = frames.select(e.alias("e")).where((F.col("e.kind") == "commit") & (F.col("e.commit.operation") == "create") & (F.col("e.commit.collection") == collection))
    own = own.where((F.coalesce("e.commit.record.text", F.lit("")) != "") & (F.coalesce("e.did", F.lit("")) != "") & (F.coalesce("e.commit.rkey", F.lit("")) != ""))
    uri = F.concat(F.lit("at://"), "e.did", F.lit(f"/{collection}/"), "e.commit.rkey")
    out = own.select(uri.alias("uri"), "e.did", "e.commit.rkey", F.col("e.commit.record.text").alias("text"), "e.time_us")
    return out if cursor is None else out.where(F.col("time_us") >= cursor)


def has_keyword(text: Column, words: list[str]) -> Column:
    """True where any of the words or phrases occurs, whatever the case."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def write_capture(frames: DataFrame, folder: str, order: str) -> None:
    """Store rows of one JSON text column ``frame`` as a capture, files in the order of ``order``."""
    ranged = frames.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select("frame").write.mode("overwrite").text(folder)
