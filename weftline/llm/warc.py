"""WARC archives: a deterministic sharded writer with manifest commit, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import new_path, stash

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
MOST_SHARDS = 65536
MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _header_value(value: str) -> str:
    """A value as one header line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest.hex()}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response, or a revisit of ``refers_to`` that leaves the payload out."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = f"software: weftline\r\nformat: {VERSION}\r\n".encode()
    head = [VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}"]
    head += [f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """One gzip member; its header has no time, so equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    """Files of one shard under temporary names; a new one begins when the compressed size is reached."""

    def __init__(self, root: str, attempt: str, shard: int, most: int, date: str):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.attempt, self.shard, self.most, self.date, self.number, self.out = attempt, shard, most, date, 0, None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}/{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary/{self.attempt}", recursive=True)
            self.out, self.hash, self.bytes, self.records = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None), hashlib.sha256(), 0, 0
            self._put(_info(self.name, self.date))
        self._put(data)
        self.records += 1
        return self.close() if self.bytes >= self.most else None

    def _put(self, data: bytes) -> None:
        member = _member(data)
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.number = None, self.number + 1
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()}


def _shards(rows: DataFrame, shard_bytes: int) -> tuple[Callable[..., F.Column], int]:
    """The shard of an id and a digest, and the number of shards, for rows (page_id, bytes).

    With the ids in order and S the bytes of a shard, shard k begins with the id at byte k S of all. That is exact
    whatever the ids and the tasks. An id that more than one shard begins with is dealt among these by digest, and rows
    without an id are dealt by digest to shards before all others.
    """
    total, nulls = rows.agg(F.sum("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes")))).first()
    size = max(shard_bytes, -(-(total or 0) // MOST_SHARDS))
    ahead = -(-(nulls or 0) // size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = np.cumsum(batch.column(1).to_numpy()) + before
            start = np.append(before, sums[:-1])[: len(sums)]
            before = sums[-1] if len(sums) else before
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(sums), pa.array(np.full(len(sums), part, np.int32))], ["page_id", "start", "stop", "part"])

    by_id = rows.where("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    ranged = by_id.repartitionByRange(F.col("page_id")).sortWithinPartitions("page_id")
    ranged = stash(ranged.mapInArrow(add, "page_id long, start long, stop long, part int"), "places")
    sums = sorted(ranged.groupBy("part").agg(F.max("stop")).collect())
    offset = F.element_at(F.create_map(*[F.lit(x) for (part, _), o in zip(sums, np.cumsum([0, *(n for _, n in sums)]).tolist()) for x in (part, o)]), F.col("part")) if sums else F.lit(0)
    start, stop = F.col("start") + offset, F.col("stop") + offset
    begins = ranged.select("page_id", F.ceil(start / size).alias("low"), (F.ceil(stop / size) - 1).alias("high"))
    firsts = begins.where("low <= high").select("page_id", F.explode(F.sequence("low", "high")).alias("shard"))
    bounds = np.array(sorted(r.page_id for r in firsts.collect()), np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def shard(page_id: pa.Array, chance: pa.Array) -> pa.Array:
        own, bounds, chance = page_id.fill_null(0).to_numpy(zero_copy_only=False), shared.value, chance.to_numpy()
        high = np.maximum(np.searchsorted(bounds, own, "right"), 1)
        several = np.maximum(high - np.searchsorted(bounds, own, "left"), 1)
        at = np.where(page_id.is_null().to_numpy(zero_copy_only=False), chance % max(ahead, 1), ahead + high - 1 - chance % several)
        return pa.array(at, pa.int32())

    return lambda page_id, digest: shard(page_id, F.pmod(F.xxhash64(digest), F.lit(1 << 30))), max(1, ahead + len(bounds))


def write_warc(pages: DataFrame, root: str, shard_bytes: int = 8 << 20, roll_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages(page_id, url, html)`` under ``root`` and commit; returns the manifest.

    The payload is the html in UTF-8, empty for null. Of the rows with equal payloads, those with the largest
    page_id are responses (all of them, where repeated rows share it), the others revisit it; a row without a
    page_id ranks below all, and without any id in its group all rows are responses. Records are dealt to shards
    by ranges of page_id with about ``shard_bytes`` of payload, more where that would be over 65,536 shards. The ranges
    are cut where the running sum of bytes over the sorted ids passes a multiple, whatever the ids, so any long is an
    id and outliers need no care; rows without an id, and repeated rows of an id larger than a shard, are dealt by
    digest. A shard is sorted by page_id (null first), so the files depend on the rows alone. A file is closed when its compressed size
    reaches ``roll_bytes``. Tasks write under temporary names; only files that the stored manifest names are moved
    to their final names, then the manifest is moved into place: a reader sees all of the archive or none of it.
    Other columns are not read. An empty table gives a manifest without files.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    narrow = pages.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stash(groups.where("n > 1 and first is not null").select("digest", "first"), "payloads")
    revisits = narrow.join(groups, "digest").where("not page_id <=> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    shard, count = _shards(narrow.select("page_id", (F.col("bytes") + 512).alias("bytes")), shard_bytes)
    facts = revisits.select("page_id", F.lit(0).alias("kind"), "refers_to", F.base64("digest").alias("url"), F.lit("").alias("html"))
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionByName(facts)
    digest = F.when(F.col("kind") == 0, F.unbase64("url")).otherwise(F.unhex(F.sha1("html")))
    rows = rows.select(shard(F.col("page_id"), digest).alias("shard"), "page_id", "kind", "refers_to", "url", "html")
    rows = rows.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roll, known, done = uuid.uuid4().hex, None, (None, {}), []
        for batch in batches:
            for r in batch.to_pylist():
                if roll is None or roll.shard != r["shard"]:
                    done.append(roll and roll.close())
                    roll, known = _Roll(root, attempt, r["shard"], roll_bytes, date), (None, {})
                if known[0] != r["page_id"]:
                    known = (r["page_id"], {})
                if r["kind"] == 0:
                    known[1][base64.b64decode(r["url"])] = r["refers_to"]
                    continue
                payload = r["html"].encode()
                other = known[1].get(hashlib.sha1(payload).digest()) if known[1] else None
                done.append(roll.add(record(r["page_id"], r["url"], payload, other, date)))
        done.append(roll and roll.close())
        yield pa.RecordBatch.from_pylist([x for x in done if x], pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    written = stash(rows.mapInArrow(write, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, base = fs.FileSystem.from_uri(root)
            for r in batch.to_pylist():
                final = f"{base}/{r['name']}"
                if files.get_file_info(final).type == fs.FileType.NotFound:  # else a lost attempt has moved it
                    files.move(f"{base}/{r['temporary']}", final)
            yield batch

    moved = stash(written.mapInArrow(commit, MANIFEST).drop("temporary"), "manifest")
    moved.write.json(f"{root}/_manifest.tmp")
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.rename(jvm.Path(f"{root}/_manifest.tmp"), jvm.Path(f"{root}/_manifest"))
    files.delete(jvm.Path(f"{root}/_temporary"), True)
    return moved


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip stream with one member a record."""
    raw = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            raw = raw or stream.read(size)
            if not raw:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(z.decompress(raw))
            raw = z.unused_data
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        headers = dict((k.lower(), v) for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:]))
        yield headers, rest[: int(headers["content-length"])]


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """Records of a committed archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Digests are computed again from the bytes read and compared with the headers; a revisit's size and digest are
    those of the full payload, and its ``payload`` is null. Files are read as streams, one after another in a task.
    """
    names = spark.read.schema(MANIFEST).json(f"{root}/_manifest").select("name")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, base = fs.FileSystem.from_uri(root)
                rows, held = [], 0
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if _base32(hashlib.sha1(block).digest()) != head["warc-block-digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a block does not match its digest")
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        if kind == "response" and (len(payload) != size or _base32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        ids = [int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], size, digest, kind, ids[1], head.get("warc-target-uri"), payload if kind == "response" else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    count = max(1, min(MOST_SHARDS, names.count()))
    return names.repartition(count, "name").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read its records' facts back."""
    root = new_path(pages.sparkSession, "warc")
    write_warc(pages, root)
    return read_warc(pages.sparkSession, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
