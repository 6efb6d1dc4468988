"""Registry records from captured responses, one record type for all registries.

A response is a JSON or HTML file that a crawl has stored; nothing here opens a network connection. ``captured`` is a
Python data source that reads the files of a folder in parallel; ``normalise`` turns responses of any registry into the
common record by native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Where each registry keeps the fields of the common record (JSON paths), fixed by the registries' formats.
FIELDS = {
    "github": {"name": "$.full_name", "description": "$.description", "stars": "$.stargazers_count", "forks": "$.forks_count"},
    "npm": {"name": "$.name", "description": "$.description", "downloads": "$.downloads"},
    "pypi": {"name": "$.info.name", "description": "$.info.summary", "downloads": "$.downloads.last_month"},
    "huggingface": {"name": "$.modelId", "likes": "$.likes", "downloads": "$.downloads"},
    "docker": {"name": "$.name", "description": "$.description", "stars": "$.star_count", "downloads": "$.pull_count"},
    "crates": {"name": "$.crate.name", "description": "$.crate.description", "downloads": "$.crate.downloads"},
    "mcp": {"name": "$.server.name", "description": "$.server.description"},
    "a2a": {"name": "$.name", "description": "$.description"},
    "smithery": {"name": "$.qualifiedName", "description": "$.description", "downloads": "$.useCount"},
    "pulsemcp": {"name": "$.name", "description": "$.short_description", "stars": "$.github_stars"},
}
COUNTS = ("stars", "forks", "likes", "downloads")


class _File(InputPartition):
    def __init__(self, registry: str, path: str):
        self.registry, self.path = registry, path


class CapturedReader(DataSourceReader):
    """Lists and opens files through pyarrow, so a folder may be in any store that all tasks reach; a bare path is a local or mounted one."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = self._store()
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        parts = sorted(f.path.removeprefix(root).strip("/").split("/") for f in files if f.is_file)
        return [_File(p[0], f"{root}/{'/'.join(p)}") for p in parts if len(p) == 2]

    def read(self, partition: _File):
        with self._store()[0].open_input_stream(partition.path) as f:
            yield partition.registry, partition.path.rpartition("/")[2], f.read().decode("utf-8")


class Captured(DataSource):
    """``spark.read.format("captured").load(folder)``: (registry, file, body) of folder/registry/file."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "registry string, file string, body string"

    def reader(self, schema) -> DataSourceReader:
        return CapturedReader(self.options)


def read_captured(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Captured)
    return spark.read.format("captured").load(folder)


def read_responses(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by Spark's own reader, for folders in any store: folder/registry/file."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    path = F.input_file_name()
    return raw.select(F.element_at(F.split(path, "/"), -2).alias("registry"), F.element_at(F.split(path, "/"), -1).alias("file"), F.col("value").alias("body"))


def meta(html: Column, name: str) -> Column:
    """The content of a page's meta element by property or name; empty where it has none."""
    return F.regexp_extract(html, rf"""(?i)<meta[^>]+(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def normalise(responses: DataFrame) -> DataFrame:
    """(registry, name, description, stars, forks, likes, downloads); profile pages give their meta data."""

    def pick(field: str) -> Column:
        out = F.lit(None).cast("string")
        for registry, paths in FIELDS.items():
            if field in paths:
                out = F.when(F.col("registry") == registry, F.get_json_object("body", paths[field])).otherwise(out)
        return out

    page = F.col("registry") == "profile"
    name = F.when(page, F.coalesce(F.nullif(meta(F.col("body"), "og:title"), F.lit("")), title(F.col("body")))).otherwise(pick("name"))
    text = F.when(page, meta(F.col("body"), "og:description")).otherwise(pick("description"))
    return responses.select("registry", name.alias("name"), text.alias("description"), *(pick(c).try_cast("long").alias(c) for c in COUNTS))


def read_surfaces(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Result files of several surfaces, each a JSON object with its rows under ``results``, as one table with a surface tag."""
    parts = []
    for surface, path in sorted(files.items()):
        rows = spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
        parts.append(rows.withColumn("surface", F.lit(surface)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
