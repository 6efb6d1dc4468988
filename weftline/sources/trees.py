"""Files of source trees: which are worth scanning, and a tree's main language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders and endings that are not scanned, endings that are, and names without an ending that are.
SKIP_FOLDERS = ("node_modules", ".git", "__pycache__", "dist", "build", "vendor", ".venv", "venv", "env", ".env", "target", "coverage", ".next", ".nuxt")
SKIP_ENDINGS = """png jpg jpeg gif ico svg webp woff woff2 ttf eot pdf zip tar gz bz2 pyc pyo class o so dll exe lock sum""".split()
ENDINGS = """py js ts jsx tsx mjs cjs go rs rb java kt cs sh bash zsh yaml yml toml json env cfg ini conf php pl pm lua r scala groovy swift m ps1 bat cmd
vbs html htm xml svg ipynb""".split()
NAMES = ("Dockerfile", "Makefile", "Rakefile", "Gemfile", "Vagrantfile", "Procfile", "Brewfile", "Jenkinsfile", "Snakefile")
#: The same as patterns of a path: what is skipped, and what of the rest is a source file.
SKIPPED = rf"(^|/)({'|'.join(f.replace('.', '[.]') for f in SKIP_FOLDERS)})(/|$)|(?i:[.]min[.][^/]*$)|[^/][.](?i:{'|'.join(SKIP_ENDINGS)})$"
SOURCE = rf"[^/][.](?i:{'|'.join(ENDINGS)})$|(^|/)({'|'.join(NAMES)})$"
#: Languages by file ending.
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".sh": "Shell"}


def is_source(path: Column) -> Column:
    """Outside skipped folders, not minified, with an ending or a name of a source file."""
    return ~path.rlike(SKIPPED) & path.rlike(SOURCE)


def source_files(files: DataFrame, tree: str, most_bytes: int = 500_000, most_files: int = 200) -> DataFrame:
    """Source files of ``files(path, bytes)`` up to a size, the first of each ``tree`` by path; the limits are the scan's own."""
    own = files.where((F.col("bytes") <= most_bytes) & is_source(F.col("path")))
    return own.withColumn("_place", F.row_number().over(W.partitionBy(tree).orderBy("path"))).where(F.col("_place") <= most_files).drop("_place")


def coverage(files: DataFrame, tree: str, most_bytes: int = 500_000, most_files: int = 200) -> DataFrame:
    """For each tree: its source files, how many of them a scan reads, and whether that is only a sample."""
    own = files.groupBy(tree).agg(F.count_if(is_source(F.col("path"))).alias("scannable"), F.count_if(is_source(F.col("path")) & (F.col("bytes") <= most_bytes)).alias("fitting"))
    return own.select(tree, "scannable", F.least("fitting", F.lit(most_files)).cast("long").alias("scanned"), (F.col("scannable") > most_files).alias("truncated"))


def languages(files: DataFrame, tree: str) -> DataFrame:
    """The language with the most files of each tree, the last by name at ties; trees without any are left out."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    n = files.select(tree, names[F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1))].alias("language")).where("language is not null")
    n = n.groupBy(tree, "language").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(tree).agg(F.max_by("language", F.struct("n", "language")).alias("language"))
