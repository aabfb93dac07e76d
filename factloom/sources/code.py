"""Source trees as tables: files, manifests and what changed between two of them, text around places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.index_facts import extract_records
from ..plans.catalogue import built_in
from ..plans.index import Index
from ..plans.repo import Repo
from .cache import FactCache
from .facts import schema_fingerprint

#: Folders that hold no source of the project.
PRUNED = (".git", ".hg", ".tox", ".venv", "venv", "env", "__pycache__", "node_modules", "build", "dist", "site-packages", ".mypy_cache", ".pytest_cache")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """``file`` (relative to the root), ``source``, ``modified``, ``size``: one row per Python file, read by Spark.

    Empty files hold no facts and are left out, as Spark reads no row of them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getRawPath().rstrip("/")
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.py")
    file = F.expr(f"substring(parse_url(_metadata.file_path, 'PATH'), {len(base) + 2})")
    kept = rows.select(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))).alias("file"), F.col("value").alias("source"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"))
    pruned = "|".join(p.replace(".", r"\.") for p in PRUNED)
    return kept.where(~F.col("file").rlike(rf"(^|/)({pruned})/"))


def open_repo(spark: SparkSession, root: str, dimension: DataFrame | None = None) -> Repo:
    """The repository under a path, with the built-in patterns and the user's."""
    return _repo(Index.of_sources(read_sources(spark, root)), dimension)


def open_artifacts(spark: SparkSession, folder: str, dimension: DataFrame | None = None) -> Repo:
    """The repository whose fact families were written to a folder; the same queries, without its source."""
    return _repo(Index.of_artifacts(spark, folder), dimension)


def open_cached(spark: SparkSession, root: str, cache: str, dimension: DataFrame | None = None) -> Repo:
    """The repository under a path, extracted unless the cache has its content under the present schemas already."""
    sources = read_sources(spark, root)
    store = FactCache(spark, cache)
    key = f"{content_hash(sources)}-{schema_fingerprint()}"
    return _repo(store.get(key) or store.put(key, extract_records(sources)), dimension)


def _repo(index: Index, dimension: DataFrame | None) -> Repo:
    known = built_in(index.spark)
    return Repo(index.flat(), known if dimension is None else known.unionByName(dimension))


def manifest(sources: DataFrame) -> DataFrame:
    """``file``, ``size``, ``digest`` of each file."""
    return sources.select("file", "size", F.sha2("source", 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file``, ``change`` (added, removed, changed) between two manifests."""
    both = before.select("file", F.col("digest").alias("b")).join(after.select("file", F.col("digest").alias("a")), "file", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("file", change.alias("change")).where("change IS NOT NULL")


def content_hash(sources: DataFrame) -> str:
    """One digest of all files, whatever their order: per-file digests add up, 128 bits in two halves."""
    d = F.sha2(F.concat_ws("\0", "file", F.coalesce("source", F.lit(""))), 256)
    half = lambda at: F.sum(F.conv(F.substring(d, at, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = sources.agg(F.count(F.lit(1)), half(1), half(16)).first()
    return f"{n:x}-{int(a or 0):x}-{int(b or 0):x}"


def affected(changed: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Files to extract again: those changed and those that import a changed module, at any distance.

    imports: ``file``, ``module``; modules: ``file``, ``module`` (of its own). A dotted prefix of an import counts, so that
    names imported from a package concern it.
    """
    from ..functions.scalars import dotted_prefixes
    from ..operators.graph import closure

    named = imports.select("file", F.explode(dotted_prefixes(F.col("module"))).alias("module")).distinct()
    uses = named.withColumnRenamed("file", "dst").join(modules.withColumnRenamed("file", "src"), "module").select("src", "dst")
    return closure(uses, changed.select("file"), 1000, include_root=True).select(F.col("node").alias("file")).distinct()


def text_around(places: DataFrame, sources: DataFrame, context: int = 2) -> DataFrame:
    """Places (``file``, ``line``) with ``text``: the line and so many around it, numbered."""
    lines = F.split("source", "\n")
    span = F.sequence(F.greatest(F.lit(1), F.col("line") - context), F.least(F.size(lines), F.col("line") + context))
    numbered = F.transform(span, lambda i: F.concat(i.cast("string"), F.lit(": "), F.element_at(lines, i)))
    joined = places.join(sources.select("file", "source"), "file")
    return joined.where(F.col("line").between(1, F.size(lines))).withColumn("text", F.array_join(numbered, "\n")).drop("source")
