"""Incremental rebuild: a stream of facts replaces the facts of the files it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.facts import schema_of


def replace_files(current: DataFrame, changed: DataFrame, file: str = "file") -> DataFrame:
    """``current`` without the rows of the files that ``changed`` has, and ``changed``."""
    touched = changed.select(file).distinct()
    return current.join(touched, file, "left_anti").select(*current.columns).unionByName(changed.select(*current.columns))


def fact_stream(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """A family's JSONL files as they arrive, under its schema."""
    return spark.readStream.schema(schema_of(family)).json(folder)


def maintain(stream: DataFrame, table: str, checkpoint: str, file: str = "file") -> StreamingQuery:
    """Keeps versions of a table (``table/v=N``) in which each batch's files replace what was known of them.

    A version is written whole before readers see it: ``latest`` takes the newest one with a success marker, so a
    batch that is repeated after a failure writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = latest(spark, table, below=number)
        made = batch if known is None else replace_files(known, batch, file)
        made.write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, below: int | None = None) -> DataFrame | None:
    """The newest complete version (before ``below``), or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(table)):
        return None
    names = [s.getPath() for s in files.listStatus(path(table))]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and files.exists(path(f"{p}/_SUCCESS"))]
    done = [v for v in done if below is None or v < below]
    return spark.read.parquet(f"{table}/v={max(done)}") if done else None


def windowed_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key and window of event time; rows later than ``late`` are left out once their window is closed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
