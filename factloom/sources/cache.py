"""Caches in a shared folder: extracted facts by content and schema, and result tables by any key.

An entry is a Parquet table; it counts once the job that writes it has committed (``_SUCCESS``), so that a lost driver leaves
no half entry behind that anyone reads.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResultCache:
    """Tables by key. ``get`` is None for an unknown key or one whose write did not end."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def has(self, key: str) -> bool:
        return self._exists(f"{self._path(key)}/_SUCCESS")

    def get(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(self._path(key)) if self.has(key) else None

    def put(self, key: str, df: DataFrame) -> DataFrame:
        """The table as it will be read; an entry of the key is replaced."""
        df.write.mode("overwrite").parquet(self._path(key))
        return self.spark.read.schema(df.schema).parquet(self._path(key))

    def status(self) -> DataFrame:
        """``entry``, ``n_files``, ``bytes`` of each entry."""
        if not self._exists(self.folder):
            return self.spark.createDataFrame([], "entry string, n_files bigint, bytes bigint")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.folder)
        entry = F.element_at(F.split("path", "/"), -2)
        return files.groupBy(entry.alias("entry")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


class FactCache(ResultCache):
    """Extracted records by the hash of what they come from and of the families' schemas."""

    def get(self, key: str):  # type: ignore[override]
        """The index, or None."""
        found = super().get(key)
        return None if found is None else self._index(found)

    def put(self, key: str, df: DataFrame):  # type: ignore[override]
        """Writes records (``extract_records``), split by family so that a family's read skips the others; gives the index."""
        df.write.mode("overwrite").partitionBy("family").parquet(self._path(key))
        return self._index(self.spark.read.parquet(self._path(key)))

    def _index(self, records: DataFrame):
        from ..extract.index_facts import family
        from ..plans.index import Index
        from .facts import FAMILIES

        return Index(self.spark, {f: family(records, f).drop("ord") for f in FAMILIES})


class Budget:
    """Counts of rows that steps of a build may make; a step beyond its share is reported, not cut."""

    def __init__(self, rows: dict[str, int]):
        self.rows = dict(rows)
        self.spent: dict[str, int] = {}

    def spend(self, step: str, n: int) -> bool:
        """Whether the step is still within its rows; steps without a budget always are."""
        self.spent[step] = self.spent.get(step, 0) + n
        return step not in self.rows or self.spent[step] <= self.rows[step]

    def exceeded(self) -> list[str]:
        return sorted(s for s, n in self.spent.items() if s in self.rows and n > self.rows[s])
