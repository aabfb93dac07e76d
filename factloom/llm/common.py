"""Small helpers shared by the training-data operators: shared-folder tables and text coercion."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``: the characters that count as white space for all contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


#: Session settings that the operators need, with the defaults they replace. Batches of 4 MB keep Arrow's buffers,
#: in the JVM and in the workers, small for texts of any length. Spark 4.1 gave wrong counts for aggregates over
#: unions of frames it took for equally partitioned, so that inference is switched off.
SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b"),
    "spark.sql.unionOutputPartitioning": ("true", "false"),
}


def prepared(df: DataFrame) -> DataFrame:
    """The frame, after ``SETTINGS`` in its session; what a user has set stays."""
    conf = df.sparkSession.conf
    for name, (default, value) in SETTINGS.items():
        if conf.get(name, None) == default:
            conf.set(name, value)
    return df


#: Blocks of a worker's memory from so many bytes on go back to the system when they are freed.
OWN_PAGES = 1 << 20


@lru_cache(maxsize=1)
def _memory() -> tuple[ctypes.CDLL, list[pa.MemoryPool]]:
    """The C library and Arrow's pools, once per worker: Arrow's buffers come from the library, which maps large blocks
    by themselves.

    Left alone, glibc raises that size up to 32 MB as blocks are freed, and keeps what lies below it, as Arrow's own
    allocator does.
    """
    pools = [pa.default_memory_pool(), pa.system_memory_pool()]
    pa.set_memory_pool(pools[1])
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
    return libc, pools


def give_back() -> None:
    """Gives a worker's unused memory back to the system."""
    libc, pools = _memory()
    for pool in pools:  # parts of Arrow keep to the first one
        pool.release_unused()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, holding little unused memory and none when its task ends: workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _memory()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class Scratch:
    """Tables written to the shared folder to cut lineage; each survives the loss of executors.

    ``drop`` removes a table that nothing lazy reads any more; the others go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        prepared(spark.range(0))
        self._n = 0
        atexit.register(self._quiet_drop_all)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        at = f"{self.root}/t{self._n}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at  # type: ignore[attr-defined]
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)  # type: ignore[attr-defined]

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _quiet_drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM may be gone when the driver ends
            pass


#: A key is hot beyond ``HOT`` rows and beyond an equal share of all rows among ``HOT_KEYS`` keys.
HOT, HOT_KEYS = 1_000, 16_384


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", count: str = "_copies", hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and, as ``count``, the number of rows with it.

    Rows of hot keys stay where they are and meet a broadcast of those keys: fewer than ``HOT_KEYS`` of them by
    arithmetic, whatever ``total`` (the number of rows) is. The others meet by a shuffle, where no key has more than the
    bar. Null keys must not be asked for. Both frames are read twice where a key is hot: give saved ones.
    """
    bar = max(hot, total // HOT_KEYS)
    hot_ones = table.where(F.col(count) > bar)
    table, picked = table.drop(count), hot_ones.drop(count)
    if total <= bar or hot_ones.isEmpty():
        return rows.join(table, key, how)
    names = F.broadcast(picked.select(key))
    rest = rows.join(names, key, "left_anti").join(table.join(names, key, "left_anti"), key, how)
    return rows.join(F.broadcast(picked), key).unionByName(rest)


def no_clash(made: tuple[str, ...], carried: tuple[str, ...]) -> None:
    """Raises where a carried column has a name that the result gives to another one."""
    if twice := sorted(n for n in set(carried) if n in made or carried.count(n) > 1):
        raise ValueError(f"the result has other columns of these names: {', '.join(twice)}")


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as empty in every contract but the language one."""
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
