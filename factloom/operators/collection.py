"""Fact sets: relations with a total order, and the collection queries on them.

Order is part of the data model (first evidence feeds fingerprints), so a fact set names the columns that
order it; distinct unions and slices refer to them, never to the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Self

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FactSet:
    """A frame and the columns that order it totally; ``kind`` keeps different relations apart."""

    df: DataFrame
    order: tuple[str, ...]
    kind: str = "facts"

    def _with(self, df: DataFrame) -> Self:
        return type(self)(df, self.order, self.kind)

    def where(self, condition: Column | str) -> Self:
        return self._with(self.df.where(condition))

    def in_file(self, path: str, column: str = "file") -> Self:
        """Files that end with the path."""
        return self.where(F.col(column).endswith(path))

    def in_dir(self, path: str, column: str = "file") -> Self:
        """Files that contain the path."""
        return self.where(F.col(column).contains(path))

    def having(self, column: str, *values: object) -> Self:
        """Rows whose array column holds any of the values."""
        return self.where(F.arrays_overlap(F.col(column), F.array(*(F.lit(v) for v in values))))

    def first(self) -> DataFrame:
        """The first row: a top-1, not a sort of everything."""
        return self.df.orderBy(*self.order).limit(1)

    def one(self) -> object:
        """The only row; raises unless there is exactly one."""
        rows = self.df.limit(2).collect()
        if len(rows) != 1:
            raise LookupError(f"{'no' if not rows else 'more than one'} {self.kind} row")
        return rows[0]

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def top(self, n: int) -> DataFrame:
        return self.df.orderBy(*self.order).limit(n)

    def slice(self, start: int, stop: int) -> DataFrame:
        """Rows start to stop (exclusive) in order; reads ``stop`` rows of each task at most."""
        return self.df.orderBy(*self.order).offset(start).limit(max(0, stop - start))

    def union(self, other: FactSet) -> Self:
        """Distinct union; of equal rows one stays. Both sides must be of one kind."""
        if other.kind != self.kind:
            raise TypeError(f"a {self.kind} set and a {other.kind} set have no union")
        return self._with(self.df.unionByName(other.df).distinct())

    def group_by(self, *keys: str, collect: str, most: int | None = None) -> DataFrame:
        """Per key the collected column's values in order; ``most`` keeps that many of each key by a window."""
        df = self.df
        if most is not None:
            rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*self.order))
            df = df.withColumn("_rank", rank).where(F.col("_rank") <= most)
        item = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(self.order)), F.col(collect).alias("value"))
        items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["value"])
        return df.groupBy(*keys).agg(items.alias(collect))

    def count_by(self, *keys: str) -> DataFrame:
        return self.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def tabulate(self, columns: Sequence[str], n: int = 20) -> str:
        """The first rows as an aligned text table."""
        rows = [list(columns), *([str(v) for v in r] for r in self.df.orderBy(*self.order).select(*columns).limit(n).collect())]
        widths = [max(len(r[i]) for r in rows) for i in range(len(columns))]
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def section_counts(df: DataFrame, sections: Sequence[str]) -> DataFrame:
    """``section``, ``value``, ``n``: counts of several columns in one pass by grouping sets; null values as ''."""
    sets = [[s] for s in sections]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(s) for s in sections))
    counts = grouped.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    width = len(sections)
    bit = lambda i: (1 << width) - 1 - (1 << (width - 1 - i))  # noqa: E731  of the set that holds column i alone
    section = F.coalesce(*(F.when(F.col("_g") == bit(i), F.lit(s)) for i, s in enumerate(sections)))
    value = F.coalesce(*(F.when(F.col("_g") == bit(i), F.col(s).cast("string")) for i, s in enumerate(sections)), F.lit(""))
    return counts.select(section.alias("section"), value.alias("value"), "n")


def top_of_sections(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent values of each section, ties by value."""
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
