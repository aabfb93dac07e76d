"""Counts of facts, findings, errors and gaps by section, their differences, and listings of the most frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_label, severity_rank
from .collection import section_counts, top_of_sections

#: The sections of each relation's summary.
SECTIONS = {
    "functions": ("file", "kind", "is_async", "parent_class"),
    "classes": ("file", "is_abstract", "mro_complete", "metaclass"),
    "decorators": ("name", "fqn", "target_fqn"),
    "imports": ("module", "is_from_import", "is_conditional", "is_relative"),
    "attributes": ("attr_name", "access_kind", "is_write", "containing_function_fqn"),
    "value_flow_edges": ("kind", "containing_function_fqn", "callsite_callee_fqn"),
    "call_edges": ("source", "resolution", "unresolved_reason", "dynamic_dispatch_kind"),
    "errors": ("error_kind", "pass_name", "is_fatal", "message"),
    "findings": ("rule_id", "severity", "endpoint", "file"),
    "gaps": ("kind", "phase", "provider", "file", "message"),
}


def summary(df: DataFrame, relation: str) -> DataFrame:
    """``section``, ``value``, ``n`` of a relation's own sections, in one pass."""
    return section_counts(df, [c for c in SECTIONS[relation] if c in df.columns])


def top(df: DataFrame, relation: str, n: int = 10) -> DataFrame:
    """The most frequent values of each section."""
    return top_of_sections(summary(df, relation), n)


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``before``, ``after``, ``delta`` of two tables of counts (``keys``, ``n``); a key that one side lacks counts 0 there."""
    both = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), keys, "full").na.fill(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))


def coverage(declared: DataFrame, used: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``by``, ``declared``, ``matched``: how many of the declared keys some use has."""
    met = used.select(key).distinct().withColumn("_met", F.lit(1))
    return declared.join(met, key, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("declared"), F.count("_met").alias("matched"))


def findings_by_file(found: DataFrame) -> DataFrame:
    """``file``, ``worst`` (a severity), ``n``, most severe files first by ``place``."""
    files = found.groupBy("file").agg(F.max(severity_rank(F.col("severity"))).alias("_rank"), F.count(F.lit(1)).alias("n"))
    return files.select("file", severity_label(F.col("_rank")).alias("worst"), "n", (-F.col("_rank")).alias("place"))


def by_package(rows: DataFrame, name: str = "handler") -> DataFrame:
    """``package``, ``n``: rows by the first segment of a dotted name."""
    return rows.groupBy(F.substring_index(name, ".", 1).alias("package")).agg(F.count(F.lit(1)).alias("n"))


def profile(calls: DataFrame) -> DataFrame:
    """``phase``, ``n_calls``, ``total_ms``, ``longest_ms`` of timed calls (``phase``, ``ms``)."""
    return calls.groupBy("phase").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms"))


def sizes(files: DataFrame, folder: str = "folder") -> DataFrame:
    """``folder``, ``n_files``, ``bytes`` of files (``folder``, ``length``)."""
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


def suppression_counts(found: DataFrame) -> DataFrame:
    """``source``, ``n``: findings by what suppressed them; ``active`` for the others."""
    return found.groupBy(F.coalesce("suppressed_by", F.lit("active")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def listing(found: DataFrame, order: list[str], n: int) -> tuple[DataFrame, int]:
    """The first ``n`` rows in order, and how many there are beyond them."""
    return found.orderBy(*order).limit(n), max(0, found.count() - n)
