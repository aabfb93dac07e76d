"""Value flow: name-linked reachability, whole-value preservation, call bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure

#: Kinds of steps that hand a value on unchanged; a null kind does too.
WHOLE = ("alias", "assign", "annotated_assign", "chain", "return")


def name_linked(edges: DataFrame, sources: DataFrame, max_depth: int = 50) -> DataFrame:
    """``root``, ``node``, ``depth``: expressions that each source expression reaches. Edges follow each other where
    expressions are equal, whatever their function and line."""
    return closure(edges.select(F.col("source_expr").alias("src"), F.col("target_expr").alias("dst")), sources, max_depth)


def preserves_whole(kind: str = "kind") -> Column:
    return F.col(kind).isNull() | F.lower(kind).isin(*WHOLE)


def whole_value_reach(edges: DataFrame, sources: DataFrame, max_depth: int = 50) -> DataFrame:
    """As ``name_linked``, over steps that keep the whole value."""
    return name_linked(edges.where(preserves_whole()), sources, max_depth)


def argument_bridge(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each argument with the parameter it binds to; ``gap`` where there is none.

    arguments: ``call_id``, ``callee``, ``position``, ``keyword``, ``expression``; parameters: ``callee``, ``name``,
    ``position`` (of positional ones), where position 0 may be ``self`` or ``cls``, which shifts positions by one.
    """
    implicit = parameters.where((F.col("position") == 0) & F.col("name").isin("self", "cls")).select("callee", F.lit(1).alias("_shift")).distinct()
    given = arguments.join(implicit, "callee", "left").withColumn("_at", F.col("position") + F.coalesce("_shift", F.lit(0)))
    p = parameters.select("callee", F.col("name").alias("parameter"), F.col("position").alias("_p"))
    by_name = given.where("keyword IS NOT NULL").join(p.withColumnRenamed("parameter", "_k"), (given["callee"] == p["callee"]) & (F.col("keyword") == F.col("_k")), "left").select(*(given[c] for c in arguments.columns), F.col("_k").alias("parameter"))
    q = parameters.select(F.col("callee").alias("_callee"), F.col("name").alias("parameter"), F.col("position").alias("_p"))
    by_place = given.where("keyword IS NULL").join(q, (F.col("callee") == F.col("_callee")) & (F.col("_at") == F.col("_p")), "left").select(*(given[c] for c in arguments.columns), "parameter")
    return by_name.union(by_place).withColumn("gap", F.col("parameter").isNull())


def return_bridge(returns: DataFrame, uses: DataFrame) -> DataFrame:
    """Flow edges from a callee's returned expressions to the caller's expressions of the call.

    returns: ``callee``, ``returned``; uses: ``caller``, ``callee``, ``line``, ``expression``. Direct recursion has none.
    """
    joined = uses.where(F.col("caller") != F.col("callee")).join(returns, "callee")
    return joined.select("caller", "callee", "line", F.col("returned").alias("source_expr"), F.col("expression").alias("target_expr")).distinct()
