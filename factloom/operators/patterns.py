"""The pattern engine: a dimension of declarative patterns against facts, phase by phase.

A pattern row: ``provider``, ``phase``, ``kind`` (call, decorator, attribute, symbol, base), ``fqn`` (null: any), ``name``
(short name, null: any), ``access`` (read, write or null), ``gives``. The dimension is small and declared with the
library, facts are large: joins are equalities on names, which Catalyst broadcasts when the dimension's size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dotted_prefixes, owner_of, short_name
from .joins import longest_prefix, precise_first

#: Phases in the order in which they see each other's matches.
PHASES = ("routing", "input", "dependency", "effect", "sink", "check", "validation", "url", "lifecycle", "middleware", "exemption", "propagation")


def active(providers: DataFrame, imports: DataFrame) -> DataFrame:
    """Providers (``provider``, ``library``) whose library, or a package in it, some file imports (``module``)."""
    names = imports.select(F.explode(dotted_prefixes(F.col("module"))).alias("library")).distinct()
    return providers.join(names, "library", "left_semi")


def match_calls(edges: DataFrame, patterns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls with the patterns they meet, and ``how``: ``exact`` by canonical name, ``name`` by the short name where the
    callee has no owner. A name match goes where an exact one covers the site.

    edges: ``site``, ``callee``; patterns: ``pattern``, ``fqn``; aliases: ``alias``, ``target``.
    """
    named = longest_prefix(edges, aliases, "callee")
    exact = named.join(patterns, named["canonical"] == patterns["fqn"]).withColumn("how", F.lit("exact"))
    bare = named.where(owner_of(F.col("canonical")).isNull()).withColumn("_short", F.col("canonical"))
    known = patterns.withColumn("_short", short_name(F.col("fqn")))
    by_name = bare.join(known, "_short").drop("_short").where(F.col("canonical") != F.col("fqn")).withColumn("how", F.lit("name"))
    return precise_first(exact.unionByName(by_name), ["site"], F.col("how") == "exact")


def match_decorators(decorators: DataFrame, patterns: DataFrame) -> DataFrame:
    """Decorators (``target``, ``fqn``, ``name``) against patterns by qualified name, else by short name if that is all
    the pattern has."""
    full = decorators.join(patterns.where("fqn IS NOT NULL").drop("name"), "fqn")
    short = decorators.join(patterns.where("fqn IS NULL").drop("fqn"), "name")
    return full.select("target", "pattern").union(short.select("target", "pattern")).distinct()


def match_attributes(accesses: DataFrame, patterns: DataFrame) -> DataFrame:
    """Attribute accesses (``receiver``, ``attribute``, ``is_write``) against patterns (``fqn``, ``name``, ``access``);
    a pattern without an access takes both."""
    joined = accesses.join(patterns, (F.col("receiver") == F.col("fqn")) & (F.col("attribute") == F.col("name")))
    return joined.where(F.col("access").isNull() | (F.col("access") == F.when(F.col("is_write"), "write").otherwise("read")))


def match_bases(classes: DataFrame, patterns: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Classes (``fqn``) with a pattern's class among their transitive bases (ancestors: ``root``, ``node``)."""
    return classes.join(ancestors, F.col("fqn") == F.col("root")).join(patterns.withColumnRenamed("fqn", "node"), "node").select("root", "pattern").distinct()


def coverage(patterns: DataFrame, matches: DataFrame) -> DataFrame:
    """Per provider and phase: patterns declared, and matched at least once."""
    met = matches.select("pattern").distinct().withColumn("_met", F.lit(1))
    both = patterns.join(met, "pattern", "left")
    return both.groupBy("provider", "phase").agg(F.count(F.lit(1)).alias("declared"), F.count("_met").alias("matched"))


def in_phases(matches: dict[str, DataFrame]) -> DataFrame:
    """All matches with the rank of their phase, which orders evidence between phases."""
    parts = [df.withColumn("phase_rank", F.lit(PHASES.index(p))) for p, df in matches.items()]
    return reduce(DataFrame.unionByName, parts)
