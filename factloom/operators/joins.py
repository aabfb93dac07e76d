"""Correlations: prefix and suffix joins, consensus merge, as-of, interval and wildcard joins.

None of them is a nested loop: every join has an equality on a key that spreads the rows, and a range or a
choice of the best partner comes after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dotted_prefixes, dotted_suffixes, short_name


def longest_prefix(names: DataFrame, aliases: DataFrame, name: str = "fqn") -> DataFrame:
    """``canonical``: the name with its longest alias prefix (on a dot boundary) rewritten; itself without one.

    aliases: ``alias``, ``target``; of equal aliases the smallest target. Names are exploded to their prefixes
    and joined by equality; the join is on distinct names, so a frequent name is resolved once.
    """
    best_alias = aliases.groupBy("alias").agg(F.min("target").alias("target"))
    prefixes = names.select(F.col(name).alias("_name")).distinct().withColumn("alias", F.explode(dotted_prefixes(F.col("_name"))))
    best = prefixes.join(best_alias, "alias").groupBy("_name").agg(F.max(F.struct(F.length("alias").alias("n"), "alias", "target")).alias("_best"))
    out = names.join(best, names[name].eqNullSafe(best["_name"]), "left")
    rewritten = F.concat(F.col("_best.target"), F.expr(f"substring({name}, length(_best.alias) + 1)"))
    return out.withColumn("canonical", F.coalesce(rewritten, F.col(name))).drop("_name", "_best")


def unique_suffix(names: DataFrame, structural: DataFrame, name: str = "fqn") -> DataFrame:
    """``canonical``: an exact structural name unchanged; else the one structural name that ends in ``.name``; else
    unchanged. Structural names are exploded to their dotted suffixes, counted, and met by equality of the whole name."""
    known = structural.select(F.col("fqn").alias("_known")).distinct()
    endings = known.select("_known", F.explode(dotted_suffixes(F.col("_known"))).alias("_name"))
    found = endings.groupBy("_name").agg(F.count(F.lit(1)).alias("_n"), F.min("_known").alias("_one"), F.max((F.col("_known") == F.col("_name")).cast("int")).alias("_exact"))
    out = names.join(found.where("_n = 1 AND _exact = 0").select("_name", "_one"), names[name] == F.col("_name"), "left")
    return out.withColumn("canonical", F.coalesce("_one", F.col(name))).drop("_name", "_one")


def merge_call_edges(edges: DataFrame) -> DataFrame:
    """One edge per (caller, callee, file, line) with a confidence, and the other callees of its site.

    edges: ``caller``, ``callee``, ``file``, ``line``, ``source``, ``n_arguments``. Two sources or more: 1.0; the
    syntax alone: 0.8; the hierarchy alone: 0.7. A site with several callees keeps all of them, at 0.7 at most.
    """
    merged = edges.groupBy("caller", "callee", "file", "line").agg(
        F.countDistinct("source").alias("n_sources"),
        F.max(F.when(F.col("source") == "AST", 1).otherwise(0)).alias("_ast"),
        F.max("n_arguments").alias("n_arguments"),
    )
    own = F.when(F.col("n_sources") >= 2, 1.0).when(F.col("_ast") == 1, 0.8).otherwise(0.7)
    site = Window.partitionBy("caller", "file", "line")
    callees = F.array_sort(F.collect_set("callee").over(site))
    out = merged.withColumn("_all", callees)
    several = F.size("_all") > 1
    confidence = F.when(several, F.least(own, F.lit(0.7))).otherwise(own)
    others = F.array_except("_all", F.array("callee"))
    return out.select("caller", "callee", "file", "line", "n_sources", "n_arguments", confidence.alias("confidence"), F.array_join(others, ",").alias("alternatives"))


def site_conflicts(edges: DataFrame) -> DataFrame:
    """Call sites (``caller``, ``file``, ``line``) with several callees: ``n_callees``."""
    return edges.groupBy("caller", "file", "line").agg(F.countDistinct("callee").alias("n_callees")).where("n_callees > 1")


def hierarchy_edges(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges to the method that the caller's class really has under the callee's short name, where it differs.

    edges: ``caller_class``, ``callee``; methods: ``class``, ``method``, ``definer`` (0 is the class itself, then its
    bases in order), ``defined_in``.
    """
    first = methods.groupBy("class", "method").agg(F.min(F.struct("definer", "defined_in")).getField("defined_in").alias("defined_in"))
    named = edges.withColumn("method", short_name(F.col("callee"))).withColumnRenamed("caller_class", "class")
    out = named.join(first, ["class", "method"]).withColumn("resolved", F.concat("defined_in", F.lit("."), "method"))
    return out.where(F.col("resolved") != F.col("callee")).select("class", "callee", "resolved").distinct()


def as_of(uses: DataFrame, facts: DataFrame, by: list[str], use_at: str, fact_at: str, value: str) -> DataFrame:
    """Each use with the value of the latest fact strictly before it, per ``by``; null without one.

    One sort-based pass over the union of both sides: no use meets all facts of its key. Facts that share a place:
    the greatest value. ``use_at`` and ``fact_at`` are places of one comparable type.
    """
    columns = [c for c in uses.columns if c not in by]
    u = uses.select(*by, F.col(use_at).alias("_at"), F.lit(0).alias("_fact"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.struct(*columns).alias("_use"))
    f = facts.select(*by, F.col(fact_at).alias("_at"), F.lit(1).alias("_fact"), F.col(value).alias("_v"), F.lit(None).cast(u.schema["_use"].dataType).alias("_use"))
    before = Window.partitionBy(*by).orderBy("_at", "_fact", "_v").rowsBetween(Window.unboundedPreceding, -1)
    out = u.union(f).withColumn("_found", F.last("_v", ignorenulls=True).over(before)).where("_fact = 0")
    return out.select(*by, "_use.*", F.col("_found").alias(value))


def in_interval(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the intervals [start, end) that hold them (null end: open), per ``by``.

    Intervals are dealt to bins of ``width``; a point looks into its own bin. An interval without an end is
    closed at its key's last point, so bins are bounded by the points there are.
    """
    last = points.groupBy(*by).agg(F.max(at).alias("_last"))
    closed = intervals.join(last, by).withColumn("_end", F.coalesce(F.col(end), F.col("_last") + 1)).where(F.col("_end") > F.col(start))
    binned = closed.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col("_end") - 1) / width)))).drop("_last")
    hit = points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*by, "_bin"])
    return hit.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col("_end"))).drop("_bin", "_end")


def wildcard_join(facts: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Facts with the rules whose columns equal theirs, null in a rule being any value.

    One equality join for each combination of null columns that the rules really have. Rules that are null in all
    columns concern every fact; they stay a list of their own (``global_rules``) instead of multiplying the facts.
    """
    shapes = [tuple(r) for r in rules.select(*(F.col(c).isNull().alias(c) for c in columns)).distinct().collect()]  # 2 ** columns rows at most
    found = None
    for shape in shapes:
        own = rules
        for c, wild in zip(columns, shape, strict=True):
            own = own.where(F.col(c).isNull() if wild else F.col(c).isNotNull())
        fixed = [c for c, wild in zip(columns, shape, strict=True) if not wild]
        own = own.drop(*(c for c in columns if c not in fixed))
        if not fixed:
            continue
        part = facts.join(own, fixed).select(*facts.columns, *(c for c in rules.columns if c not in columns))
        found = part if found is None else found.union(part)
    if found is None:
        extra = [F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in rules.columns if c not in columns]
        return facts.select(*facts.columns, *extra).where(F.lit(False))
    return found


def global_rules(rules: DataFrame, columns: list[str]) -> DataFrame:
    """The rules that name none of the columns."""
    for c in columns:
        rules = rules.where(F.col(c).isNull())
    return rules.drop(*columns)


def precise_first(matches: DataFrame, site: list[str], precise: Column) -> DataFrame:
    """Lossy matches go where a precise one covers the same site; precise ones stay. One pass over the matches: each site's
    rows meet in a window."""
    covered = F.max(precise.cast("int")).over(Window.partitionBy(*site))
    return matches.withColumn("_covered", covered).where(precise | (F.coalesce("_covered", F.lit(0)) == 0)).drop("_covered")
