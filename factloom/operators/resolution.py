"""Name resolution as joins: what a name means at a place, re-exports, star imports, and what stays unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dotted_prefixes
from .joins import as_of, longest_prefix

#: Re-exports that follow one another up to so many times.
CHAIN = 8


def binding_ranges(bindings: DataFrame) -> DataFrame:
    """Bindings (``file``, ``name``, ``line``, ``target``) with ``until``: the line where the name is bound again, null for the last.

    Imports, definitions and assignments are bindings alike; of several on one line the greatest target counts.
    """
    one = bindings.repartition("file", "name").groupBy("file", "name", "line").agg(F.max("target").alias("target"))  # one shuffle serves both
    return one.withColumn("until", F.lead("line").over(Window.partitionBy("file", "name").orderBy("line")))


def meant_at(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """References (``file``, ``name``, ``line``) with ``target``: the latest binding of the name before the line, null without one."""
    one = bindings.groupBy("file", "name", "line").agg(F.max("target").alias("target"))
    return as_of(refs, one, ["file", "name"], "line", "line", "target")


def shadowed(refs: DataFrame, shadows: DataFrame) -> DataFrame:
    """References whose ``fqn`` an import's range rewrites: ``file``, ``name``, ``line``, ``fqn``, the range's target instead of the name's.

    shadows: rows of ``binding_ranges``, which do not overlap, so the latest one that began decides. References outside all ranges keep theirs.
    """
    range_ = F.struct(F.col("line").alias("from"), "until", "target")
    rows = refs.select("file", "name", "line", F.lit(1).alias("_order"), F.struct(*refs.columns).alias("_ref"))
    rows = rows.unionByName(shadows.select("file", "name", "line", F.lit(0).alias("_order"), range_.alias("_range")), allowMissingColumns=True)
    latest = F.last("_range", ignorenulls=True).over(Window.partitionBy("file", "name").orderBy("line", "_order").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_range", latest).where("_ref IS NOT NULL")
    held = F.col("file").isNotNull() & F.col("name").isNotNull() & (F.col("line") >= F.col("_range.from")) & (F.col("_range.until").isNull() | (F.col("line") < F.col("_range.until")))
    meant = F.coalesce(F.when(held, F.col("_range.target")), F.col("_ref.fqn"))
    return found.select(*(meant.alias(c) if c == "fqn" else F.col(f"_ref.{c}").alias(c) for c in refs.columns))


def closed_exports(exports: DataFrame, rounds: int = CHAIN) -> DataFrame:
    """Re-exports (``alias``, ``target``) followed through one another, so that one rewrite suffices. Cycles end after the rounds."""
    out = exports.groupBy("alias").agg(F.min("target").alias("target"))
    step = 1
    while step < rounds:  # each round doubles the distance
        nxt = out.select(F.col("alias").alias("target"), F.col("target").alias("_next"))
        out = out.join(nxt, "target", "left").select("alias", F.when(F.col("_next") != F.col("alias"), F.col("_next")).otherwise(F.col("target")).alias("target"))
        step *= 2
    return out


def through_exports(names: DataFrame, exports: DataFrame, name: str = "fqn") -> DataFrame:
    """``canonical``: names with their longest re-exported prefix rewritten to where it is defined."""
    return longest_prefix(names, closed_exports(exports), name)


def through_assignments(refs: DataFrame, aliases: DataFrame, column: str = "fqn") -> DataFrame:
    """References whose name a module assigned from another one, rewritten once. aliases: ``alias``, ``target``."""
    one = aliases.groupBy("alias").agg(F.min("target").alias("_target"))
    return refs.join(one, refs[column] == one["alias"], "left").withColumn(column, F.coalesce("_target", F.col(column))).drop("alias", "_target")


def star_names(stars: DataFrame, members: DataFrame, exported: DataFrame) -> DataFrame:
    """``file``, ``name``, ``fqn`` that ``from module import *`` binds: the module's ``__all__`` if it has one, else its public members.

    stars: ``file``, ``module``; members: ``module``, ``name``; exported (the ``__all__`` entries): ``module``, ``name``.
    """
    listed = exported.select("module", "name").distinct()
    public = members.where(~F.col("name").startswith("_")).select("module", "name").distinct()
    names = listed.union(public.join(listed.select("module"), "module", "left_anti"))
    return stars.select("file", "module").distinct().join(names, "module").select("file", "name", F.concat("module", F.lit("."), "name").alias("fqn"))


def missing_imports(imports: DataFrame, modules: DataFrame, members: DataFrame) -> DataFrame:
    """Imports (``file``, ``module``, ``name``) of the code base's own packages that name no module and no member there.

    modules: ``module``; members: ``module``, ``name``. Imports of other packages are none of its business.
    """
    top = modules.select(F.substring_index("module", ".", 1).alias("_top")).distinct()
    own = imports.withColumn("_top", F.substring_index("module", ".", 1)).join(top, "_top", "left_semi").drop("_top")
    known = members.select("module", "name").union(
        modules.where("instr(module, '.') > 0").select(F.regexp_replace("module", r"\.[^.]*$", "").alias("module"), F.substring_index("module", ".", -1).alias("name"))
    )
    return own.join(known.distinct(), ["module", "name"], "left_anti").select("file", "module", "name")


def query_chain(calls: DataFrame, models: DataFrame, sessions: DataFrame, query: str = "orm.Query") -> DataFrame:
    """Calls (``site``, ``call_expression``) at the end of a query chain, with ``callee``: the query class's method.

    A chain starts at ``Model.query.…`` for a known model (``name``) or at ``session.query(…)`` for a known session (``name``).
    """
    text = F.col("call_expression")
    found = calls.select(
        "site",
        F.regexp_extract(text, r"^([A-Za-z_]\w*)\.query\.", 1).alias("_model"),
        F.regexp_extract(text, r"^([A-Za-z_][\w.]*)\.query\(", 1).alias("_session"),
        F.regexp_extract(text, r"\.([A-Za-z_]\w*)\([^()]*\)$", 1).alias("_method"),
    ).where("_method NOT IN ('', 'query')")
    by_model = found.join(models.select(F.col("name").alias("_model")).distinct(), "_model", "left_semi")
    by_session = found.join(sessions.select(F.col("name").alias("_session")).distinct(), "_session", "left_semi")
    both = by_model.select("site", "_method").union(by_session.select("site", "_method")).distinct()
    return both.select("site", F.concat(F.lit(f"{query}."), "_method").alias("callee"))


def canonical_columns(rows: DataFrame, structural: DataFrame, columns: list[str], canonicalize) -> DataFrame:
    """The named columns canonicalised one after the other by ``joins.unique_suffix`` or its like."""
    for c in columns:
        rows = canonicalize(rows, structural, c).drop(c).withColumnRenamed("canonical", c)
    return rows


def module_of(file: str = "file") -> Column:
    """The module that a Python file defines."""
    return F.regexp_replace(F.regexp_replace(F.col(file), r"(/__init__)?\.py$", ""), "/", ".")


def imports_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``file``, ``module``: modules of the code base that an import concerns, by any prefix of its name."""
    prefixes = imports.select("file", F.explode(dotted_prefixes(F.concat_ws(".", "module", "name"))).alias("module")).distinct()
    return prefixes.join(modules.select("module").distinct(), "module", "left_semi").select("file", "module")
