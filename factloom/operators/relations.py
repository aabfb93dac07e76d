"""The relations' own filters, by name: facts as extracted first, domain relations after them.

Each is a ``FactSet`` whose filters compile to Columns or to a semi-join; nothing is collected. Facts carry ``location``
structs and keep the file's exact path; domain relations carry ``file`` and match suffixes and substrings.
"""

from __future__ import annotations

from functools import reduce
from typing import Self

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import call_name, short_name
from .collection import FactSet
from .selectors import Fn, comparing


def _named_or_qualified(name: str, names: str, fqns: str) -> Column:
    return F.array_contains(names, name) | F.coalesce(F.array_contains(fqns, name), F.lit(False))


def decorated(rows: DataFrame, decorators: DataFrame, name: str, key: str = "fqn") -> DataFrame:
    """Rows with a decorator of that short or qualified name. decorators: ``target_fqn``, ``name``, ``fqn``."""
    hits = decorators.where((F.col("name") == name) | (F.col("fqn") == name)).select(F.col("target_fqn").alias(key))
    return rows.join(hits, key, "left_semi")


# --- facts as extracted -------------------------------------------------------------------------------------------


class FunctionFacts(FactSet):
    def by_fqn(self, fqn: str) -> DataFrame:
        """The first row of that name, or none."""
        return self.where(F.col("fqn") == fqn).first()

    def in_file(self, path: str, column: str = "file") -> Self:
        """Exactly that file."""
        return self.where(F.col(column) == path)

    def in_dir(self, path: str, column: str = "file") -> Self:
        """Files whose path begins so."""
        return self.where(F.col(column).startswith(path))

    def in_class(self, fqn: str) -> Self:
        return self.where(F.col("parent_class") == fqn)

    def methods(self) -> Self:
        return self.where("is_method")

    def top_level(self) -> Self:
        return self.where(F.col("kind") == "TOP_LEVEL")

    def nested(self) -> Self:
        return self.where("is_nested")

    def decorated_with(self, name: str) -> Self:
        """By the parallel arrays of short and qualified decorator names."""
        return self.where(_named_or_qualified(name, "decorator_names", "decorator_fqns"))

    def parameter_named(self, name: str) -> DataFrame:
        """``fqn`` and the ``parameter`` of that name; functions without it go."""
        found = F.get(F.filter("params", lambda p: p["name"] == name), F.lit(0))
        return self.df.select("fqn", found.alias("parameter")).where("parameter IS NOT NULL")


class ClassFacts(FactSet):
    def direct_subclasses_of(self, base: str) -> Self:
        """Members of the base's ``subclasses``."""
        listed = self.df.where(F.col("fqn") == base).select(F.explode("subclasses").alias("fqn"))
        return self._with(self.df.join(listed, "fqn", "left_semi"))

    def subclasses_of(self, base: str) -> Self:
        """Members of the base's ``all_subclasses``."""
        listed = self.df.where(F.col("fqn") == base).select(F.explode("all_subclasses").alias("fqn"))
        return self._with(self.df.join(listed, "fqn", "left_semi"))

    def decorated_with(self, decorators: DataFrame, name: str) -> Self:
        return self._with(decorated(self.df, decorators, name))


class DecoratorFacts(FactSet):
    def on_function(self, fqn: str) -> Self:
        return self.where(F.col("target_fqn") == fqn)

    def on_function_named(self, name: str) -> Self:
        return self.where(short_name(F.col("target_fqn")) == name)

    def named(self, name: str) -> Self:
        return self.where(F.col("name") == name)

    def with_fqn(self, fqn: str) -> Self:
        return self.where(F.col("fqn") == fqn)


class ImportFacts(FactSet):
    def importing(self, module: str) -> Self:
        return self.where(F.col("module") == module)

    def importing_name(self, name: str) -> Self:
        return self.where(F.array_contains("names", name))


class AttributeFacts(FactSet):
    def reads(self) -> Self:
        return self.where("NOT is_write")

    def writes(self) -> Self:
        return self.where("is_write")

    def reads_on(self, target: str) -> Self:
        return self.reads().where(F.col("target_expr") == target)

    def writes_on(self, target: str) -> Self:
        return self.writes().where(F.col("target_expr") == target)

    def named(self, name: str) -> Self:
        return self.where(F.col("attr_name") == name)

    def in_function(self, fqn: str) -> Self:
        return self.where(F.col("containing_function_fqn") == fqn)

    def of_kind(self, kind: str) -> Self:
        return self.where(F.col("access_kind") == kind)


class FlowFacts(FactSet):
    def in_function(self, fqn: str) -> Self:
        return self.where(F.col("containing_function_fqn") == fqn)

    def flows_from(self, file: str, line: int) -> Self:
        """Edges that leave a line."""
        return self.where((F.col("source_location.file") == file) & (F.col("source_location.line") == line))

    def flows_to(self, file: str, line: int) -> Self:
        """Edges that enter a line."""
        return self.where((F.col("target_location.file") == file) & (F.col("target_location.line") == line))

    def assignments_to(self, name: str, function: str) -> Self:
        return self.in_function(function).where(F.col("target_expr") == name)


class SymbolFacts(FactSet):
    """References to names; ``order`` says which resolution comes first."""

    def in_file(self, path: str, column: str = "location.file") -> Self:
        return self.where(F.col(column) == path)

    def resolutions(self) -> DataFrame:
        """``name``, ``file``, ``fqn``: what a name means in a file by its first resolved reference."""
        first = F.min(F.struct(*self.order, "fqn")).getField("fqn")
        return self.df.where("fqn IS NOT NULL").groupBy("name", F.col("location.file").alias("file")).agg(first.alias("fqn"))

    def resolve(self, asked: DataFrame) -> DataFrame:
        """Asked (``name``, ``file``) with ``fqn``, null where nothing says."""
        return asked.join(self.resolutions(), ["name", "file"], "left")

    def usages(self, fqns: DataFrame) -> DataFrame:
        """Places of the asked ``fqn``."""
        return self.df.join(fqns.select("fqn").distinct(), "fqn", "left_semi").select("fqn", "location")

    def existing(self, fqns: DataFrame) -> DataFrame:
        """Those of the asked ``fqn`` that some reference means."""
        return fqns.join(self.df.select("fqn"), "fqn", "left_semi")

    def unresolved(self) -> Self:
        return self.where("fqn IS NULL")


class ErrorFacts(FactSet):
    def for_pass(self, name: str) -> Self:
        return self.where(F.col("pass_name") == name)

    def fatal(self) -> Self:
        return self.where("is_fatal")


# --- domain relations ---------------------------------------------------------------------------------------------


class Routes(FactSet):
    def with_path(self, path: str) -> Self:
        return self.where(F.col("path") == path)

    def accepting(self, *methods: str) -> Self:
        return self.having("methods", *methods)

    def in_group(self, name: str) -> Self:
        return self.where(F.col("group") == name)


class Groups(FactSet):
    def named(self, name: str) -> Self:
        return self.where(F.col("group") == name)

    def routes(self, routes: DataFrame) -> DataFrame:
        """The routes of these groups."""
        return routes.join(self.df.select("group").distinct(), "group", "left_semi")


class Functions(FactSet):
    def named(self, name: str) -> Self:
        return self.where(F.col("name") == name)

    def with_fqn(self, fqn: str) -> Self:
        return self.where(F.col("fqn") == fqn)

    def decorated_with(self, decorators: DataFrame, name: str) -> Self:
        return self._with(decorated(self.df, decorators, name))


class Classes(Functions):
    def direct_subclasses_of(self, base: str) -> Self:
        return self.where(F.array_contains("bases", base))

    def subclasses_of(self, base: str) -> Self:
        """By the ``mro``, which holds all ancestors."""
        return self.where(F.array_contains(F.slice("mro", 2, 2**30), base))


class Decorators(FactSet):
    def named(self, name: str) -> Self:
        return self.where(F.col("name") == name)

    def with_fqn(self, fqn: str) -> Self:
        return self.where(F.col("fqn") == fqn)


def uses(expression: str, value: str) -> Column:
    """An operand equals the value, or the expression's text holds it; null operands equal nothing."""
    equal = [F.coalesce(F.col(side) == value, F.lit(False)) for side in ("left", "right")]
    return reduce(Column.__or__, equal, F.col(expression).contains(value))


class Conditions(FactSet):
    """Rows with ``expression``, ``left``, ``right``: conditions, checks and value predicates alike."""

    def using(self, value: str) -> Self:
        return self.where(uses("expression", value))

    def comparing(self, left: str, right: str) -> Self:
        """Both operands against shell patterns."""
        return self.where(comparing("left", left) & comparing("right", right))


class Checks(Conditions):
    def in_category(self, category: str) -> Self:
        """Of that category; ``a|b`` belongs to both of its parts."""
        return self.where((F.col("category") == category) | F.array_contains(F.split("category", r"\|"), category))


class CallSites(FactSet):
    """Rows with ``name``, ``fqn`` (of the target), ``expression``, ``arguments array<struct<index,name,expression>>``."""

    def to(self, selector: Fn) -> Self:
        return self.where(selector.matches("name", "fqn", "expression"))

    def with_argument_from(self, expression: str) -> Self:
        """Some argument's text is exactly that."""
        return self.where(F.exists("arguments", lambda a: a["expression"] == expression))

    def argument(self, index: int) -> DataFrame:
        """The rows with the ``argument`` at a position, null without one."""
        return self.df.withColumn("argument", F.get(F.filter("arguments", lambda a: a["index"] == index), F.lit(0)))

    def keyword_argument(self, name: str) -> DataFrame:
        return self.df.withColumn("argument", F.get(F.filter("arguments", lambda a: a["name"] == name), F.lit(0)))


class Sinks(FactSet):
    def of_kind(self, kind: str) -> Self:
        return self.where(F.col("kind") == kind)


class SafeValues(FactSet):
    """Validated values and generated URLs: rows with ``expression`` and ``safe_for_sink_kinds``."""

    def named(self, name: str) -> Self:
        """By the short name of the call that validated."""
        return self.where(call_name(F.col("expression")) == name)

    def safe_for(self, kind: str) -> Self:
        return self.having("safe_for_sink_kinds", kind)
