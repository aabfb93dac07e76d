"""Pattern descriptors beyond plain names: their rows, and one join for each way in which facts meet them.

A descriptor row says what a library's name means and where in a call its parts stand. The dimension is small and declared;
facts are large. All joins are equalities on names, methods or classes; class patterns meet classes through their ancestors.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import details
from ..functions.scalars import find_argument, owner_of, short_name, types_agree
from .patterns import PHASES
from .selectors import When

#: Method names of class views and the HTTP methods that they answer.
VIEW_METHODS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH"}
#: Methods of a container whose first argument names the key.
KEY_METHODS = ("get", "pop")

SCHEMA = (
    "provider string, phase string, kind string, fqn string, name string, gives string, detail string, access array<string>, "
    "position int, keyword string, methods map<string,string>, safe_kinds array<string>, when_types array<string>, when_literal boolean"
)


@dataclass(frozen=True)
class Descriptor:
    """One pattern. ``kind`` says which facts it meets:

    call, decorator, attribute, container (keyed access on a global), parameter (by its default's call), field (of an instance of
    a subclass), symbol, view and middleware (classes by base), guard_list (class attribute), route_entry (in a list), register
    and send (dispatch), method (a call by the receiver's class). ``position`` and ``keyword`` refer to the argument that matters:
    a key, a target, a view, a signal's name. ``when_types`` and ``when_literal`` restrict calls by that argument.
    """

    phase: str
    kind: str
    gives: str
    fqn: str | None = None
    name: str | None = None
    detail: str | None = None
    access: tuple[str, ...] = ()
    position: int | None = None
    keyword: str | None = None
    methods: dict[str, str] = field(default_factory=dict)
    safe_kinds: tuple[str, ...] = ()
    when_types: tuple[str, ...] = ()
    when_literal: bool | None = None

    def __post_init__(self) -> None:
        if self.phase not in PHASES:
            raise ValueError(f"{self.phase} is no phase")
        if self.fqn is None and self.name is None:
            raise ValueError("a descriptor needs a qualified or a short name")


@dataclass(frozen=True)
class Provider:
    """A library's descriptors; active where some file imports the library."""

    id: str
    library: str
    descriptors: tuple[Descriptor, ...]


def dimension(spark: SparkSession, providers: Iterable[Provider]) -> DataFrame:
    """``pattern``, ``library`` and ``SCHEMA``: a row for each descriptor; of providers with one id the last counts."""
    by_id = {p.id: p for p in providers}
    names = [f.name for f in fields(Descriptor)]
    rows = []
    for p in (by_id[i] for i in sorted(by_id)):
        for d in p.descriptors:
            own = {n: getattr(d, n) for n in names} | {"provider": p.id}
            rows.append((len(rows), p.library, *(list(v) if isinstance(v := own[c.split()[0]], tuple) else v for c in SCHEMA.split(", "))))
    return spark.createDataFrame(rows, f"pattern int, library string, {SCHEMA}")


def of_kind(patterns: DataFrame, *kinds: str) -> DataFrame:
    return patterns.where(F.col("kind").isin(*kinds))


# --- arguments and predicates -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArgRef:
    """An argument of a call by position or keyword, and tests of it."""

    position: int | None = None
    keyword: str | None = None

    def column(self, arguments: str = "arguments") -> Column:
        return find_argument(F.col(arguments), self.position, self.keyword)

    def is_literal(self, arguments: str = "arguments") -> When:
        """Whether it is a constant string; a missing argument fails."""
        expression = self.column(arguments)["expression"]
        return When(F.coalesce(expression.rlike(r"""^[rbuRBU]{0,2}(['"]).*\1$"""), F.lit(False)))

    def type_is(self, type_fqn: str, types: str = "types", arguments: str = "arguments") -> When:
        """Whether its concrete types agree with the type. ``types``: ``map<expression, array<string>>`` of the call's function.

        Missing argument: fails. No concrete type, or types that disagree with one another: unknown.
        """
        known = F.coalesce(F.try_element_at(F.col(types), self.column(arguments)["expression"]), F.array().cast("array<string>"))
        first = F.get(known, F.lit(0))
        agreed = F.forall(known, lambda t: types_agree(t, first))
        verdict = F.when((F.size(known) == 0) | ~agreed, F.lit(None).cast("boolean")).otherwise(types_agree(first, F.lit(type_fqn)))
        return When(F.when(self.column(arguments).isNull(), F.lit(False)).otherwise(verdict))


def function_types(facts: DataFrame) -> DataFrame:
    """``function``, ``types``: what is known of the types of each function's expressions, for ``ArgRef.type_is``.

    facts: ``function``, ``expression``, ``declared_type``, ``is_concrete``.
    """
    each = facts.where("is_concrete").groupBy("function", "expression").agg(F.array_sort(F.collect_set("declared_type")).alias("_t"))
    return each.groupBy("function").agg(F.map_from_entries(F.collect_list(F.struct("expression", "_t"))).alias("types"))


def restricted(matches: DataFrame, types: DataFrame) -> DataFrame:
    """Call matches (``function``, ``arguments`` and the pattern's columns) with ``outcome``: passed, or unknown, kept with a gap; failed ones go.

    A pattern without a restriction passes. types: rows of ``function_types``.
    """
    rows = matches.join(types, "function", "left")
    named = F.get(F.filter("arguments", lambda a: F.col("keyword").isNotNull() & (a["keyword"] == F.col("keyword"))), F.lit(0))
    placed = F.get(F.filter("arguments", lambda a: a["keyword"].isNull() & (a["position"] == F.col("position"))), F.lit(0))
    argument = F.coalesce(named, placed)
    known = F.coalesce(F.try_element_at("types", argument["expression"]), F.array().cast("array<string>"))
    one = F.get(known, F.lit(0))
    agreed = F.forall(known, lambda t: types_agree(t, one))
    hit = F.exists("when_types", lambda w: types_agree(one, w))
    by_type = F.when(argument.isNull(), F.lit(False)).when((F.size(known) == 0) | ~agreed, F.lit(None).cast("boolean")).otherwise(hit)
    literal = F.coalesce(argument["expression"].rlike(r"""^[rbuRBU]{0,2}(['"]).*\1$"""), F.lit(False))
    test = F.when(F.size("when_types") > 0, by_type).otherwise(F.lit(True)) & F.when(F.col("when_literal").isNotNull(), literal == F.col("when_literal")).otherwise(F.lit(True))
    when = When(test)
    return rows.where(when.keeps()).withColumn("outcome", when.outcome()).drop("types")


def argument_of(matches: DataFrame, arguments: str = "arguments") -> DataFrame:
    """Matches with ``argument``: the text of the argument that the pattern refers to, null without one."""
    named = F.get(F.filter(arguments, lambda a: F.col("keyword").isNotNull() & (a["keyword"] == F.col("keyword"))), F.lit(0))
    placed = F.get(F.filter(arguments, lambda a: a["keyword"].isNull() & (a["position"] == F.col("position"))), F.lit(0))
    return matches.withColumn("argument", F.coalesce(named, placed)["expression"])


# --- joins, one for each kind of fact -----------------------------------------------------------------------------


def receiver_matches(calls: DataFrame, types: DataFrame, ancestors: DataFrame, patterns: DataFrame) -> DataFrame:
    """``site``, ``pattern``: method calls whose receiver's class is, or descends from, the class that a pattern's method belongs to.

    calls: ``site``, ``function``, ``receiver``, ``method``; types: ``function``, ``expression``, ``declared_type``; ancestors: ``root``, ``node`` with
    each class itself; a type that is no class of the code base is its own only ancestor. patterns: ``pattern``, ``fqn``.
    """
    wanted = patterns.select("pattern", owner_of(F.col("fqn")).alias("owner"), short_name(F.col("fqn")).alias("method")).where("owner IS NOT NULL")
    typed = calls.join(types.select("function", F.col("expression").alias("receiver"), "declared_type").distinct(), ["function", "receiver"])
    up = ancestors.select(F.col("root").alias("declared_type"), F.col("node").alias("owner"))
    owners = typed.join(up, "declared_type").select("site", "method", "owner").union(typed.select("site", "method", F.col("declared_type").alias("owner")))
    return owners.distinct().join(wanted, ["owner", "method"]).select("site", "pattern").distinct()


def container_matches(accesses: DataFrame, patterns: DataFrame) -> DataFrame:
    """``site``, ``pattern``, ``key``: keyed accesses on global containers: ``c['k']``, ``c.get('k')`` and ``c.k``, as the pattern allows.

    accesses: ``site``, ``receiver`` (qualified), ``shape`` (subscript, method or attribute), ``name`` (subscript text, method or attribute),
    ``first_argument``.
    """
    hit = accesses.join(patterns.select("pattern", F.col("fqn").alias("receiver"), "access"), "receiver").where(F.array_contains("access", F.col("shape")))
    hit = hit.where((F.col("shape") != "method") | F.col("name").isin(*KEY_METHODS))
    text = F.when(F.col("shape") == "method", F.col("first_argument")).otherwise(F.col("name"))
    return hit.select("site", "pattern", F.regexp_replace(text, r"""^['"]|['"]$""", "").alias("key"))


def parameter_matches(parameters: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``parameter``, ``pattern``: parameters whose default is a call of the pattern's name. parameters: ``function``, ``name``, ``default`` (text),
    ``default_fqn`` (of what it calls)."""
    hit = parameters.join(patterns.select("pattern", F.col("fqn").alias("default_fqn")), "default_fqn")
    return hit.select("function", F.col("name").alias("parameter"), "pattern")


def field_matches(accesses: DataFrame, instances: DataFrame, ancestors: DataFrame, patterns: DataFrame) -> DataFrame:
    """``site``, ``pattern``, ``key``: ``instance.field.attribute`` where the instance's class descends from the pattern's. accesses: ``site``, ``function``, ``target``,
    ``attribute``; instances: ``function``, ``expression``, ``class``; ancestors: ``root``, ``node``."""
    split = accesses.withColumn("expression", owner_of(F.col("target"))).withColumn("key", short_name(F.col("target"))).where("expression IS NOT NULL")
    made = instances.join(ancestors, F.col("class") == F.col("root")).select("function", "expression", F.col("node").alias("fqn"))
    wanted = patterns.select("pattern", "fqn", F.col("name").alias("attribute"))
    return split.join(made, ["function", "expression"]).join(wanted, ["fqn", "attribute"]).select("site", "pattern", "key").distinct()


def symbol_matches(refs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``site``, ``pattern``: references to a pattern's name."""
    return refs.join(patterns.select("pattern", "fqn"), "fqn").select("site", "pattern").distinct()


def class_matches(classes: DataFrame, ancestors: DataFrame, patterns: DataFrame) -> DataFrame:
    """``fqn``, ``pattern``: classes that descend from a pattern's class. ancestors: ``root``, ``node``."""
    up = ancestors.join(patterns.select("pattern", F.col("fqn").alias("node")), "node").select(F.col("root").alias("fqn"), "pattern").distinct()
    return classes.select("fqn").distinct().join(up, "fqn")


def class_view_routes(matches: DataFrame, methods: DataFrame, patterns: DataFrame) -> DataFrame:
    """``fqn``, ``handler``, ``http_method``, ``pattern``: the methods of class views (or hooks of middleware) that a pattern's map names.

    matches: rows of ``class_matches``; methods: ``fqn`` of the class, ``method``, ``defined_in`` (``hierarchy.method_table``).
    """
    listed = patterns.select("pattern", F.explode("methods").alias("method", "http_method"))
    hit = matches.join(listed, "pattern").join(methods, ["fqn", "method"])
    return hit.select("fqn", F.concat("defined_in", F.lit("."), "method").alias("handler"), "http_method", "pattern").distinct()


def guard_lists(assignments: DataFrame, ancestors: DataFrame, patterns: DataFrame) -> DataFrame:
    """``class``, ``guard``, ``pattern``: entries of a class attribute that lists guards, on the class and on what descends from it.

    assignments: ``class``, ``name``, ``value``, in class bodies; ancestors: ``root``, ``node`` with each class itself; patterns: ``name`` (of the
    attribute), ``fqn`` (null, or the base that the class must descend from). The nearest definition is not singled out: a
    list that a base has guards as well.
    """
    entries = F.transform(F.split(F.regexp_replace("value", r"^[\[(]\s*|\s*,?\s*[\])]$", ""), r"\s*,\s*"), lambda e: F.trim(e))
    listed = assignments.select("class", "name", F.explode(F.filter(entries, lambda e: e != "")).alias("guard"))
    anywhere = listed.join(patterns.where("fqn IS NULL").select("pattern", "name"), "name").select("class", "guard", "pattern")
    wanted = patterns.where("fqn IS NOT NULL").select("pattern", "name", F.col("fqn").alias("node"))
    below = ancestors.join(wanted, "node").select(F.col("root").alias("class"), "name", "pattern")
    return anywhere.union(listed.join(below, ["class", "name"]).select("class", "guard", "pattern")).distinct()


def route_entries(lists: DataFrame) -> DataFrame:
    """``list``, ``entry``, ``callee``, ``arguments array<string>``: the calls in list literals. lists: ``list``, ``value`` (text)."""
    parts = lists.select("list", F.explode(details(F.col("value"))["components"]).alias("entry"))
    found = parts.withColumn("_d", details(F.col("entry")))
    inner = F.regexp_replace("entry", r"^[^(]*\(|\)$", "")
    return found.where("_d.call_target IS NOT NULL").select("list", "entry", F.col("_d.call_target").alias("callee"), F.split(inner, r",\s*(?![^(\[]*[)\]])").alias("arguments"))


def imperative_routes(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """``list``, ``path``, ``view``, ``pattern``: entries that call a pattern's name; the view stands at ``position`` or under ``keyword``. entries: rows of
    ``route_entries`` with ``fqn`` of the callee."""
    hit = entries.join(patterns.select("pattern", "fqn", "position", "keyword"), "fqn")
    strip = lambda c: F.regexp_replace(c, r"""^['"]|['"]$""", "")
    named = F.get(F.filter("arguments", lambda a: F.startswith(a, F.concat("keyword", F.lit("=")))), F.lit(0))
    view = F.coalesce(F.substring_index(named, "=", -1), F.get("arguments", F.col("position")))
    return hit.select("list", strip(F.get("arguments", F.lit(0))).alias("path"), view.alias("view"), "pattern")


def router_groups(made: DataFrame, patterns: DataFrame) -> DataFrame:
    """``variable``, ``file``, ``group``, ``prefix``: module variables that hold a route group. made: ``variable``, ``file``, ``fqn`` (of the constructor), ``arguments``;
    patterns: ``position`` of the name, ``keyword`` of the prefix."""
    hit = made.join(patterns.select("fqn", "position", F.col("keyword").alias("_prefix")), "fqn")
    strip = lambda c: F.regexp_replace(c, r"""^['"]|['"]$""", "")
    placed = F.get(F.filter("arguments", lambda a: a["keyword"].isNull() & (a["position"] == F.col("position"))), F.lit(0))["expression"]
    named = F.get(F.filter("arguments", lambda a: a["keyword"] == F.col("_prefix")), F.lit(0))["expression"]
    return hit.select("variable", "file", F.coalesce(strip(placed), F.col("variable")).alias("group"), strip(named).alias("prefix"))


def group_mounts(calls: DataFrame, groups: DataFrame, patterns: DataFrame) -> DataFrame:
    """``parent``, ``child``: groups mounted in others by a call on the parent. calls: ``file``, ``receiver``, ``fqn``, ``arguments``; groups: rows of ``router_groups``."""
    hit = argument_of(calls.join(patterns.select("fqn", "position", "keyword"), "fqn"))
    child = groups.select("file", F.col("variable").alias("argument"), F.col("group").alias("child"))
    parent = groups.select("file", F.col("variable").alias("receiver"), F.col("group").alias("parent"))
    return hit.join(child, ["file", "argument"]).join(parent, ["file", "receiver"]).select("parent", "child").distinct()


def dispatches(calls: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations (``signal``, ``handler``) and emissions (``signal``, ``sender``) of signals; the receiver names the signal. calls: ``function``, ``receiver``, ``fqn``,
    ``arguments``."""
    of = lambda kind: argument_of(calls.join(of_kind(patterns, kind).select("fqn", "position", "keyword"), "fqn"))
    registered = of("register").where("argument IS NOT NULL").select(F.col("receiver").alias("signal"), F.col("argument").alias("handler"))
    return registered.distinct(), of("send").select(F.col("receiver").alias("signal"), F.col("function").alias("sender")).distinct()


def propagations(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges ``function``, ``source_expr``, ``target_expr``, ``line`` from the arguments of library calls to the call itself; a pattern's ``position`` is left out. calls:
    ``function``, ``fqn``, ``expression``, ``line``, ``arguments``."""
    hit = calls.join(patterns.select("fqn", "position"), "fqn").select("function", "expression", "line", "position", F.explode("arguments").alias("a"))
    kept = hit.where("position IS NULL OR a.position IS NULL OR a.position != position")
    return kept.select("function", F.col("a.expression").alias("source_expr"), F.col("expression").alias("target_expr"), "line")


def generated_urls(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``expression``, ``line``, ``safe_kinds``: calls that generate a URL of the application, unless an argument ``_external`` may be true."""
    hit = calls.join(patterns.select("fqn", "safe_kinds"), "fqn")
    external = F.exists("arguments", lambda a: (a["keyword"] == "_external") & (a["expression"] != "False"))
    return hit.where(~F.coalesce(external, F.lit(False))).select("function", "expression", "line", "safe_kinds")


def validations(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``guard`` (the call's text), ``expression`` (what it validates), ``line``, ``safe_kinds``, ``validated_when``: by qualified name, or by the method's name alone.
    A pattern's detail ``false`` says that the value is valid where the guard is false."""
    columns = ["position", "keyword", "safe_kinds", "detail"]
    full = calls.join(patterns.where("fqn IS NOT NULL").select("fqn", *columns), "fqn")
    short = calls.withColumn("name", F.regexp_extract("expression", r"([A-Za-z_]\w*)\(", 1)).join(patterns.where("fqn IS NULL").select("name", *columns), "name")
    both = full.select("function", "expression", "line", "arguments", *columns).union(short.select("function", "expression", "line", "arguments", *columns))
    found = argument_of(both).where("argument IS NOT NULL")
    return found.select("function", F.col("expression").alias("guard"), F.col("argument").alias("expression"), "line", "safe_kinds", (F.coalesce("detail", F.lit("true")) != "false").alias("validated_when")).distinct()


def sink_arguments(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``line``, ``kind``, ``expression``, ``argument``: sinks with the argument that input must not reach; a call without it is none."""
    hit = argument_of(calls.join(patterns.select("fqn", F.col("detail").alias("kind"), "position", "keyword"), "fqn"))
    return hit.where("argument IS NOT NULL").select("function", "line", "kind", "expression", "argument")


def claim_reads(flow: DataFrame, accesses: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``key``, ``line``: keyed reads on what a token exchange returned. flow: ``function``, ``call_name``, ``call_fqn``, ``target``; accesses: ``function``, ``target``, ``key``, ``line``."""
    by_name = flow.join(patterns.where("name IS NOT NULL").select(F.col("name").alias("call_name")).distinct(), "call_name", "left_semi")
    by_fqn = flow.join(patterns.where("fqn IS NOT NULL").select(F.col("fqn").alias("call_fqn")).distinct(), "call_fqn", "left_semi")
    held = by_name.select("function", "target").union(by_fqn.select("function", "target")).distinct()
    return accesses.join(held, ["function", "target"], "left_semi").select("function", "key", "line").distinct()


def check_matches(calls: DataFrame, decorators: DataFrame, method_calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """``function``, ``category``, ``how``: security checks by call, by decorator, and by a method of the receiver's class.

    calls: ``function``, ``fqn``; decorators: ``function``, ``fqn``; method_calls: ``function``, ``pattern`` (``receiver_matches``).
    """
    wanted = lambda kind: of_kind(patterns, kind).select("fqn", F.col("detail").alias("category"))
    parts = [
        calls.join(wanted("call"), "fqn").select("function", "category", F.lit("call").alias("how")),
        decorators.join(wanted("decorator"), "fqn").select("function", "category", F.lit("decorator").alias("how")),
        method_calls.join(of_kind(patterns, "method").select("pattern", F.col("detail").alias("category")), "pattern").select("function", "category", F.lit("method").alias("how")),
    ]
    return reduce(DataFrame.union, parts).distinct()
