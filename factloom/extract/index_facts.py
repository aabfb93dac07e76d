"""The eleven fact families from Python source: one narrow pass with the standard parser.

A fact leaves the workers as ``family``, ``file``, ``ord`` (its place in the file) and ``record``, a JSON object of its
family's schema, so that one pass serves all families; ``family`` reads the records of one.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.facts import FAMILIES
from .control_flow import build, functions_of, module_name, span

SCHEMA = "family string, file string, ord int, record string"
#: Who made the facts.
PROVENANCE = {"producer": "ast", "producer_version": "1", "artifact": "source"}
#: Method names that change a container in place.
MUTATORS = ("append", "add", "update", "pop", "clear", "extend", "insert", "remove", "discard", "setdefault", "popitem")

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST | None) -> str | None:
    """``a.b.c`` of a chain of attributes on a name; null for anything else."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def resolved_module(module: str, package: bool, level: int, named: str | None) -> str:
    """Absolute name of a relative import's module."""
    if not level:
        return named or ""
    parts = module.split(".") if package else module.split(".")[:-1]
    parts = parts[: len(parts) - (level - 1)]
    return ".".join([*parts, *([named] if named else [])])


def pairs_of(target: ast.expr, value: ast.expr) -> list[tuple[ast.expr, ast.expr]]:
    """An unpacking assignment's element pairs, where both sides have as many elements; else the whole."""
    kinds = (ast.Tuple, ast.List)
    if isinstance(target, kinds) and isinstance(value, kinds) and len(target.elts) == len(value.elts) and not any(isinstance(e, ast.Starred) for e in [*target.elts, *value.elts]):
        return [p for t, v in zip(target.elts, value.elts, strict=True) for p in pairs_of(t, v)]
    return [(target, value)]


class Walk(ast.NodeVisitor):
    """Notes the facts of one module, in source order."""

    def __init__(self, file: str, tree: ast.Module) -> None:
        self.file, self.tree = file, tree
        self.module = module_name(file)
        self.package = file.endswith("__init__.py")
        self.scopes: list[tuple[str, str]] = [("module", self.module)]  # kind, qualified name
        self.rows: list[tuple[str, dict]] = []
        self.aliases: dict[str, str] = {}
        self.own = {n.name: f"{self.module}.{n.name}" for n in tree.body if isinstance(n, (*_FUNCTIONS, ast.ClassDef))}
        self.conditional = 0

    # --- places and names -------------------------------------------------------------------------------------

    def note(self, family: str, **record: object) -> None:
        self.rows.append((family, {**record, "provenance": PROVENANCE}))

    @property
    def function(self) -> str | None:
        """The function around; null at a module's or a class body's level."""
        return next((name for kind, name in reversed(self.scopes) if kind == "function"), None) if self.scopes[-1][0] != "class" else None

    @property
    def around_class(self) -> str | None:
        return self.scopes[-1][1] if self.scopes[-1][0] == "class" else None

    def resolve(self, name: str | None) -> str | None:
        """A dotted name by the file's imports, definitions and the class around; null where nothing says."""
        if name is None:
            return None
        head, _, rest = name.partition(".")
        if head in ("self", "cls"):
            owner = next((n for kind, n in reversed(self.scopes) if kind == "class"), None)
            return f"{owner}.{rest}" if owner and rest and "." not in rest else None
        base = self.aliases.get(head) or self.own.get(head)
        if base is None:
            return None
        return f"{base}.{rest}" if rest else base

    def flow(self, source: ast.expr | str, target: ast.expr | str, at: ast.AST, kind: str, **more: object) -> None:
        text = lambda e: e if isinstance(e, str) else ast.unparse(e)
        place = lambda e: span(at if isinstance(e, str) else e, self.file)
        empty = {"callsite_callee_fqn": None, "callsite_expr": None, "argument_position": None, "argument_keyword": None}
        self.note("value_flow_edges", source_expr=text(source), source_location=place(source), target_expr=text(target), target_location=place(target), kind=kind, containing_function_fqn=self.function, **(empty | more))

    # --- definitions ------------------------------------------------------------------------------------------

    def _decorators(self, node: ast.AST, fqn: str) -> None:
        for order, d in enumerate(node.decorator_list):
            call = d if isinstance(d, ast.Call) else None
            name = dotted(call.func if call else d)
            kwargs = [[k.arg, ast.unparse(k.value)] for k in call.keywords if k.arg] if call else []
            self.note("decorators", name=(name or ast.unparse(d)).rpartition(".")[2], fqn=self.resolve(name) or name, args=[ast.unparse(a) for a in call.args] if call else [], kwargs=kwargs, target_fqn=fqn, application_order=order, location=span(d, self.file))
            self.visit(d)

    def _parameters(self, a: ast.arguments) -> list[dict]:
        plain = [*((p, "POSITIONAL_ONLY") for p in a.posonlyargs), *((p, "POSITIONAL_OR_KEYWORD") for p in a.args)]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        listed = [(p, k, d, i) for i, ((p, k), d) in enumerate(zip(plain, defaults, strict=True))]
        listed += [(a.vararg, "VAR_POSITIONAL", None, None)] if a.vararg else []
        listed += [(p, "KEYWORD_ONLY", d, None) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        listed += [(a.kwarg, "VAR_KEYWORD", None, None)] if a.kwarg else []
        text = lambda e: ast.unparse(e) if e is not None else None
        return [{"name": p.arg, "annotation": text(p.annotation), "default": text(d), "kind": k, "position": i, "location": span(p, self.file)} for p, k, d, i in listed]

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        fqn, parent, inside = f"{self.scopes[-1][1]}.{node.name}", self.around_class, self.function
        names = [dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        params = self._parameters(node.args)
        self.note(
            "functions",
            fqn=fqn,
            name=node.name,
            file=self.file,
            line=node.lineno,
            params=params,
            decorator_names=[(n or "?").rpartition(".")[2] for n in names],
            decorator_fqns=[self.resolve(n) or n for n in names],
            kind="METHOD" if parent else "NESTED" if inside else "TOP_LEVEL",
            is_method=parent is not None,
            is_nested=inside is not None and parent is None,
            is_async=isinstance(node, ast.AsyncFunctionDef),
            parent_class=parent,
            parent_function=inside,
            location=span(node, self.file),
        )
        self._decorators(node, fqn)
        for p in params:
            if p["annotation"]:
                self._typed(p["name"], p["annotation"], p["location"], fqn)
        for d in [*node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)]:
            self.visit(d)
        self.scopes.append(("function", fqn))
        for s in node.body:
            self.visit(s)
        self.scopes.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # type: ignore[assignment]

    def visit_Lambda(self, node: ast.Lambda) -> None:
        fqn = f"{self.scopes[-1][1]}.<lambda:{node.lineno}:{node.col_offset}>"
        self.note("functions", fqn=fqn, name="<lambda>", file=self.file, line=node.lineno, params=self._parameters(node.args), decorator_names=[], decorator_fqns=[], kind="LAMBDA", is_method=False, is_nested=self.function is not None, is_async=False, parent_class=None, parent_function=self.function, location=span(node, self.file))
        self.scopes.append(("function", fqn))
        self.visit(node.body)
        self.scopes.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        fqn = f"{self.scopes[-1][1]}.{node.name}"
        bases = [self.resolve(dotted(b)) or dotted(b) or ast.unparse(b) for b in node.bases]
        methods = [s for s in node.body if isinstance(s, _FUNCTIONS)]
        targets = [t for s in node.body for t in (s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else [])]
        abstract = any("abstractmethod" in ast.unparse(d) for m in methods for d in m.decorator_list) or "ABC" in [b.rpartition(".")[2] for b in bases]
        meta = next((ast.unparse(k.value) for k in node.keywords if k.arg == "metaclass"), None)
        self.note("classes", fqn=fqn, name=node.name, file=self.file, bases=bases, mro_chain=[], mro_complete=False, method_names=[m.name for m in methods], class_var_names=[t.id for t in targets if isinstance(t, ast.Name)], is_abstract=abstract, metaclass=meta, subclasses=[], all_subclasses=[], inherited_methods=[], hierarchy_gaps=[], location=span(node, self.file))
        self._decorators(node, fqn)
        for b in [*node.bases, *(k.value for k in node.keywords)]:
            self.visit(b)
        self.scopes.append(("class", fqn))
        for s in node.body:
            self.visit(s)
        self.scopes.pop()

    # --- imports ----------------------------------------------------------------------------------------------

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.aliases[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
            self.note("imports", module=a.name, names=[], aliases=[[a.name, a.asname]] if a.asname else [], is_from_import=False, location=span(node, self.file), is_conditional=self.conditional > 0, is_relative=False)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = resolved_module(self.module, self.package, node.level, node.module)
        for a in node.names:
            if a.name != "*":
                self.aliases[a.asname or a.name] = f"{module}.{a.name}"
                self.note("symbol_refs", name=a.asname or a.name, fqn=f"{module}.{a.name}", resolution="RESOLVED", location=span(node, self.file))
        self.note("imports", module=module, names=[a.name for a in node.names], aliases=[[a.name, a.asname] for a in node.names if a.asname], is_from_import=True, location=span(node, self.file), is_conditional=self.conditional > 0, is_relative=node.level > 0)

    def visit_Try(self, node: ast.Try) -> None:
        self.conditional += 1
        self.generic_visit(node)
        self.conditional -= 1

    def visit_If(self, node: ast.If) -> None:
        self.visit(node.test)
        self.conditional += 1
        for s in [*node.body, *node.orelse]:
            self.visit(s)
        self.conditional -= 1

    # --- expressions ------------------------------------------------------------------------------------------

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        fqn = self.resolve(name)
        if fqn is None and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call) and dotted(node.func.value.func) == "super":
            fqn = None  # the hierarchy pass says whose method it is
        given = [{"position": i, "keyword": None, "expression": ast.unparse(a), "location": span(a, self.file)} for i, a in enumerate(node.args)]
        given += [{"position": None, "keyword": k.arg, "expression": ast.unparse(k.value), "location": span(k.value, self.file)} for k in node.keywords]
        receiver = node.func.value if isinstance(node.func, ast.Attribute) else None
        self.note(
            "call_edges",
            caller_fqn=self.function or "<module>",
            callee_fqn=fqn,
            arguments=given,
            resolution="RESOLVED" if fqn else "UNRESOLVED",
            source="AST",
            unresolved_reason=None if fqn else "unknown name" if name else "computed target",
            location=span(node, self.file),
            call_expression=ast.unparse(node),
            dynamic_dispatch_kind=None if name or receiver is not None else "call_result",
            receiver_expression=ast.unparse(receiver) if receiver is not None else None,
            receiver_location=span(receiver, self.file) if receiver is not None else None,
        )
        for a in given:
            self.flow(a["expression"], ast.unparse(node), node, "TRANSFORM_INPUT", callsite_callee_fqn=fqn, callsite_expr=ast.unparse(node), argument_position=a["position"], argument_keyword=a["keyword"])
        if isinstance(node.func, ast.Attribute) and node.func.attr in MUTATORS and dotted(node.func.value):
            self._access(node.func.value, node.func.attr, True, "CALL_MUTATOR", node, given[0]["expression"] if given else None)
        self.generic_visit(node)

    def _access(self, target: ast.expr, name: str, write: bool, kind: str, node: ast.AST, value: str | None = None) -> None:
        self.note("attributes", target_expr=ast.unparse(target), attr_name=name, is_write=write, access_kind=kind, value_expr=value, containing_function_fqn=self.function, location=span(node, self.file))

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self._access(node.value, node.attr, not isinstance(node.ctx, ast.Load), "DEL" if isinstance(node.ctx, ast.Del) else "ATTR", node, getattr(node, "_assigned", None))
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        self._access(node.value, ast.unparse(node.slice), not isinstance(node.ctx, ast.Load), "DEL" if isinstance(node.ctx, ast.Del) else "SUBSCRIPT", node, getattr(node, "_assigned", None))
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            fqn = self.resolve(node.id)
            self.note("symbol_refs", name=node.id, fqn=fqn, resolution="RESOLVED" if fqn else "UNRESOLVED", location=span(node, self.file))

    # --- value flow -------------------------------------------------------------------------------------------

    def _assigned(self, target: ast.expr, value: ast.expr, node: ast.AST, kind: str) -> None:
        pairs = pairs_of(target, value)
        for t, v in pairs:
            for part in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                part = part.value if isinstance(part, ast.Starred) else part
                part._assigned = ast.unparse(v)  # type: ignore[attr-defined]  what the access below writes
                unpacked = len(pairs) > 1 or part is not t
                self.flow(v, part, node, "ATTRIBUTE_WRITE" if isinstance(part, ast.Attribute) else "UNPACK" if unpacked else kind)
                if isinstance(v, ast.Call) and (made := self.resolve(dotted(v.func))) and made.rpartition(".")[2][:1].isupper():
                    self._typed(ast.unparse(part), made, span(part, self.file), self.function, "constructor")

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self._assigned(t, node.value, node, "CHAIN" if len(node.targets) > 1 else "ALIAS" if dotted(node.value) else "ASSIGN")
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._typed(ast.unparse(node.target), ast.unparse(node.annotation), span(node.target, self.file), self.function)
        if node.value is not None:
            self._assigned(node.target, node.value, node, "ANNOTATED_ASSIGN")
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.flow(node.value, node.target, node, "AUGMENTED_ASSIGN")
        self.generic_visit(node)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._assigned(node.target, node.value, node, "ASSIGN")
        self.generic_visit(node)

    def visit_For(self, node: ast.For | ast.AsyncFor) -> None:
        self._assigned(node.target, node.iter, node.target, "UNPACK")
        self.generic_visit(node)

    visit_AsyncFor = visit_For  # type: ignore[assignment]

    def visit_With(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            if item.optional_vars is not None:
                self._assigned(item.optional_vars, item.context_expr, item.context_expr, "ASSIGN")
        self.generic_visit(node)

    visit_AsyncWith = visit_With  # type: ignore[assignment]

    def visit_comprehension(self, node: ast.comprehension) -> None:
        self.flow(node.iter, node.target, node.target, "COMPREHENSION_BINDING")
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None:
            self.flow(node.value, "return", node, "RETURN")
        self.generic_visit(node)

    def visit_Yield(self, node: ast.Yield | ast.YieldFrom) -> None:
        if node.value is not None:
            self.flow(node.value, "yield", node, "YIELD")
        self.generic_visit(node)

    visit_YieldFrom = visit_Yield  # type: ignore[assignment]

    def _typed(self, expression: str, declared: str, location: dict, function: str | None, tool: str = "annotation") -> None:
        head = declared.partition("[")[0]
        name = self.resolve(head) or head if tool == "annotation" and "[" not in declared and "|" not in declared else declared
        self.note("type_enrichment", expression=expression, declared_type=name, location=location, source_tool=tool, is_concrete=head not in ("Any", "object"), containing_function_fqn=function)


def records_of(file: str, source: str) -> Iterator[tuple[str, dict]]:
    """(family, record) of a file in source order; a file that does not parse is one fatal error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        line = getattr(e, "lineno", None)
        where = {"file": file, "line": line, "column": None, "end_line": line, "end_column": None} if line else None
        yield "errors", {"file": file, "pass_name": "parse", "error_kind": "PARSE", "message": str(e), "is_fatal": True, "location": where, "aborts_pipeline": False}
        return
    walk = Walk(file, tree)
    walk.visit(tree)
    yield from walk.rows
    for name, node in functions_of(file, tree):
        yield "cfgs", build(node, file).record(name)


def extract_records(files: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """``SCHEMA`` of all files; a null source counts as empty. Rows of one file stay together and in order."""
    rows = files.select(F.col(file), F.coalesce(F.col(source), F.lit("")))
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part, out = batch.slice(at, 50), []
                for f, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    out += [(family, f or "", n, json.dumps(record)) for n, (family, record) in enumerate(records_of(f or "", s))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["family", "file", "ord", "record"])

    return rows.mapInArrow(run, SCHEMA)


def family(records: DataFrame, name: str) -> DataFrame:
    """The records of one family under its schema, with ``ord`` where the schema lacks it."""
    parsed = F.from_json("record", FAMILIES[name], {"mode": "FAILFAST"})
    return records.where(F.col("family") == name).select(parsed.alias("r"), "ord").select("r.*", "ord")
