"""Control-flow graphs of functions from Python source: basic blocks with their statements, labelled edges, try regions."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "graph string, file string, src int, dst int, label string, line int"
ENTRY, EXIT = 0, 1

_PREDICATES = (ast.Compare, ast.BoolOp)


def span(node: ast.AST, file: str) -> dict:
    """Where a node stands; lines count from 1, columns from 0."""
    return {"file": file, "line": node.lineno, "column": node.col_offset, "end_line": node.end_lineno, "end_column": node.end_col_offset}


@dataclass
class Block:
    id: int
    statements: list[dict] = field(default_factory=list)
    condition: ast.expr | None = None
    predicates: list[dict] = field(default_factory=list)
    line: int | None = None


@dataclass
class _Finally:
    """A finally body under construction: its first block, and where control goes on behind it besides the next statement."""

    entry: int
    onward: list[tuple[str | None, int, int]] = field(default_factory=list)  # label, target, frames that the jump still leaves


class Builder:
    """Lowers one function. Block 0 is the entry, 1 the exit; ``edges`` are (from, to, label).

    Labels: true and false out of conditions and loops, except out of each block of a try body into its handlers,
    raise, return, else null. What leaves a try with a finally body goes through that body.
    """

    def __init__(self, file: str = "") -> None:
        self.file = file
        self.edges: list[tuple[int, int, str | None]] = []
        self.blocks = [Block(ENTRY), Block(EXIT)]
        self.loops: list[tuple[int, int, int]] = []  # head, behind, finally frames around the loop
        self.handlers: list[tuple[list[int], int]] = []  # targets of a raise, finally frames around them
        self.frames: list[_Finally] = []
        self.regions: list[dict] = []

    @property
    def lines(self) -> dict[int, int]:
        return {b.id: b.line for b in self.blocks if b.line is not None}

    def block(self, line: int | None = None) -> int:
        self.blocks.append(Block(len(self.blocks), line=line))
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int, label: str | None = None) -> None:
        if a is not None:
            self.edges.append((a, b, label))

    def jump(self, at: int, label: str | None, target: int, outside: int) -> None:
        """To the target, through the finally bodies above ``outside`` frames."""
        if len(self.frames) > outside:
            frame = self.frames[-1]
            self.edge(at, frame.entry, label)
            frame.onward.append((label, target, outside))
        else:
            self.edge(at, target, label)

    def body(self, statements: list[ast.stmt], at: int | None) -> int | None:
        """The block behind the statements; None if control does not get there."""
        for s in statements:
            if at is None:
                at = self.block(s.lineno)  # dead code keeps its blocks
            block = self.blocks[at]
            block.line = s.lineno if block.line is None else block.line
            at = self.statement(s, at)
        return at

    def _note(self, s: ast.stmt, at: int) -> None:
        """The statement belongs to the block, with the comparisons in it that decide no branch."""
        block = self.blocks[at]
        block.statements.append(span(s, self.file))
        values = [v for v in (getattr(s, "value", None), getattr(s, "test", None)) if isinstance(v, ast.expr)]
        position = {ast.Return: "return", ast.Assign: "assign", ast.AnnAssign: "assign"}.get(type(s), "expression")
        for v in values:
            for node in ast.walk(v):
                if isinstance(node, _PREDICATES):
                    block.predicates.append({"expression": ast.unparse(node), "location": span(node, self.file), "position": position})

    def statement(self, s: ast.stmt, at: int) -> int | None:
        if isinstance(s, ast.If):
            return self._if(s, at)
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            return self._loop(s, at)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            self._note(s, at)
            return self.body(s.body, at)
        if isinstance(s, (ast.Try, ast.TryStar)):
            return self._try(s, at)
        if isinstance(s, ast.Match):
            return self._match(s, at)
        self._note(s, at)
        if isinstance(s, ast.Return):
            self.jump(at, "return", EXIT, 0)
            return None
        if isinstance(s, ast.Raise):
            targets, outside = self.handlers[-1] if self.handlers else ([EXIT], 0)
            for t in targets:
                self.jump(at, "raise", t, outside)
            return None
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            head, behind, outside = self.loops[-1]
            self.jump(at, None, behind if isinstance(s, ast.Break) else head, outside)
            return None
        return at

    def _reached(self, block: int) -> int | None:
        return block if any(b == block for _, b, _ in self.edges) else None

    def _if(self, s: ast.If, at: int) -> int | None:
        self.blocks[at].condition = s.test
        yes, after = self.block(s.body[0].lineno), self.block()
        self.edge(at, yes, "true")
        self.edge(self.body(s.body, yes), after)
        if s.orelse:
            no = self.block(s.orelse[0].lineno)
            self.edge(at, no, "false")
            self.edge(self.body(s.orelse, no), after)
        else:
            self.edge(at, after, "false")
        return self._reached(after)

    def _loop(self, s: ast.While | ast.For | ast.AsyncFor, at: int) -> int | None:
        head, inside, after = self.block(s.lineno), self.block(s.body[0].lineno), self.block()
        self.blocks[head].condition = s.test if isinstance(s, ast.While) else None
        if not isinstance(s, ast.While):
            self.blocks[head].statements.append(span(s, self.file))
        self.edge(at, head)
        self.edge(head, inside, "true")
        self.loops.append((head, after, len(self.frames)))
        self.edge(self.body(s.body, inside), head)
        self.loops.pop()
        endless = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
        if s.orelse:  # runs when the condition fails; a break skips it
            other = self.block(s.orelse[0].lineno)
            self.edge(head, other, "false")
            self.edge(self.body(s.orelse, other), after)
        elif not endless:
            self.edge(head, after, "false")
        return self._reached(after)

    def _match(self, s: ast.Match, at: int) -> int | None:
        self.blocks[at].condition = s.subject
        after, open_ = self.block(), True
        for case in s.cases:
            arm = self.block(case.body[0].lineno)
            self.edge(at, arm, "true")
            self.edge(self.body(case.body, arm), after)
            if isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None and case.guard is None:
                open_ = False  # a wildcard: nothing falls through
        if open_:
            self.edge(at, after, "false")
        return self._reached(after)

    def _try(self, s: ast.Try, at: int) -> int | None:
        first, after = self.block(s.body[0].lineno), self.block()
        self.edge(at, first)
        frame = _Finally(self.block(s.finalbody[0].lineno)) if s.finalbody else None
        if frame:
            self.frames.append(frame)
        depth = len(self.frames)
        handlers = [self.block(h.body[0].lineno) for h in s.handlers]
        outer = self.handlers[-1] if self.handlers else ([EXIT], 0)
        self.handlers.append((handlers, depth) if handlers else outer)
        start = len(self.blocks)
        end = self.body(s.body, first)
        inside = [first, *range(start, len(self.blocks))]
        self.handlers.pop()
        for block in inside:
            for h in handlers:
                self.edge(block, h, "except")
            if not handlers:
                for target in outer[0]:
                    self.jump(block, "except", target, outer[1])
        other = None
        if s.orelse and end is not None:
            other = self.block(s.orelse[0].lineno)
            self.edge(end, other)
            end = self.body(s.orelse, other)
        ends = [end, *(self.body(h.body, block) for h, block in zip(s.handlers, handlers, strict=True))]
        if frame:
            self.frames.pop()
        for e in ends:
            self.edge(e, frame.entry if frame else after)
        if frame:
            last = self.body(s.finalbody, frame.entry)
            if last is not None:
                if any(e is not None for e in ends):
                    self.edge(last, after)
                for label, target, outside in dict.fromkeys(frame.onward):
                    self.jump(last, label, target, outside)
        kinds = lambda h: [] if h.type is None else [ast.unparse(t) for t in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])]
        self.regions.append(
            {
                "try_body_block_ids": inside,
                "handlers": [{"exception_types": kinds(h), "entry_block_id": b, "name": h.name} for h, b in zip(s.handlers, handlers, strict=True)],
                "finally_block_id": frame.entry if frame else None,
                "else_block_id": other,
                "location": span(s, self.file),
            }
        )
        return self._reached(after)

    def record(self, fqn: str) -> dict:
        """The graph as a row of the family ``cfgs``."""
        edges = list(dict.fromkeys(self.edges))
        after: dict[int, list[int]] = {b.id: [] for b in self.blocks}
        before: dict[int, list[int]] = {b.id: [] for b in self.blocks}
        for a, b, _ in edges:
            if b not in after[a]:
                after[a].append(b)
                before[b].append(a)
        blocks = [
            {
                "id": b.id,
                "statements": b.statements,
                "successors": after[b.id],
                "predecessors": before[b.id],
                "condition_expr": ast.unparse(b.condition) if b.condition is not None else None,
                "condition_location": span(b.condition, self.file) if b.condition is not None else None,
                "value_predicates": b.predicates,
            }
            for b in self.blocks
        ]
        listed = [{"source_id": a, "target_id": b, "label": label, "is_exceptional": label in ("except", "raise")} for a, b, label in edges]
        return {"fqn": fqn, "file": self.file, "blocks": blocks, "edges": listed, "try_regions": self.regions}


def build(node: ast.FunctionDef | ast.AsyncFunctionDef, file: str) -> Builder:
    """The graph of one function."""
    made = Builder(file)
    made.blocks[ENTRY].line = node.lineno
    made.edge(made.body(node.body, ENTRY), EXIT)
    return made


def module_name(file: str) -> str:
    return file.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def functions_of(file: str, tree: ast.Module) -> Iterator[tuple[str, ast.AST]]:
    """(qualified name, node) of each function of a module."""
    todo: list[tuple[str, ast.AST]] = [(module_name(file), tree)]
    while todo:
        prefix, node = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}.{child.name}"
                if not isinstance(child, ast.ClassDef):
                    yield name, child
                todo.append((name, child))
            else:
                todo.append((prefix, child))


def graphs_of(file: str, source: str) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for each function of a file; a file that does not parse has none (its error is a fact)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    for name, node in functions_of(file, tree):
        made = build(node, file)
        lines = made.lines
        yield from ((name, file, a, b, label, lines.get(a)) for a, b, label in dict.fromkeys(made.edges))


def control_flow(files: DataFrame, file: str = "file", source: str = "source") -> DataFrame:
    """Edges of all functions' graphs, in one narrow pass; a null source counts as empty."""
    rows = files.select(F.col(file), F.coalesce(F.col(source), F.lit("")))
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [r for f, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in graphs_of(f or "", s)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
