"""Graph operators: bounded closures by frontier, hierarchies, and per-function control flow.

A closure over a graph that is small (``LOCAL_EDGES``, or ``DENSE_EDGES`` between few nodes, counted first) sends the graph to
the tasks, which walk it root by root; edges are counted as they come, and shuffled for their repetitions only beyond that. A larger one is a driver loop over frames: each level joins the frontier with the edges and drops what is known, so
cycles and many paths cost nothing. Levels are tables in the shared folder, which survive lost executors.
Control-flow graphs are small and many: their algorithms run inside pandas groups dealt by a hash bucket, never
one group per function.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct edges up to which a graph goes to every task (2 or 4 bytes each, twice where a task asks backward, and the names of its nodes once).
LOCAL_EDGES = 2_000_000
#: The same for a graph of few nodes, whose edges travel as numbers: 2 bytes each up to 65,536 nodes, 4 beyond, ``DENSE_BYTES`` in all.
DENSE_EDGES, DENSE_NODES, DENSE_BYTES = 48_000_000, 200_000, 96_000_000
#: Edges that are ordered at once.
PART = 1 << 20


def _shared(spark: SparkSession, name: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get()
    folder = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)  # results are lazy: the levels stay as long as the driver
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone when the driver ends
        pass


class Levels:
    """Tables of a loop in the shared folder: those added are its result so far; ``last_count`` is the newest one's size."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.paths, self.last_count = spark, _shared(spark, name), [], 0
        self._schema = None
        self._kept = 0

    def _write(self, df: DataFrame, path: str) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return seen.get["n"]

    def keep(self, df: DataFrame) -> DataFrame:
        """A table beside the levels."""
        self._kept += 1
        path = f"{self.at}/kept{self._kept}"
        self.last_count = self._write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Deletes the tables beside the levels but the newest."""
        for i in range(1, self._kept):
            _delete(self.spark, f"{self.at}/kept{i}")

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/level{len(self.paths)}"
        self._schema = df.schema
        self.last_count = self._write(df, path)
        self.paths.append(path)
        return self.spark.read.schema(self._schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(*self.paths)


def closure(edges: DataFrame, roots: DataFrame, max_depth: int, include_root: bool = False, local_edges: int = LOCAL_EDGES, dense_edges: int = DENSE_EDGES) -> DataFrame:
    """``root``, ``node``, ``depth``: what each root reaches over ``src`` -> ``dst`` within ``max_depth`` levels.

    ``depth`` is the least number of edges. The root itself is left out even on cycles, or comes with depth 0 if
    ``include_root``. Null ends are no edges. Ends early when a level finds nothing.
    """
    levels = Levels(edges.sparkSession, "closure")
    links = levels.keep(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    start = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    near, given = _held(links, levels.last_count, local_edges, dense_edges), levels.last_count
    if near is None:  # only what is too large as it comes is shuffled for its repetitions; too many nodes stay too many
        links = levels.keep(links.distinct())
        levels.forget()
        near = _held(links, levels.last_count, local_edges, dense_edges if given > min(dense_edges, DENSE_BYTES // 4) else 0)
    if near is not None:
        found = _walked(near, start, max_depth)
    else:
        frontier = levels.add(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
        for depth in range(1, max_depth + 1):
            new = frontier.join(links, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            new = new.join(levels.all().select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
            frontier = levels.add(new)
            if not levels.last_count:
                break
        found = levels.all()
    return found if include_root else found.where("depth > 0")


def _held(links: DataFrame, count: int, local_edges: int, dense_edges: int) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """The neighbours, if the tasks can hold as many edges."""
    if count <= local_edges:
        return _neighbours(links)
    if count > dense_edges:
        return None
    few = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct().limit(DENSE_NODES + 1).toArrow().column(0).combine_chunks()
    return _numbered(links, few) if len(few) <= DENSE_NODES and count * _kind(len(few))().itemsize <= DENSE_BYTES else None


def _neighbours(links: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names of nodes; where each one's neighbours begin; the neighbours, as numbers of names."""
    table = links.toArrow()
    ends = pa.chunked_array([*table.column("src").chunks, *table.column("dst").chunks], table.schema.field(0).type)
    coded = ends.combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return _listed(coded.dictionary, codes[: len(table)] * len(coded.dictionary) + codes[len(table) :])


def _kind(n: int) -> type[np.generic]:
    return np.uint16 if n <= 1 << 16 else np.int32


def _numbered(links: DataFrame, names: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As ``_neighbours``, for nodes already known: the tasks number and order the edges, and the driver holds each as the number of
    its target only. Edges of different parts may repeat."""
    n, sent = len(names), links.sparkSession.sparkContext.broadcast(names)
    kind = _kind(n)

    def part(edges: list[np.ndarray]) -> pa.RecordBatch:
        src, dst = np.divmod(np.unique(np.concatenate(edges)), n)
        nodes, counts = np.unique(src, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (nodes.astype(np.int32), counts.astype(np.int32), dst.astype(kind))], names=["nodes", "counts", "targets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, size = [], 0
        for batch in batches:
            src, dst = (pc.index_in(batch.column(i), sent.value).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            edges.append(src * n + dst)
            size += len(src)
            if size >= PART:
                yield part(edges)
                edges, size = [], 0
        if size:
            yield part(edges)

    table = links.select("src", "dst").mapInArrow(run, "nodes binary, counts binary, targets binary").toArrow()
    parts = [tuple(np.frombuffer(table.column(i)[k].as_buffer(), t) for i, t in enumerate((np.int32, np.int32, kind))) for k in range(len(table))]
    degree = np.zeros(n, np.int64)
    for nodes, counts, _ in parts:
        degree[nodes] += counts
    first = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32)
    return names, first, _filled(first, parts, kind)


def _filled(first: np.ndarray, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: type[np.generic]) -> np.ndarray:
    """The nodes' lists, which begin at ``first``, out of parts: nodes, how many neighbours of each are in the part, and those in a row."""
    at, out = first[:-1].astype(np.int64), np.empty(int(first[-1]), kind)
    for nodes, counts, near in parts:
        out[np.repeat(at[nodes] - (np.cumsum(counts) - counts), counts) + np.arange(len(near))] = near
        at[nodes] += counts
    return out


def _into(after: np.ndarray, n: int) -> np.ndarray:
    """How many edges lead into each node."""
    into = np.zeros(n, np.int64)
    for at in range(0, len(after), PART):
        into += np.bincount(after[at : at + PART], minlength=n)
    return into


def _reversed(first: np.ndarray, after: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's lists of nodes before it begin, and the lists."""
    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(after), PART):
            some = after[at : at + PART]
            source = np.searchsorted(first, np.arange(at, at + len(some)), side="right") - 1
            order = np.argsort(some, kind="stable")
            nodes, counts = np.unique(some, return_counts=True)
            yield nodes, counts, source[order]

    start = np.concatenate([[0], np.cumsum(into)])
    return start, _filled(start, parts(), after.dtype.type)


def _listed(names: pa.Array, edges: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``_neighbours`` out of edges as numbers (source times nodes, plus target), which may repeat and are overwritten."""
    n = len(names)
    edges.sort()
    again = edges[1:] == edges[:-1]
    if again.any():
        edges = edges[np.concatenate([[True], ~again])]
    first = np.searchsorted(edges, np.arange(n + 1) * n).astype(np.int32)
    if n:
        np.remainder(edges, n, out=edges)
    return names, first, edges.astype(_kind(n))


def _spread(lists: np.ndarray, first: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The nodes' lists, one after the other."""
    counts = first[nodes + 1] - first[nodes]
    shift = first[nodes] - (np.cumsum(counts) - counts)
    return lists[np.repeat(shift, counts) + np.arange(int(counts.sum()))]


def _asked(known: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unknown nodes with a known one before them: a few are asked one by one, then all that are left."""
    rest = np.flatnonzero(~known & (first[1:] > first[:-1]))
    found, at = [], first[rest]
    for _ in range(16):
        met = known[before[at]]
        found.append(rest[met])
        more = ~met & (at + 1 < first[rest + 1])
        rest, at = rest[more], at[more] + 1
        if not len(rest):
            break
    else:
        starts = np.cumsum(np.concatenate([[0], first[rest + 1] - first[rest]]))[:-1]
        found.append(rest[np.logical_or.reduceat(known[_spread(before, first, rest)], starts)])
    return np.sort(np.concatenate(found))


def _walked(near: tuple[pa.Array, np.ndarray, np.ndarray], roots: DataFrame, max_depth: int) -> DataFrame:
    """The closure, root by root, over a graph that every task holds as a list of neighbours.

    A level follows the edges out of the newest nodes, or where fewer lead into unknown nodes asks those.
    """
    spark = roots.sparkSession
    graph = spark.sparkContext.broadcast(near)
    kind = roots.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, after = graph.value
        known = np.zeros(len(names), bool)
        degree, into = np.diff(first), _into(after, len(names))
        back = None
        for batch in batches:
            here = pc.index_in(batch.column(0), names).to_pylist() if len(names) else [None] * batch.num_rows
            for i, code in enumerate(here):
                root = batch.column(0).slice(i, 1)
                if code is None:
                    yield pa.RecordBatch.from_arrays([root, root, pa.array([0], pa.int32())], names=["root", "node", "depth"])
                    continue
                found = [np.array([code])]
                known[code] = True
                left = len(after) - int(into[code])  # edges into unknown nodes
                for depth in range(1, max_depth + 1):
                    frontier = found[-1]
                    ways = int(degree[frontier].sum())
                    if not ways or not left:
                        break
                    if left < ways:
                        if back is None:
                            back = _reversed(first, after, into)
                        frontier = _asked(known, *back)
                    else:
                        new = _spread(after, first, frontier)
                        if len(new) * 16 > len(names):  # marks are cheaper than sorting where much of the graph is met
                            met = np.zeros(len(names), bool)
                            met[new] = True
                            frontier = np.flatnonzero(met & ~known)
                        else:
                            frontier = np.unique(new[~known[new]]).astype(np.int64)
                    if not len(frontier):
                        break
                    known[frontier] = True
                    left -= int(into[frontier].sum())
                    found.append(frontier)
                nodes = np.concatenate(found)
                depths = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
                known[nodes] = False
                for at in range(0, len(nodes), 50_000):
                    part = nodes[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.repeat(root[0], len(part)), names.take(pa.array(part)), pa.array(depths[at : at + 50_000])], names=["root", "node", "depth"])

    dealt = roots.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, f"root {kind}, node {kind}, depth int")


#: Pairs of a root and a node of its graph that are marked at once.
MARKS = 4_000_000


def goals_within(edges: DataFrame, max_depth: int) -> DataFrame:
    """``graph``, ``root``, ``node``: the goals that each root reaches within its graph by ``max_depth`` edges, itself included.

    edges: ``graph``, ``src``, ``dst``, ``asked`` (``src`` is a root), ``goal`` (``dst`` is a goal); a row without ``src`` only names a
    goal. Whole graphs are walked together, as many as a part holds; a graph's edges lie in one task, its pairs in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) >= PART // 4 and held.column("graph")[0] != held.column("graph")[-1]:
                graphs = held.column("graph")
                whole = pc.index(graphs, graphs[-1]).as_py()  # rows come sorted by graph
                yield from _goals(held.slice(0, whole), max_depth)
                held = held.slice(whole)
        if held is not None and len(held):
            yield from _goals(held, max_depth)

    text = [F.col(c).cast("string").alias(c) for c in ("graph", "src", "dst")]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("asked", "goal")]
    rows = edges.where("graph IS NOT NULL AND dst IS NOT NULL").select(*text, *flags).repartition("graph").sortWithinPartitions("graph")
    return rows.mapInArrow(run, "graph string, root string, node string")


def _goals(rows: pa.Table, max_depth: int) -> Iterator[pa.RecordBatch]:
    """``goals_within`` over whole graphs, level by level for many roots at once."""
    graphs, size = rows.column("graph").combine_chunks(), len(rows)
    asked, goal, edge = (c.to_numpy() for c in (rows.column("asked"), rows.column("goal"), pc.is_valid(rows.column("src"))))
    head = np.concatenate([[True], pc.not_equal(graphs[1:], graphs[:-1]).to_numpy(zero_copy_only=False)])
    heads, number = np.flatnonzero(head), np.cumsum(head) - 1
    coded = pa.chunked_array([*rows.column("src").chunks, *rows.column("dst").chunks], pa.string()).combine_chunks().dictionary_encode()
    words = len(coded.dictionary)
    codes = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.concatenate([edge, np.ones(size, bool)])
    nodes, at = np.unique((np.concatenate([number, number]) * words + codes)[keep], return_inverse=True)
    src, dst = at[: int(edge.sum())], at[int(edge.sum()) :]
    n = len(nodes)
    goals = np.zeros(n, bool)
    goals[dst[goal]] = True
    links = np.unique(src * n + dst[edge])
    first, after = np.searchsorted(links, np.arange(n + 1) * n), links % n
    begin = np.searchsorted(nodes, np.arange(len(heads) + 1) * words)  # each graph's nodes lie side by side
    roots = np.unique(src[asked[edge]])
    of = nodes[roots] // words
    ends = np.cumsum(begin[of + 1] - begin[of])
    low = 0
    while low < len(roots):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + MARKS, side="right")))
        shift = np.concatenate([[0], ends[low : high - 1] - done]) - begin[of[low:high]]
        known = np.zeros(int(ends[high - 1] - done), bool)
        which, spot = np.arange(high - low), roots[low:high] + shift
        known[spot] = True
        for _ in range(max_depth):
            here = spot - shift[which]
            which = np.repeat(which, first[here + 1] - first[here])
            spot = _spread(after, first, here) + shift[which]
            new = np.flatnonzero(~known[spot])
            spot, some = np.unique(spot[new], return_index=True)
            if not len(spot):
                break
            which = which[new[some]]
            known[spot] = True
        found = np.flatnonzero(known)
        which = np.searchsorted(ends[low:high] - done, found, side="right")
        found = found - shift[which]
        hit = goals[found]
        found, which = found[hit], which[hit] + low
        for k in range(0, len(found), 50_000):
            root, node = roots[which[k : k + 50_000]], found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([graphs.take(pa.array(heads[nodes[root] // words])), *(coded.dictionary.take(pa.array(nodes[x] % words)) for x in (root, node))], names=["graph", "root", "node"])
        low = high


def degrees(edges: DataFrame) -> DataFrame:
    """``node``, ``n_callees``, ``n_callers`` over distinct edges, in one pass."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select("src", "dst").distinct().select(F.inline(ends)).groupBy("node").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"))


def entries_and_exits(edges: DataFrame) -> DataFrame:
    """``graph``, ``entry``: the least block without predecessors; ``n_exits``: blocks without successors."""
    ends = F.array(F.struct(F.col("src").alias("b"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("b"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    blocks = edges.select("graph", F.inline(ends)).groupBy("graph", "b").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return blocks.groupBy("graph").agg(F.min(F.when(F.col("i") == 0, F.col("b"))).alias("entry"), F.sum((F.col("o") == 0).cast("int")).alias("n_exits"))


def _reach(start: str, after: dict[str, set[str]], without: str | None = None) -> set[str]:
    seen, todo = {start} - {without}, [start] if start != without else []
    while todo:
        for x in after.get(todo.pop(), ()):
            if x not in seen and x != without:
                seen.add(x)
                todo.append(x)
    return seen


def dominator_sets(entry: str, after: dict[str, set[str]]) -> dict[str, set[str]]:
    """For each block reachable from the entry, the blocks on every path to it, itself included."""
    order: list[str] = []
    seen = {entry}
    stack = [(entry, iter(sorted(after.get(entry, ()))))]
    while stack:
        block, rest = stack[-1]
        for x in rest:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(sorted(after.get(x, ())))))
                break
        else:
            order.append(block)
            stack.pop()
    order.reverse()
    before: dict[str, set[str]] = {b: set() for b in order}
    for b in order:
        for x in after.get(b, ()):
            before[x].add(b)
    dom = {b: set(order) for b in order}
    dom[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = set.intersection(*(dom[p] for p in before[b])) | {b}
            if new != dom[b]:
                dom[b], changed = new, True
    return dom


def immediate_dominators(entry: str, dom: dict[str, set[str]]) -> dict[str, str]:
    return {b: max(d - {b}, key=lambda x: len(dom[x])) if b != entry else entry for b, d in dom.items()}


def _entry(blocks: set[str], after: dict[str, set[str]]) -> str | None:
    free = blocks - set().union(*after.values()) if after else blocks
    return min(free) if free else None


def _dominators(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    if (entry := _entry(blocks, after)) is not None:
        for b, d in dominator_sets(entry, after).items():
            yield from ((b, x) for x in d)


def _post_dominators(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    back: dict[str, set[str]] = {}
    for a, bs in after.items():
        for b in bs:
            back.setdefault(b, set()).add(a)
    back["\0"] = {b for b in blocks if not after.get(b)}
    for b, d in dominator_sets("\0", back).items():
        if b != "\0":
            yield from ((b, x) for x in d if x != "\0")


def _frontier(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    entry = _entry(blocks, after)
    if entry is None:
        return
    dom = dominator_sets(entry, after)
    for b in dom:
        for s in after.get(b, ()):
            yield from ((x, s) for x in dom[b] if x not in dom[s] or x == s)


def _loops(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    entry = _entry(blocks, after)
    if entry is None:
        return
    dom = dominator_sets(entry, after)
    back: dict[str, set[str]] = {}
    for a in dom:
        for b in after.get(a, ()):
            back.setdefault(b, set()).add(a)
    bodies: dict[str, set[str]] = {}
    for a in dom:
        for header in after.get(a, ()):
            if header in dom[a]:
                body = bodies.setdefault(header, {header})
                body |= _reach(a, back, without=header)
    for header, body in bodies.items():
        yield from ((header, b) for b in body)


def _immediate(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    entry = _entry(blocks, after)
    if entry is not None:
        yield from ((b, x) for b, x in immediate_dominators(entry, dominator_sets(entry, after)).items() if b != entry)


def _reaching(after: dict[str, set[str]], blocks: set[str]) -> Iterator[tuple[str, str]]:
    for b in blocks:
        for x in after.get(b, ()):
            yield from ((b, y) for y in _reach(x, after))


#: Per-graph relations by name; each gives pairs (block, other).
PER_GRAPH = {"dominators": _dominators, "immediate": _immediate, "post_dominators": _post_dominators, "frontier": _frontier, "loops": _loops, "reaching": _reaching}


def per_graph(edges: DataFrame, relation: str) -> DataFrame:
    """``graph``, ``block``, ``other`` of a relation of ``PER_GRAPH``, over ``graph``, ``src``, ``dst`` edges.

    Entry is the least block without predecessors; graphs without one have no dominators. One graph is held at a
    time: rows come sorted by graph.
    """
    work = PER_GRAPH[relation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        current, after, blocks = None, {}, set()

        def close() -> None:
            if current is not None:
                for b, x in set(work(after, blocks)):
                    for column, v in zip(out, (current, b, x), strict=True):
                        column.append(v)

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["graph", "block", "other"])
            for c in out:
                c.clear()
            return made

        for batch in batches:
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != current:
                    close()
                    current, after, blocks = g, {}, set()
                after.setdefault(a, set()).add(b)
                blocks |= {a, b}
            if len(out[0]) > 50_000:
                yield batch_out()
        close()
        yield batch_out()

    rows = edges.select("graph", "src", "dst").distinct().repartition("graph").sortWithinPartitions("graph")
    return rows.mapInArrow(run, "graph string, block string, other string")


def simple_paths(edges: DataFrame, starts: DataFrame, max_edges: int = 20) -> DataFrame:
    """``graph``, ``path array<string>``: simple paths from each graph's start (``graph``, ``src``), level by level."""
    levels = Levels(edges.sparkSession, "paths")
    links = levels.keep(edges.select("graph", "src", "dst").distinct())
    paths = levels.add(starts.select("graph", F.array("src").alias("path")))
    for _ in range(max_edges):
        step = paths.withColumn("src", F.element_at("path", -1)).join(links, ["graph", "src"]).where(~F.array_contains("path", F.col("dst")))
        paths = levels.add(step.select("graph", F.concat("path", F.array("dst")).alias("path")))
        if not levels.last_count:
            break
    return levels.all()


def linear_mro(bases: dict[str, list[str]], name: str, seen: tuple[str, ...] = ()) -> tuple[list[str], bool]:
    """C3 order of a class and whether it is complete: (itself) alone and incomplete with an unknown base; itself
    alone where the merge is inconsistent or the hierarchy cyclic."""
    if name in seen:
        return [name], False
    own = bases.get(name, [])
    if not own:
        return [name, "object"], True
    if any(b not in bases and b != "object" for b in own):
        return [name], False
    lines = [linear_mro(bases, b, (*seen, name))[0] if b != "object" else ["object"] for b in own] + [list(own)]
    out = [name]
    while any(lines):
        lines = [line for line in lines if line]
        head = next((line[0] for line in lines if not any(line[0] in other[1:] for other in lines)), None)
        if head is None or head == name:
            return [name], False
        out.append(head)
        lines = [line[1:] if line[0] == head else line for line in lines]
    return out, True


def _reach_all(starts: set[str], after: dict[str, set[str]], without: set[str]) -> set[str]:
    seen = set(starts)
    todo = list(starts)
    while todo:
        for x in after.get(todo.pop(), ()):
            if x not in seen and x not in without:
                seen.add(x)
                todo.append(x)
    return seen


def branch_arms(edges: DataFrame) -> DataFrame:
    """``graph``, ``block``, ``direction``, ``member``, ``in_arm`` for blocks with edges labelled true or false.

    Members are what the direction's targets reach when the other direction's targets are blocked; those that the
    other direction reaches as well (joins) are on the path but not in the arm. edges: ``graph``, ``src``, ``dst``, ``label``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        names = ["graph", "block", "direction", "member", "in_arm"]
        rows: list[tuple] = []
        current, after, targets = None, {}, {}

        def close() -> None:
            for block, sides in targets.items():
                ends = {d: sides.get(d, set()) - sides.get(o, set()) for d, o in (("true", "false"), ("false", "true"))}
                found = {d: _reach_all(ends[d], after, sides.get(o, set())) for d, o in (("true", "false"), ("false", "true"))}
                for d, o in (("true", "false"), ("false", "true")):
                    rows.extend((current, block, d, x, x not in found[o]) for x in found[d])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for g, a, b, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != current:
                    close()
                    current, after, targets = g, {}, {}
                after.setdefault(a, set()).add(b)
                if label in ("true", "false"):
                    targets.setdefault(a, {}).setdefault(label, set()).add(b)
            if len(rows) > 50_000:
                yield out()
        close()
        yield out()

    ordered = edges.select("graph", "src", "dst", "label").distinct().repartition("graph").sortWithinPartitions("graph")
    return ordered.mapInArrow(run, "graph string, block string, direction string, member string, in_arm boolean")


def precedes(pairs: DataFrame, blocks: DataFrame, dominators: DataFrame) -> DataFrame:
    """Pairs of places with ``precedes``: source order within one block, dominance between blocks, false if unknown.

    pairs: ``pair``, ``graph``, ``a_line``, ``b_line``; blocks: ``graph``, ``block``, ``line`` (of each statement); dominators:
    ``graph``, ``block``, ``other``.
    """
    at = lambda side: blocks.select("graph", F.col("line").alias(f"{side}_line"), F.col("block").alias(f"{side}_block"))
    placed = pairs.join(at("a"), ["graph", "a_line"], "left").join(at("b"), ["graph", "b_line"], "left")
    dom = dominators.select("graph", F.col("block").alias("b_block"), F.col("other").alias("a_block"), F.lit(True).alias("_dom"))
    placed = placed.join(dom, ["graph", "a_block", "b_block"], "left")
    same = F.col("a_block") == F.col("b_block")
    before = F.when(same, F.col("a_line") < F.col("b_line")).otherwise(F.coalesce("_dom", F.lit(False)))
    return placed.select(*pairs.columns, F.coalesce(before, F.lit(False)).alias("precedes"))


def reachable_between(pairs: DataFrame, blocks: DataFrame, reaching: DataFrame) -> DataFrame:
    """Pairs of places with ``reachable``: within a block the second line is not before the first, or the block is on a cycle; between
    blocks one reaches the other; false if unknown.

    pairs and blocks as for ``precedes``; reaching: ``graph``, ``block``, ``other`` of the relation ``reaching``.
    """
    at = lambda side: blocks.select("graph", F.col("line").alias(f"{side}_line"), F.col("block").alias(f"{side}_block"))
    placed = pairs.join(at("a"), ["graph", "a_line"], "left").join(at("b"), ["graph", "b_line"], "left")
    ways = reaching.select("graph", F.col("block").alias("a_block"), F.col("other").alias("b_block"), F.lit(True).alias("_way"))
    placed = placed.join(ways, ["graph", "a_block", "b_block"], "left")
    inside = (F.col("a_block") == F.col("b_block")) & (F.col("a_line") <= F.col("b_line"))
    return placed.select(*pairs.columns, F.coalesce(inside | F.coalesce("_way", F.lit(False)), F.lit(False)).alias("reachable"))


def guard_results(pairs: DataFrame, dominators: DataFrame, frontier: DataFrame) -> DataFrame:
    """Pairs (``graph``, ``guard``, ``sensitive``: blocks) with ``sufficient`` (the guard dominates) and ``bypasses``: the guard's frontier blocks,
    where control comes in past it, that dominate the sensitive block."""
    dom = dominators.select("graph", F.col("block").alias("sensitive"), F.col("other").alias("guard"), F.lit(True).alias("_dom"))
    entries = frontier.select("graph", F.col("block").alias("guard"), F.col("other").alias("_entry"))
    above = dominators.select("graph", F.col("block").alias("sensitive"), F.col("other").alias("_entry"))
    past = pairs.join(entries, ["graph", "guard"]).join(above, ["graph", "sensitive", "_entry"])
    past = past.groupBy("graph", "guard", "sensitive").agg(F.array_sort(F.collect_set("_entry")).alias("bypasses"))
    out = pairs.join(dom, ["graph", "guard", "sensitive"], "left").join(past, ["graph", "guard", "sensitive"], "left")
    return out.select(*pairs.columns, F.coalesce("_dom", F.lit(False)).alias("sufficient"), F.coalesce("bypasses", F.array().cast("array<string>")).alias("bypasses"))


def loops_around(loops: DataFrame) -> DataFrame:
    """``graph``, ``block``, ``header``, ``depth``: the loops that hold each block, innermost (the least body, then header) at depth 1.

    loops: the relation ``loops`` (``block`` is the header, ``other`` a member).
    """
    sizes = loops.groupBy("graph", "block").agg(F.count(F.lit(1)).alias("_n"))
    held = loops.join(sizes, ["graph", "block"]).select("graph", F.col("other"), F.col("block").alias("header"), "_n")
    order = Window.partitionBy("graph", "other").orderBy("_n", "header")
    return held.select("graph", F.col("other").alias("block"), "header", F.row_number().over(order).alias("depth"))


def in_blocks(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items (``graph``, ``block``, ...) whose block is among the chosen (``graph``, ``block``)."""
    return items.join(chosen.select("graph", "block").distinct(), ["graph", "block"], "left_semi")


def labelled_ends(edges: DataFrame, statements: DataFrame, label: str = "raise") -> DataFrame:
    """``graph``, ``block``, ``line``: blocks that an edge of the label leaves, with their last statement's line. edges: ``graph``, ``src``, ``label``; statements: ``graph``, ``block``, ``line``."""
    last = statements.groupBy("graph", "block").agg(F.max("line").alias("line"))
    return last.join(edges.where(F.col("label") == label).select("graph", F.col("src").alias("block")).distinct(), ["graph", "block"], "left_semi")


def path_conditions(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph``, ``path``, ``conditions array<struct<place,block,label>>``: the branches that a path takes. paths: ``graph``, ``path``; edges: ``graph``, ``src``, ``dst``, ``label``."""
    steps = paths.select("graph", "path", F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("place", "src")).withColumn("dst", F.element_at("path", F.col("place") + 2))
    labels = edges.where(F.col("label").isin("true", "false")).groupBy("graph", "src", "dst").agg(F.max("label").alias("label"))
    taken = steps.join(labels, ["graph", "src", "dst"]).groupBy("graph", "path").agg(F.sort_array(F.collect_list(F.struct("place", F.col("src").alias("block"), "label"))).alias("conditions"))
    none = F.array().cast("array<struct<place:int,block:string,label:string>>")
    return paths.join(taken, ["graph", "path"], "left").withColumn("conditions", F.coalesce("conditions", none))
