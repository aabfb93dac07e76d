"""Near-duplicate components by a chosen-path set similarity join.

Documents are sets of word shingles; two are linked when their Jaccard similarity reaches the threshold, and a
document's class is its connected component. The steps:

1. One narrow pass turns each text into its set's digest, one byte of each of ``COORDINATES`` minwise values and the
   whole of the first ones, which the roots use. Equal sets become one class with its smallest id.
2. Trees: a tree's root deals the classes to nodes by one minwise value; a node above ``NODE`` members is branched
   again by the bytes of ``BRANCHES`` coordinates that its own path selects. Small nodes are compared exhaustively
   on the bytes (a loose bar, ``likely``), and give candidate clusters. ``missed`` is the share of pairs that no
   tree keeps together, with the roots, and with all trees drawing from the same coordinates: 2.8e-7 at 0.85
   and 7.1e-6 at 0.80 below six levels of branches. The loose bar misses fewer than 1 in 100,000 at the threshold.
3. Each class belongs to one cluster. A cluster whose sets fit (``CLUSTER`` members, ``ELEMENTS`` shingles) is one
   group; a larger one is branched by the same trees until its nodes fit. In each group full sets are intersected
   exhaustively, so links are exact and none between different texts of a group is lost.
4. Groups hand on a star per component found in them; stars that share documents are joined up.

Branched nodes compare with pivots first, and what is connected so far gets one label. A node of one label has
nothing to add and is dropped; of one with few members beside its most frequent label, those meet all of its
blocks (``_beside``). This, which loses no pair, keeps groups of many near copies from growing at each level. At the
last level nodes that still don't fit are compared in blocks, each pair of blocks a group of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, HOT_KEYS, Scratch, spread_join, tidy

#: Minwise values of a set; branches select by their bytes.
COORDINATES = 64
#: Roots (of as many values the whole 64 bits are kept), branches of a node, and levels below the roots.
TREES, BRANCHES, LEVELS = 12, 2, 6
#: Members of a node that is compared exhaustively; members and shingles of a group whose full sets are.
NODE, CLUSTER, ELEMENTS = 4096, 4096, 1_000_000
#: Elements, and sets, whose incidences are multiplied at once.
TILE = 1024
#: Members of a node too large for a group that meet all its blocks.
PIVOTS = 16
#: Rows up to which the list of documents to verify is broadcast (16 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 300_000
#: Takes the place of a null id; comes back as null.
NULL_ID = 2**63 - 1

_U = np.uint64
_MULTIPLIERS = (np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles (A-Z lower-cased; white space is ASCII's).

    With fewer words than a shingle has, the whole sequence is the one element; without words the set is empty.
    """
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, _U)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1 + len(found))], _U)
    hashed = np.array(list(map(xxhash.xxh3_64_intdigest, found)), _U)
    n = len(hashed) - words + 1
    h = np.zeros(n, _U)
    for k in range(words):  # ordered: each position has its own multiplier, and is mixed in before the next
        h = _mixed(h * _MULTIPLIERS[k] + hashed[k : k + n])
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """``COORDINATES`` minwise values of each set (all sets non-empty), a row each."""
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), _U)
    for c in range(COORDINATES):
        h = (joined ^ _MULTIPLIERS[c]) * _MULTIPLIERS[(c + 17) % 64]
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        out[:, c] = np.minimum.reduceat(h, starts)
    return _mixed(out)


def sketches(df: DataFrame, key: str, text: str, words: int, trees: int = TREES) -> DataFrame:
    """``id``, ``n``, ``digest`` (of the full set; null if empty), ``paths array<bigint>``, ``bytes``."""
    rows = df.select(F.coalesce(F.col(key), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, words) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                values = iter(minwise(full) if full else ())
                digests, paths, small = [], [], []
                for s in sets:
                    v = next(values) if len(s) else np.zeros(0, _U)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    paths.append(v[:trees].view(np.int64))
                    small.append((v & _U(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(small, pa.binary())],
                    names=["id", "n", "digest", "paths", "bytes"],
                )

    return rows.mapInArrow(tidy(run), "id long, n long, digest binary, paths array<bigint>, bytes binary")


def likely(coordinates: int, percent: int) -> int:
    """Equal bytes from which on a pair is a candidate: at the threshold, fewer are as rare as 1 in 100,000."""
    from math import comb

    p, tail = percent / 100, 0.0
    for k in range(coordinates + 1):
        tail += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if tail > 1e-5:
            return k
    return coordinates


def missed(similarity: float, trees: int = TREES, branches: int = BRANCHES, levels: int = LEVELS) -> float:
    """Share of pairs that no tree keeps together where all nodes branch ``levels`` times below the roots.

    The pair agrees in k of the ``COORDINATES`` that all trees draw from; given k, trees are taken as independent.
    """
    from math import comb

    total = 0.0
    for k in range(COORDINATES + 1):
        s, apart = k / COORDINATES, 0.0
        for _ in range(levels):
            apart = (1 - s + s * apart) ** branches
        total += comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) * (1 - s + s * apart) ** trees
    return total


def _by_group(df: DataFrame, group: str, fn: Callable[[pa.Table], Iterator[tuple[int, int]]], extra: str = "") -> DataFrame:
    """``fn`` on the rows of each group (adjacent after a sort by it), giving (id, root) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        pairs: list[tuple[int, int]] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["id", "root"])
            pairs.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), batch.num_rows]
            if waiting and waiting[-1].column(0)[0].as_py() != groups[0]:
                pairs += fn(pa.Table.from_batches(waiting))
                waiting.clear()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                waiting.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    pairs += fn(pa.Table.from_batches(waiting))
                    waiting.clear()
            if len(pairs) > 8192:
                yield out()
        if waiting:
            pairs += fn(pa.Table.from_batches(waiting))
        if pairs:
            yield out()

    # As many tasks as the session's setting says: these rows are small and cost much, so their bytes say little.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, group).sortWithinPartitions(group).mapInArrow(tidy(run), "id long, root long")


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for a symmetric matrix."""
    at = np.arange(len(linked))
    while True:
        least = [np.where(linked[i : i + 256], at[None, :], len(linked)).min(axis=1) for i in range(0, len(linked), 256)]
        new = np.minimum(at, np.concatenate(least))
        new = new[new]
        if (new == at).all():
            return at
        at = new


def components(edges: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``id``, ``root`` (smallest id of the component) for all ids of the edges (``id``, ``root``).

    Alternates two star steps on the edge list: every id hands its smallest neighbour to its larger ones, then to
    its smaller ones; each step is a minimum by id (combined before the shuffle) and a join that broadcasts the ids
    with very many neighbours. Ends when nothing changes; the number of rounds grows with the logarithm of the longest
    chain.
    """

    def star(pairs: DataFrame, upwards: bool, total: int) -> DataFrame:
        both = pairs.union(pairs.select(F.col("root").alias("id"), F.col("id").alias("root"))) if upwards else pairs
        least = both.groupBy("id").agg(F.least("id", F.min("root")).alias("least"), F.count(F.lit(1)).alias("_copies"))
        told = spread_join(both, least, "id", total, hot=hot)
        if upwards:
            made = told.where("root > id").select(F.col("root").alias("id"), F.col("least").alias("root"))
        else:
            made = told.where("root != least").select(F.col("root").alias("id"), F.col("least").alias("root")).union(least.select("id", F.col("least").alias("root")))
        return made.where("id != root").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "root")), F.sum(F.col("root").cast("decimal(38,0)"))).first())

    ordered = edges.select(F.greatest("id", "root").alias("id"), F.least("id", "root").alias("root")).where("id != root").distinct()
    now = scratch.save(ordered)
    before, here = None, state(now)
    while here != before:
        after = scratch.save(star(star(now, True, 2 * here[0]), False, here[0]))
        scratch.drop(now)
        now, before, here = after, here, state(after)
    return now.union(now.select(F.col("root").alias("id"), "root").distinct())


def _told(rows: DataFrame, table: DataFrame, total: int, count: str, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """The rows with what a table says of their nodes (rows of other nodes go); ``count`` is its number of rows a node.
    A table of few nodes is broadcast; else the nodes with very many rows are, and the others meet by a shuffle."""
    table = scratch.save(table)
    if table.count() <= HOT_KEYS:
        return rows.join(F.broadcast(table), "node")
    return spread_join(rows, table.withColumn("_copies", F.col(count)), "node", total, hot=hot)


def _tree_nodes(classes: DataFrame, trees: int, within: str | None = None) -> DataFrame:
    """The rows in the root level's nodes of all trees; with ``within``, in trees of their own for each value of it."""
    more = [F.col(within)] if within else []
    nodes = F.array(*(F.xxhash64(F.lit(c), F.get("paths", F.lit(c)), *more) for c in range(trees)))
    return classes.select("*", F.explode(nodes).alias("_node")).drop("node").withColumnRenamed("_node", "node")


def _children(rows: DataFrame, branches: int) -> DataFrame:
    """Each member of a node in the children that the node's path selects, by the bytes of their coordinates."""
    coordinate = lambda i: ((F.pmod(F.xxhash64("node"), F.lit(COORDINATES)) + F.lit(i * COORDINATES // branches)) % COORDINATES + 1).cast("int")
    child = lambda i: F.xxhash64("node", F.lit(i), F.substring("bytes", coordinate(i), F.lit(1)))
    return rows.withColumn("node", F.explode(F.array(*(child(i) for i in range(branches)))))


def _labelled(rows: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``label``: what the edges found so far connect has the same one."""
    labels = scratch.save(components(found, scratch).withColumnRenamed("root", "label"))
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _sized(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of nodes with several labels, with the node's ``members`` and ``elements``, its most frequent
    label ``_most``, and the members and elements beside it (``_others``, ``_weight``)."""
    by_label = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_e"))
    most = F.max(F.struct("_c", "_e", "label")).alias("_m")
    sizes = by_label.groupBy("node").agg(F.sum("_c").alias("members"), F.sum("_e").alias("elements"), most).where("members > _m._c")
    sizes = sizes.select("node", "members", "elements", F.col("_m.label").alias("_most"), (F.col("members") - F.col("_m._c")).alias("_others"), (F.col("elements") - F.col("_m._e")).alias("_weight"))
    sizes = scratch.save(sizes)
    total = sizes.agg(F.sum("members")).first()[0] or 0
    return scratch.save(_told(rows, sizes, total, "members", scratch))


def _few(cluster: int, elements: int) -> Column:
    """Whether those beside a node's most frequent label are so few that they can meet all of its blocks."""
    return (4 * F.col("_others") <= cluster) & (4 * F.col("_weight") <= elements)


def _beside(large: DataFrame, cluster: int, elements: int) -> DataFrame:
    """Nodes with few members beside their most frequent label: its members are dealt to blocks, the others go to
    all. Pairs of that label are connected already, so every pair that can add something meets."""
    blocks = F.ceil(2 * F.greatest(F.col("members") / cluster, F.col("elements") / elements))
    own = F.array(F.pmod(F.xxhash64("id"), blocks))
    to = F.when(F.col("label") == F.col("_most"), own).otherwise(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    return large.withColumn("_to", F.explode(to)).withColumn("node", F.xxhash64("node", F.lit("beside"), "_to")).drop("_to")


def _branched(
    rows: DataFrame, fits: Column, bar: int, branches: int, levels: int, scratch: Scratch, cluster: int = NODE, elements: int = 2**62
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Leaves (``node``, ``id`` and the rest) that can be compared as they are, and edges to pivots found on the way.

    rows: ``node``, ``id``, ``n``, ``bytes``.
    """
    leaves, edges = [], []
    sized = _sized(rows.withColumn("label", F.col("id")), scratch)
    columns = ["node", "id", "n", "bytes"]
    for level in range(levels + 1):
        leaves.append(sized.where(fits).select(*columns))
        large = sized.where(~fits)
        if large.isEmpty():
            break
        order = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"))
        first = large.select("node", "id", "bytes", "members", F.row_number().over(order).alias("_r")).where(F.col("_r") <= PIVOTS)
        pivots = first.groupBy("node").agg(F.max("members").alias("_size"), F.collect_list(F.struct("id", "bytes")).alias("_pivots"))
        same = lambda x: F.size(F.filter(F.sequence(F.lit(1), F.lit(COORDINATES)), lambda i: F.substring("bytes", i, F.lit(1)) == F.substring(x, i, F.lit(1))))
        near = F.filter("_pivots", lambda p: (p["id"] != F.col("id")) & (same(p["bytes"]) >= bar))
        large = large.select(*columns)
        told = _told(large, pivots, large.count(), "_size", scratch).select("id", F.explode(near).alias("_pivot"))
        edges.append(scratch.save(told.select("id", F.col("_pivot.id").alias("root")).distinct()))
        found = edges[0]
        for e in edges[1:]:
            found = found.union(e)
        large = _sized(_labelled(large, found, scratch), scratch)
        few = _few(cluster, elements)
        leaves.append(_beside(large.where(few), cluster, elements).select(*columns))
        rest = large.where(~few).select(*columns, "label")
        if rest.isEmpty():
            break
        if level == levels:
            leaves.append(_blocks(rest, scratch, cluster, elements).select(*columns))
            break
        sized = _sized(_children(rest, branches), scratch)
    return leaves, edges


def _blocks(large: DataFrame, scratch: Scratch, cluster: int = NODE, elements: int = ELEMENTS) -> DataFrame:
    """Nodes that no path splits, as pairs of blocks: each row goes to the pairs that its block is part of."""
    counts = large.groupBy("node").agg(F.count(F.lit(1)).alias("_size"), F.ceil(2 * F.greatest(F.count(F.lit(1)) / cluster, F.sum("n") / elements)).alias("_blocks"))
    rows = _told(large, counts, large.count(), "_size", scratch).drop("_size").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1), lambda b: F.xxhash64("node", F.least("_block", b), F.greatest("_block", b)))
    return rows.withColumn("node", F.explode(pair)).drop("_blocks", "_block").withColumns({"members": F.lit(0).cast("bigint"), "elements": F.lit(0).cast("bigint")})


def _large_clusters(
    rows: DataFrame, fits: Column, confirmed: Callable[[DataFrame], DataFrame], scratch: Scratch, trees: int, branches: int, levels: int, cluster: int, elements: int
) -> DataFrame:
    """Exact links of clusters that no group can hold.

    At each level the large nodes are dealt to blocks, each with the node's ``PIVOTS`` first members, and links in
    the blocks confirmed: members of many near copies are connected there. Nodes with one component left are done;
    the others branch (the first time into the trees' roots), until they fit or, after all levels, meet in blocks.
    """
    links = None
    for level in range(levels + 1):
        need = F.ceil(2 * F.greatest(F.count(F.lit(1)) / cluster, F.sum("n") / elements)).alias("_blocks")
        order = Window.partitionBy("node").orderBy(F.xxhash64("id", "node"))
        pivots = rows.select("node", "id", F.row_number().over(order).alias("_r")).where(F.col("_r") <= PIVOTS)
        counts = scratch.save(rows.groupBy("node").agg(need, F.count(F.lit(1)).alias("_size")))
        total = counts.agg(F.sum("_size")).first()[0] or 0
        own = _told(rows.select("node", "id"), counts, total, "_size", scratch).select(F.xxhash64("node", F.pmod(F.xxhash64("id"), F.col("_blocks"))).alias("node"), "id")
        everywhere = pivots.join(counts, "node").select("node", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_b"))
        found = confirmed(own.union(everywhere.select(F.xxhash64("node", "_b").alias("node"), "id")))
        links = scratch.save(found if links is None else links.union(found))
        large = _sized(_labelled(rows.select("node", "id", "n", "paths", "bytes"), links, scratch), scratch)
        few = _few(cluster, elements)
        links = scratch.save(links.union(confirmed(_beside(large.where(few), cluster, elements))))
        rest = large.where(~few).select("node", "id", "n", "paths", "bytes", "label")
        if rest.isEmpty():
            return links
        below = _sized(_tree_nodes(rest, trees, "node") if level == 0 else _children(rest, branches), scratch)
        links = scratch.save(links.union(confirmed(below.where(fits))))
        rows = below.where(~fits)
        if rows.isEmpty():
            return links
    return links.union(confirmed(_blocks(rows, scratch, cluster, elements)))


def _candidates(bar: int, percent: int) -> Callable[[pa.Table], Iterator[tuple[int, int]]]:
    def compare(node: pa.Table) -> Iterator[tuple[int, int]]:
        ids, n = node.column("id").to_numpy(), node.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(node.column("bytes").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
        near = np.empty((len(ids), len(ids)), bool)
        for at in range(0, len(ids), 256):
            rows = slice(at, at + 256)
            equal = np.zeros((len(ids[rows]), len(ids)), np.uint8)
            for c in range(COORDINATES):
                equal += sketch[rows, c, None] == sketch[None, :, c]
            own = n[rows, None]
            near[rows] = (equal >= bar) & (100 * np.minimum(own, n[None, :]) >= percent * np.maximum(own, n[None, :]))
        roots = _roots(near)
        for i in np.flatnonzero(roots != np.arange(len(ids))):
            yield int(ids[i]), int(ids[roots[i]])

    return compare


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs with 100 * intersection >= percent * union, on the full sets."""
    n = np.array([len(s) for s in sets], np.int64)
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), n)
    common = np.zeros((len(sets), len(sets)), np.int32)
    often = np.cumsum(count > 1) - 1  # elements of one set only meet nothing
    columns = int(often[-1]) + 1 if len(often) else 0
    shared = count[of] > 1
    row, column = member[shared], often[of[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    dense = count[count > 1] > max(8, len(sets) // 32)
    place = np.cumsum(dense) - 1
    # Frequent elements: products of incidence matrices, some hundred elements and rows at a time.
    wide = dense[column] if columns else np.zeros(0, bool)
    r, c = row[wide], place[column[wide]]
    for at in range(0, int(place[-1]) + 1 if columns else 0, TILE):
        lo, hi = np.searchsorted(c, [at, at + TILE])
        block = np.zeros((len(sets), TILE), np.float32)
        block[r[lo:hi], c[lo:hi] - at] = 1
        for top in range(0, len(sets), TILE):
            part = common[top : top + TILE]
            np.add(part, block[top : top + TILE] @ block.T, out=part, casting="unsafe")  # a product counts to TILE at most
    # Rare elements: the few pairs of sets that each one is in.
    r, c = row[~wide], column[~wide]
    flat = common.reshape(-1)
    for gap in range(1, len(r)):
        same = np.flatnonzero(c[gap:] == c[:-gap])
        if not len(same):
            break
        a, b = r[same], r[same + gap]
        np.add.at(flat, np.concatenate([a * len(sets) + b, b * len(sets) + a]), 1)
    linked = np.empty(common.shape, bool)
    for at in range(0, len(sets), 256):
        both = common[at : at + 256].astype(np.int64)
        linked[at : at + 256] = 100 * both >= percent * (n[at : at + 256, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    return linked


def _confirmed(words: int, percent: int) -> Callable[[pa.Table], Iterator[tuple[int, int]]]:
    def compare(group: pa.Table) -> Iterator[tuple[int, int]]:
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        texts = group.column("text").to_pylist()
        roots = _roots(linked_pairs([shingle_set(texts[i], words) for i in order], percent))
        for i in np.flatnonzero(ids[roots] != ids):
            yield int(ids[i]), int(ids[roots[i]])

    return compare


def near_dedup(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 80,
    trees: int = TREES,
    branches: int = BRANCHES,
    levels: int = LEVELS,
    node: int = NODE,
    cluster: int = CLUSTER,
    elements: int = ELEMENTS,
    hot: int = HOT,
) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets. Null and empty texts have
    empty sets and no links. Rows that repeat a key count as one document with the links of all of them, and
    are all kept or dropped; null keys are one such document, which comes last. Empty tables give empty results;
    other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "near-dedup")
    bar = likely(COORDINATES, percent)
    sets = scratch.save(sketches(df, key, text, words, trees))
    whole = sets.where("n > 0").groupBy("digest")
    classes = scratch.save(whole.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_copies"), *(F.first(c).alias(c) for c in ("n", "paths", "bytes"))))
    copies, classes = classes.select("digest", "_copies", "id"), classes.drop("_copies")

    roots = _tree_nodes(classes.select("id", "paths"), trees).select("id", "node")
    several = scratch.save(roots.groupBy("node").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1"))
    total = several.agg(F.sum("_copies")).first()[0] or 0
    rows = spread_join(roots, several, "node", total, hot=hot).join(classes.drop("digest", "paths"), "id")
    leaves, edges = _branched(scratch.save(rows), F.col("members") <= node, bar, branches, levels, scratch, node)
    for leaf in leaves:
        edges.append(_by_group(leaf.select("node", "id", "n", "bytes"), "node", _candidates(bar, percent)))
    found = edges[0]
    for e in edges[1:]:
        found = found.union(e)
    clusters = scratch.save(components(found, scratch, hot).withColumnRenamed("root", "node"))

    # Which texts meet where: clusters that fit as they are, larger ones branched.
    texts = df.select(F.coalesce(F.col(key), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def confirmed(place: DataFrame) -> DataFrame:
        place = scratch.save(place.select("node", "id").distinct())
        small = F.broadcast(place) if place.count() <= BROADCAST_ROWS else place
        return scratch.save(_by_group(texts.join(small, "id").select("node", "id", "text"), "node", _confirmed(words, percent)))

    sized = classes.drop("digest").join(clusters, "id")
    totals = sized.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
    totals = scratch.save(totals)
    sized = scratch.save(_told(sized, totals, totals.agg(F.sum("members")).first()[0] or 0, "members", scratch, hot))
    fits = (F.col("members") <= cluster) & (F.col("elements") <= elements)
    links = confirmed(sized.where(fits))
    large = sized.where(~fits)
    if not large.isEmpty():
        links = links.union(_large_clusters(large, fits, confirmed, scratch, trees, branches, levels, cluster, elements))
    links = components(links, scratch, hot)

    # Rows find their class by digest: equal sets may be a third of all rows, and empty ones have no digest.
    same = copies.withColumnRenamed("id", "_class").join(links.select(F.col("id").alias("_class"), "root"), "_class", "left")
    same = scratch.save(same.select("digest", "_copies", F.coalesce("root", "_class").alias("_root")))
    rows = sets.select("id", "n", "digest")
    out = spread_join(rows.where("n > 0"), same, "digest", sets.count(), hot=hot).select("id", "n", "_root").union(rows.where("n = 0").select("id", "n", "id"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias(key), F.col("n").alias("n_shingles"), real("_root").alias("component_id"), (F.col("id") == F.col("_root")).alias("kept"))
