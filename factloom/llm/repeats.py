"""Removal of repeated byte strings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte is removed when a string of ``LENGTH`` bytes that also starts earlier covers it. Strings are brought
together by content: of the ``GRAM``-byte grams in a string the one with the least hash is its anchor, so equal
strings have equal anchors at equal places. The stretch of a document whose strings share an anchor is a
*context*.

1. A narrow pass finds all anchors; the first of each hash in a task's chunk is checked against other chunks.
   Only repeated anchors go on.
2. Documents with repeated anchors cut their contexts. Within a chunk, of equal contexts only the earliest goes
   on; the others are covered as a whole.
3. Contexts meet by anchor, some MB at a time. Their suffixes are sorted to the needed depth, which gives the
   Burrows-Wheeler transform, and the intervals of its strings of length 1, 2, ... are expanded backward, breadth
   first: common prefixes come out by increasing value, and expansion stops at ``LENGTH``. Suffixes in one
   interval then share a string; all but the earliest are repeats. The transform sees distinct contexts only.
4. An anchor with more than ``CROWD`` contexts is split by what stands beside it: strings that begin well before the
   anchor go by the bytes before it, the others by the bytes behind it, so that equal strings still meet. Parts go
   through step 3, or are split again, until the strings of a part are all the same one.
5. Spans return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, spread_join, tidy

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at once; anchors and contexts that a task compares at once.
PIECE, CHUNK, BLOCK = 4_000_000, 2_000_000, 300_000
#: Contexts of an anchor, or of a part of its strings, beyond which they are split.
CROWD = 4_000
NULL_ID = 2**63 - 1

_U = np.uint64


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each place on."""
    h = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    width = 1
    while width < gram:
        h = h[:-width] * _U(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> _U(31)
        width *= 2
    h *= _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row: prefix and suffix minima of blocks, combined."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of each stretch of ``length``-byte strings with one anchor.

    Of equal least hashes in a string the leftmost is the anchor. Long data goes piece by piece; a stretch that
    a piece's end cuts gives two contexts, which is harmless, as each string is in one context all the same.
    """
    starts = len(data) - length + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, max(starts, 0), PIECE):
        part = data[at : min(at + PIECE, starts) + length - 1]
        h = _gram_hashes(part, gram)
        # The least of (40 bits of the hash, place); places fit into 24 bits.
        least = _sliding_least((h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=_U), length - gram + 1)
        place = (least & _U(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        out.append((h[place[first]], first + at, last + at))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))  # type: ignore[return-value]


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``anchor``, ``id``, ``kind``: 0 to be checked (the chunk has it once), 1 repeated, and the chunk's
    messenger, 2 repeated and not told to others. One row of kind 0 or 1 for each anchor of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            anchors, ids = np.concatenate(found), np.concatenate(owners)
            found.clear()
            owners.clear()
            order = np.lexsort((ids, anchors))
            anchors, ids = anchors[order], ids[order]
            head = np.concatenate([[True], anchors[1:] != anchors[:-1]])
            alone = head & np.append(head[1:], True)
            fresh = head | np.concatenate([[True], ids[1:] != ids[:-1]])  # one row for an anchor and document
            kind = np.where(alone, 0, np.where(head, 1, 2)).astype(np.int8)
            anchors, ids, kind = anchors[fresh].view(np.int64), ids[fresh], kind[fresh]
            for at in range(0, len(ids), 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(anchors[cut]), pa.array(ids[cut]), pa.array(kind[cut])], names=["anchor", "id", "kind"])

        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                h = contexts(np.frombuffer(raw, np.uint8), length, gram)[0]
                found.append(h)
                owners.append(np.full(len(h), key, np.int64))
                held += len(h)
                if held > CHUNK:
                    yield from out()
                    held = 0
        if held:
            yield from out()

    return rows.mapInArrow(tidy(run), "anchor long, id long, kind byte")


def _cut(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Of documents with the list of their repeated anchors: contexts that go on (``anchor``, ``id``, ``start``,
    ``context``), and spans covered by an earlier equal context of the chunk (context null, ``end``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        covered: list[list[int]] = []
        size = 0

        def cover(doc: int, start: int, end: int) -> None:
            if covered and covered[-1][0] == doc and covered[-1][1] <= start <= covered[-1][2]:
                covered[-1][2] = max(end, covered[-1][2])
            else:
                covered.append([doc, start, end])

        def out() -> Iterator[pa.RecordBatch]:
            rest = [(None, i, a, b, None) for i, a, b in covered]
            rest += [(h, i, a, None, c) for c, (i, a, h) in seen.items()]
            seen.clear()
            covered.clear()
            for at in range(0, len(rest), 20_000):
                cols = list(zip(*rest[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["anchor", "id", "start", "end", "context"])

        for batch in batches:
            for key, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                data = raw.to_pybytes()
                h, first, last = contexts(np.frombuffer(data, np.uint8), length, gram)
                h = h.view(np.int64)
                wanted = np.flatnonzero(np.isin(h, listed.values.to_numpy()))
                for anchor, a, b in zip(h[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    c = data[a : b + length]
                    old = seen.get(c)
                    if old is None:
                        seen[c] = (key, a, anchor)
                        size += len(c)
                    elif old[:2] <= (key, a):
                        if old[:2] != (key, a):
                            cover(key, a, a + len(c))
                    else:
                        cover(old[0], old[1], old[1] + len(c))
                        seen[c] = (key, a, anchor)
                if size > 32_000_000 or len(covered) > 500_000:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(tidy(run), "anchor long, id long, start long, end long, context binary")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least; symbol 0 ends a text and differs from all others."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = wide[:n].copy()
    for k in range(1, 7):
        key = key * 257 + wide[k : k + n]
    ends = np.flatnonzero(symbols == 0)
    near_end = np.zeros(n, bool)
    for k in range(7):
        near_end[np.maximum(ends - k, 0)] = True
    order = np.argsort(key)
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | near_end[order][1:] | near_end[order][:-1]])
    rank = np.empty(n, np.int64)
    width = 7
    while True:
        # An open run of suffixes, equal so far, is sorted by the ranks of what follows; all others stand.
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        open_ = np.flatnonzero(~new | ~np.append(new[1:], True))
        if width >= depth or not len(open_):
            return order
        at = order[open_]
        ahead = rank[np.minimum(at + width, n - 1)]
        again = np.argsort(rank[at] * n + ahead)
        order[open_] = at[again]
        head, follow = rank[at[again]], ahead[again]
        new[open_] = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        width *= 2


def intervals(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Interval number, in suffix order, of each suffix's first ``length`` symbols.

    The interval of a string w holds the suffixes that begin with it. Backward extension by c takes the places k
    of w's interval with c in the transform to c w's: k goes to ``before[k]``, the place of the suffix that starts
    one earlier. So two neighbours p - 1 and p that begin with the same symbol part at level l + 1 exactly if the
    places they come from parted at level l: a boundary found at l is the common prefix's length.
    """
    n = len(order)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    come_from = place[np.minimum(order + 1, n - 1)]  # inverse of the backward step
    first = symbols[order]
    parted = np.concatenate([[True], (first[1:] != first[:-1]) | (first[1:] == 0)])
    undecided = np.flatnonzero(~parted)
    a, b = come_from[undecided - 1], come_from[undecided]
    for _ in range(1, length):
        group = np.cumsum(parted, dtype=np.int32)
        split = group[a] != group[b]
        if split.any():
            parted[undecided[split]] = True
            keep = ~split
            undecided, a, b = undecided[keep], a[keep], b[keep]
        if not len(undecided):
            break
    return np.cumsum(parted) - 1


def repeats_in_block(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Spans (id, start, end) covered by strings that start earlier, among distinct contexts (id, start, bytes)."""
    kept, spans = sorted(rows), []
    sizes = np.array([len(c) for *_, c in kept], np.int64)
    data = np.frombuffer(b"\0".join([c for *_, c in kept]) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = data.astype(np.int16) + 1
    symbols[ends] = 0
    order = suffix_order(symbols, length)
    group = intervals(symbols, order, length)
    # Places in one interval where a whole string starts, by (document, offset); all but the first repeat it.
    owner = np.repeat(np.arange(len(kept)), sizes + 1)
    offset = np.arange(len(data)) - np.repeat(ends - sizes, sizes + 1)
    whole = np.repeat(sizes, sizes + 1) - offset >= length
    ids, starts = np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64)
    at = order[whole[order]]
    g = group[whole[order]]
    same = g[1:] == g[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, g = at[several], g[several]
    where = starts[owner[at]] + offset[at]
    turn = np.lexsort((where, ids[owner[at]], g))
    repeat = np.concatenate([[False], g[turn][1:] == g[turn][:-1]]) if len(at) else np.zeros(0, bool)
    hit = np.sort(at[turn[repeat]])
    if len(hit):
        heads = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
        tails = np.append(heads[1:], len(hit)) - 1
        for x, y in zip(hit[heads].tolist(), hit[tails].tolist(), strict=True):
            o = owner[x]
            spans.append((int(ids[o]), int(starts[o] + offset[x]), int(starts[o] + offset[y]) + length))
    return spans


def _compared(rows: DataFrame, length: int, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, int, bytes]] = []
        spans: list[tuple[int, int, int]] = []
        size = 0
        group: list[tuple[int, int, bytes]] = []
        current = None

        def out() -> pa.RecordBatch:
            if ready:
                spans.extend(repeats_in_block(ready, length))
                ready.clear()
            made = pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(3)], names=["id", "start", "end"])
            spans.clear()
            return made

        def close() -> int:
            """Equal contexts of different chunks are settled here; an anchor's only context has no company."""
            distinct: dict[bytes, tuple[int, int]] = {}
            for doc, start, c in sorted(group):
                if c in distinct:
                    spans.append((doc, start, start + len(c)))
                else:
                    distinct[c] = (doc, start)
            if len(distinct) < 2:
                return 0
            ready.extend((doc, start, c) for c, (doc, start) in distinct.items())
            return sum(map(len, distinct))

        for batch in batches:
            for anchor, doc, start, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if anchor != current:
                    size += close()
                    group.clear()
                    current = anchor
                    if size > block or len(spans) > 50_000:
                        yield out()
                        size = 0
                group.append((doc, start, c))
        close()
        yield out()

    ordered = rows.select("anchor", "id", "start", "context").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(tidy(run), "id long, start long, end long")


def _halves(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Each part (``anchor``, ``lo``, ``hi``) split into strings whose anchor lies lo to mid, or mid + 1 to hi, bytes in.

    All strings of a half have the same bytes around the anchor in common; their hash names the half. Within a task's
    chunk, of equal contexts of a half only the earliest goes on; the others are spans (context null, ``end``).
    rows: ``anchor``, ``id``, ``start``, ``context``, ``lo``, ``hi``, ``at`` (of the anchor in the context; null: not known yet).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int, bytes], tuple[int, int, int]] = {}
        covered: list[tuple[int, int, int]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rest = [(None, i, a, b, None, None, None, None) for i, a, b in covered]
            rest += [(h, i, a, None, c, lo, hi, at) for (h, lo, hi, c), (i, a, at) in seen.items()]
            seen.clear()
            covered.clear()
            for k in range(0, len(rest), 20_000):
                cols = list(zip(*rest[k : k + 20_000], strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "id", "start", "end", "context", "lo", "hi", "at"])

        for batch in batches:
            for anchor, doc, start, c, lo, hi, at in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at is None:
                    hashes = _gram_hashes(np.frombuffer(c, np.uint8), gram).view(np.int64)
                    at = int(np.argmax(hashes == anchor))
                mid = (lo + hi) // 2
                for low, high in ((lo, mid), (mid + 1, hi)):
                    first, last = max(0, at - high), min(len(c) - length, at - low)
                    if first > last:
                        continue
                    core = c[at - low : at - high + length]
                    name = int.from_bytes(hashlib.blake2b(core + anchor.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                    part = c[first : last + length]
                    entry, key = (doc, start + first, at - first), (name, low, high, part)
                    old = seen.get(key)
                    if old is None:
                        size += len(part)
                    if old is None or entry[:2] < old[:2]:
                        seen[key] = entry
                        entry = old
                    if entry is not None and entry[:2] != seen[key][:2]:
                        covered.append((entry[0], entry[1], entry[1] + len(part)))
                if size > 16_000_000 or len(covered) > 200_000:
                    yield from out()
                    size = 0
        yield from out()

    columns = rows.select("anchor", "id", "start", "context", "lo", "hi", "at")
    return columns.mapInArrow(tidy(run), "anchor long, id long, start long, end long, context binary, lo int, hi int, at int")


def _one_string(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Spans of parts whose strings are all the same one, by part (``anchor``): all but the earliest."""
    rows = scratch.save(rows.select("anchor", "id", "start"))
    earliest = scratch.save(rows.groupBy("anchor").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("_copies")))
    later = spread_join(rows, earliest, "anchor", rows.count())
    return later.where((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start"))).select("id", "start", (F.col("start") + length).alias("end"))


def _by_parts(found: DataFrame, length: int, gram: int, block: int, crowd: int, scratch: Scratch) -> DataFrame:
    """Spans of repeated strings among contexts; crowded anchors are split until their parts fit."""
    found = found.select("anchor", "id", "start", "context").withColumns({"lo": F.lit(0), "hi": F.lit(length - gram), "at": F.lit(None).cast("int")})
    spans = None
    while True:
        counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
        crowded = scratch.save(counts.where(F.col("_n") > crowd).select("anchor"))
        n = crowded.count()
        if not n:
            part = _compared(found, length, block)
            return part if spans is None else spans.union(part)
        crowded = F.broadcast(crowded) if n <= HOT_KEYS else crowded
        fits = scratch.save(_compared(found.join(crowded, "anchor", "left_anti"), length, block))
        spans = fits if spans is None else spans.union(fits)
        large = found.join(crowded, "anchor", "left_semi")
        spans = spans.union(_one_string(large.where("lo = hi"), length, scratch))
        split = scratch.save(_halves(large.where("lo < hi"), length, gram))
        spans = spans.union(split.where("context IS NULL").select("id", "start", "end"))
        found = split.where("context IS NOT NULL").drop("end")


def _numbered(df: DataFrame, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``key`` as given, ``id``, ``text``. An id is the key itself or, where keys repeat or are null more than once, a
    number of the row's own in the order of the keys (null last), for all rows; the second value says which."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(key), F.lit(NULL_ID)).alias("id"), raw.alias("text"))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows.drop("_key"), False
    # Numbered once, saved; the order of the numbers is that of a range partitioning and of the sort in it.
    saved = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()))
    order = saved.select("id", "_row").repartitionByRange("id", "_row").sortWithinPartitions("id", "_row")
    order = scratch.save(order.select("_row", F.monotonically_increasing_id().alias("_number")))
    return scratch.save(saved.join(order, "_row").select("_key", F.col("_number").alias("id"), "text")), True


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, crowd: int = CROWD
) -> DataFrame:
    """One row per input row: ``key``, ``n_bytes``, ``n_removed``, ``spans array<struct<start,end>>`` (merged,
    ascending), ``kept binary`` (null where nothing was removed), ``kept_sha256``.

    Order is by key, then row, then start; a null key comes last. Null texts count as empty. Rows that repeat a key are
    documents of their own, in the order of the input. Empty tables give empty results; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "repeats")
    rows, numbered = _numbered(df, key, text, scratch)
    keys = rows.select("id", "_key") if numbered else None
    rows = rows.select("id", "text")

    anchors = scratch.save(_anchors(rows, length, gram))
    told = anchors.where("kind < 2").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("anchor")))  # a chunk tells once
    repeated = told.where("_n > 1 OR kind = 1").select("id", "anchor").union(anchors.where("kind = 2").select("id", "anchor"))
    lists = scratch.save(repeated.groupBy("id").agg(F.collect_list("anchor").alias("anchors")))
    cut = scratch.save(_cut(rows.join(lists, "id").select("id", "text", "anchors"), length, gram))
    scratch.drop(anchors)

    spans = cut.where("context IS NULL").select("id", "start", "end")
    spans = spans.union(_by_parts(cut.where("context IS NOT NULL"), length, gram, block, crowd, scratch))
    spans = scratch.save(spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    scratch.drop(cut)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), F.lit(None).cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"))
    out = whole.join(spans.select("id"), "id", "left_anti").union(_without(rows.join(spans, "id").select("id", "text", "spans")))
    if keys is not None:
        return out.join(keys, "id").select(F.col("_key").alias(key), *out.columns[1:])
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", key)


def _without(rows: DataFrame) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, listed in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                flat = listed.values.flatten()
                starts, ends = (np.minimum(x.to_numpy(), len(raw)) for x in flat)
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                head = np.concatenate([[True], starts[1:] > ends[:-1]])
                starts, ends = starts[head], ends[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]
                real = ends > starts
                starts, ends = starts[real].tolist(), ends[real].tolist()
                kept = b"".join([raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True)])
                pairs = [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)]
                out.append((len(raw), len(raw) - len(kept), pairs, kept, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), span, pa.binary(), pa.string()]
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    return rows.mapInArrow(tidy(run), "id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")
