"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved recursively down to leaves. A node's value is the token sequence of its part of the text;
two neighbours are joined by encoding anew only a window around their boundary, which grows until the tokens
outside provably stand. The proof rests on the splitting pattern: no match holds a visible character followed
by white space, so a match boundary lies before each white space that follows a visible character (a *stop*),
in every text that holds the two characters; and matching from a given place on doesn't look back. So tokens
left of a stop in the left half, and tokens right of a stop in the right half, are those of the whole text. A
half without a stop goes into the window as a whole. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, tidy

#: Code points of a leaf.
LEAF = 2048
#: First width, in code points, of the window's part in a half; it doubles until it holds a stop.
WINDOW = 32


class TreeCoder:
    """Encodes and decodes by the ranks of a tokenizer file in tiktoken's format, without special tokens."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tiktoken = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.leaf = leaf
        self._stop = regex.compile(r"\S\s")

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.tiktoken.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a, b = self._last_stop(text, lo, mid), self._first_stop(text, mid, hi)
        keep = self._count(reversed(left), len(text[a:mid].encode()))
        skip = self._count(right, len(text[mid:b].encode()))
        return left[: len(left) - keep] + self.tiktoken.encode_ordinary(text[a:b]) + right[skip:]

    def _last_stop(self, text: str, lo: int, hi: int) -> int:
        """The last place in (lo, hi) with a visible character before and white space behind it; lo if none."""
        width = WINDOW
        while True:
            at = max(lo, hi - width)
            found = [m.start() + 1 for m in self._stop.finditer(text, at, hi, overlapped=True)]
            if found or at == lo:
                return found[-1] if found else lo
            width *= 2

    def _first_stop(self, text: str, lo: int, hi: int) -> int:
        m = self._stop.search(text, lo, hi)
        return m.start() + 1 if m else hi

    def _count(self, ids: Iterator[int] | list[int], size: int) -> int:
        """How many of the ids, from the first on, make up so many bytes."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.bytes_of[i])
            n += 1
        if size:
            raise AssertionError("a stop isn't a token boundary")
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TreeCoder:
    """One coder per worker."""
    return TreeCoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids binary`` (little-endian unsigned 32-bit) and ``decoded binary``, a row per input row.

    One narrow pass. Null texts count as empty and have no ids; null and repeated keys are passed on; other
    columns are not read. ``path`` must exist on every executor, as an installed file does.
    """
    rows = prepared(df).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # so that the ids of few texts are held at once
                part = batch.slice(at, 512)
                ids = [made.encode(t) for t in part.column(1).to_pylist()]
                decoded = pa.array([made.decode(i) for i in ids], pa.binary())
                packed = pa.array([np.array(i, "<u4").tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed, decoded], names=["_key", "ids", "decoded"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_key {kind}, ids binary, decoded binary").withColumnRenamed("_key", key)
