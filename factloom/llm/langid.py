"""Language identification by rank-order n-gram profiles and out-of-place distance.

Training counts the character n-grams (1 to 3, words padded with a space) of all labelled training rows: each
task sums its own counts, Spark sums them up, and the ``profile`` most frequent n-grams of each language, in
rank order, are the model. A document's most frequent n-grams are ranked the same way and compared with each
profile: an n-gram costs the distance between its two ranks, or the profile's length where the profile lacks
it. The language with the least sum wins, ties by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import no_clash, prepared, tidy

#: n-grams of a profile, and of a document that are compared.
PROFILE = 300
#: Languages that a model may have.
LANGUAGES = 2_000
#: Distinct n-grams of a language that a task holds before it hands on its sums.
HOLD = 500_000
#: Code points of a text that are counted at once.
SLICE = 1 << 18
_NO_LETTER = re.compile(r"[\W\d_]")
_BITS = 21  # a code point; three fit into a 64-bit key


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, all else as 0, with a 0 before and after."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_is_letter(codes), codes, 0)


_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """A long text in parts of about ``most`` code points, cut behind a character that is no letter."""
    at = 0
    while len(text) - at > most:
        m = _NO_LETTER.search(text, at + most)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def ngram_keys(text: str) -> np.ndarray:
    """Keys of all n-grams of the text, with repeats; a space belongs to the n-gram of the word next to it."""
    codes = _codes(text)
    keep = np.empty(len(codes), bool)
    keep[:1] = True
    np.logical_or(codes[1:] != 0, codes[:-1] != 0, out=keep[1:])
    c = codes[keep].astype(np.int64)
    letter = c != 0
    c[~letter] = 1  # the space, so that n-grams with it in front differ from shorter ones
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate([c[letter], two, three[letter[1:-1]]])  # no n-gram goes across a word's end


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct keys, sorted, and their counts; a long text is counted slice by slice."""
    found = counts = np.zeros(0, np.int64)
    for part in slices(text):
        keys = np.sort(ngram_keys(part))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        own, n = keys[first], np.diff(np.append(first, len(keys)))
        if len(found):
            found, at = np.unique(np.concatenate([found, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)
        else:
            found, counts = own, n
    return found, counts


def ranked(text: str, most: int) -> np.ndarray:
    """The text's most frequent keys, by count, then by key."""
    found, counts = counted(text)
    if len(found) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        near = counts >= least
        found, counts = found[near], counts[near]
    return found[np.argsort(-counts, kind="stable")][:most]


@dataclass(frozen=True)
class Model:
    """Profiles: for each language its n-gram keys in rank order."""

    languages: tuple[str, ...]
    profiles: tuple[tuple[int, ...], ...]
    length: int

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All profiles' keys, sorted, and the rank of each in each language (``length`` where it lacks it)."""
        keys = np.unique(np.array([k for p in self.profiles for k in p], np.int64))
        ranks = np.full((len(self.languages), len(keys)), -1, np.int64)
        for i, p in enumerate(self.profiles):
            ranks[i, np.searchsorted(keys, np.array(p, np.int64))] = np.arange(len(p))
        return keys, ranks


def train(df: DataFrame, lang: str = "lang", text: str = "text", profile: int = PROFILE) -> Model:
    """Counts over all rows with a language; rows with a null text count nothing. An empty table gives no language.

    The model is collected, so more than ``LANGUAGES`` labels are refused: the column holds something else then.
    """
    rows = prepared(df).where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add_up(name: str) -> None:
            keys, n = np.unique(np.concatenate(waiting.pop(name)), return_counts=True)
            size[name] = 0
            if name in sums:
                old, m = sums[name]
                keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([m, n]), len(keys)).astype(np.int64)
            sums[name] = (keys, n)

        def give(name: str) -> pa.RecordBatch:
            keys, n = sums.pop(name)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in slices(t):
                    keys = ngram_keys(part)
                    waiting.setdefault(name, []).append(keys)
                    size[name] = size.get(name, 0) + len(keys)
                    if size[name] > HOLD:
                        add_up(name)
                        if len(sums[name][0]) > HOLD:
                            yield give(name)
        for name in list(waiting):
            add_up(name)
        for name in list(sums):
            yield give(name)

    sums = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    grams: dict[str, list[tuple[int, int]]] = {}
    found = top.limit(LANGUAGES * profile + 1).collect()  # profile rows for each language
    if len(found) > LANGUAGES * profile:
        raise ValueError(f"more than {LANGUAGES} languages")
    for r in found:
        grams.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    names = tuple(sorted(grams))
    return Model(names, tuple(tuple(g for _, g in sorted(grams[n])) for n in names), profile)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``key``, ``lang_pred``, ``score``: 1 less the distance over the largest possible one; a row per input row.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language. Keys are
    passed on as they are; with ``carry``, the text and those columns follow, unchanged; they must not bear the name of
    another column of the result. No other column is read. Ties go to the language that comes first by name. One narrow pass; the model is a few thousand numbers.
    """
    if carry is not None:
        no_clash((key, text, "lang_pred", "score"), carry)
    names = ["_key", "_text", *(f"_c{i}" for i in range(len(carry or ())))]
    rows = prepared(df).select(key, text, *(carry or ())).toDF(*names)
    kinds = dict(rows.dtypes)
    extra = names[1:] if carry is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = model.table()

        def judge(t: str) -> tuple[str, float]:
            own = ranked(t, model.length)
            if not len(own) or not len(keys):
                return "und", 0.0
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            there = ranks[:, at]
            cost = np.where((keys[at] == own) & (there >= 0), np.abs(there - np.arange(len(own))), model.length)
            sums = cost.sum(axis=1)
            best = int(np.argmin(sums))
            return model.languages[best], 1.0 - float(sums[best]) / (len(own) * model.length)

        for batch in batches:
            found = [judge(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *(batch.column(1 + i) for i in range(len(extra)))],
                names=["_key", "lang_pred", "score", *extra],
            )

    schema = ", ".join([f"_key {kinds['_key']}", "lang_pred string", "score double", *(f"{n} {kinds[n]}" for n in extra)])
    carried = [] if carry is None else [text, *carry]
    return rows.mapInArrow(tidy(run), schema).toDF(key, "lang_pred", "score", *carried)
