"""Sum-of-squares online packing of token documents into fixed windows.

Each task packs its own rows, in their order, without a shuffle. A document longer than a window fills whole
windows first; the rest is an item that goes to the fill level which minimises the sum over levels of the
squared number of partially filled windows. Levels are a count array; placing an item is one vector operation
over it. When a task's rows end, the windows still open are packed anew by cutting: the emptiest windows'
pieces fill up the fullest windows, so a task leaves one partially filled window at most. The same is done when more
than ``OPEN`` windows are open, until half of them are left, so memory is bounded whatever the documents are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepared, tidy

#: A task's windows are numbered from partition << SHIFT.
SHIFT = 33
#: Open windows that a task holds at most.
OPEN = 4096
#: Words whose ids a worker remembers: so many of the newest, and as many older ones.
REMEMBER = 75_000
#: Distinct chunks whose words are found, and texts whose ids are put together, at once.
BLOCK, TEXTS = 8192, 64


#: What the quick way leaves to the library (white space beyond ASCII's common kinds, a capital whose
#: lower case is two characters, code points beyond Latin).
_ODD = r"[\x0b\x1c-\x1f\x{85}\x{a0}\x{130}\x{250}-\x{10ffff}]"


class WordTokenizer:
    """Ids, as little-endian unsigned 32-bit, of texts by a ``tokenizers`` file with end-of-word BPE.

    Its splitting never crosses white space, so a chunk between white space has the same ids wherever it stands.
    Arrow splits many texts into chunks and numbers the distinct ones; the file's own pattern finds the words in their
    lower case; words are remembered, and a new one goes to the library's model. Texts for which the library does more (special tokens, code points beyond Latin, rare white space) go to the
    library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        pattern = json.loads(self._tokenizer.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]
        self._words_of = regex.compile(f"{pattern}| ").findall
        self._model = self._tokenizer.model.tokenize
        # Byte-level letters: printable Latin-1 stands for itself, the other bytes follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self._letters = "".join(letters[b] for b in range(256))
        self._bytes_of = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        # What is asked for again moves on to the newest, the rest is forgotten.
        self._words: dict[str, bytes] = {}
        self._old_words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids_of_chunks(self, chunks: pa.Array) -> list[bytes]:
        """The chunks' ids; the words of ``BLOCK`` of them are found in one search."""
        out: list[bytes] = []
        for at in range(0, len(chunks), BLOCK):
            words, old, parts = self._words, self._old_words, []
            for w in self._words_of(" ".join([*chunks.slice(at, BLOCK).to_pylist(), ""]).lower()):
                if w == " ":
                    out.append(parts[0] if len(parts) == 1 else b"".join(parts))
                    parts = []
                    continue
                ids = words.get(w)
                if ids is None:
                    ids = old.get(w)
                    words[w] = ids = self._word_ids(w) if ids is None else ids
                parts.append(ids)
            if len(words) > REMEMBER:
                self._words, self._old_words = {}, words
        return out

    def _word_ids(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._bytes_of[t.id] for t in self._model(spelt)])

    def ids_of(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, _ODD).to_pylist()
        marked = pc.match_substring(texts, "<|").to_pylist()
        whole = [o or (m and any(s in texts[i].as_py() for s in self._special)) for i, (o, m) in enumerate(zip(odd, marked, strict=True))]
        parted = self._parted(texts.filter(pa.array([not w for w in whole], pa.bool_())))
        return [self._whole(texts[i].as_py()) if w else next(parted) for i, w in enumerate(whole)]

    def _parted(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids are put together for ``TEXTS`` texts at once."""
        if not len(texts):
            return
        lists = pc.ascii_split_whitespace(texts)
        ends = lists.offsets.to_numpy()
        coded = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        ends, indices = ends - ends[0], coded.indices.to_numpy()
        del lists
        ids = self._ids_of_chunks(coded.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        del ids, coded
        starts = np.cumsum(sizes) - sizes
        for first in range(0, len(texts), TEXTS):
            cuts = ends[first : first + TEXTS + 1]
            at = indices[cuts[0] : cuts[-1]]
            lengths = sizes[at]
            after = np.cumsum(lengths)
            shift = starts[at] - (after - lengths)  # 32 bits do for a slice of texts
            out = flat[np.repeat(shift.astype(np.int32), lengths) + np.arange(int(after[-1]) if len(after) else 0, dtype=np.int32)]
            places = np.concatenate([[0], after])[cuts - cuts[0]].tolist()
            for a, b in zip(places[:-1], places[1:], strict=True):
                yield out[a:b].tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker."""
    made = WordTokenizer(path)
    give_back()  # what reading the file took
    return made


class SumOfSquares:
    """Online packing of items of 1 to ``size`` - 1 into windows of ``size``."""

    def __init__(self, size: int):
        self.size = size
        self.open_at = np.zeros(size + 1, np.int64)  # open windows by level; level 0 and full ones count as none
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]  # their numbers by level

    def place(self, item: int) -> tuple[int | None, int]:
        """Number of the open window (None: a new one) and the level that the item goes to."""
        n = self.open_at
        # From level h to h + item: the sum of squares changes by 2 (n[h + item] - n[h]) + 2; a new window leaves no
        # level, a window that becomes full enters none.
        gain = 2 * (n[item : self.size] - n[: self.size - item]) + 2
        gain[n[: self.size - item] == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * n[item] + 1
        best, cost = int(np.argmin(gain)), int(gain.min())
        if n[self.size - item] and -2 * int(n[self.size - item]) + 1 <= cost:
            best = self.size - item
        if best == 0:
            return None, 0
        n[best] -= 1
        return self.windows[best].pop(), best

    def opened(self, window: int, level: int) -> None:
        if level < self.size:
            self.open_at[level] += 1
            self.windows[level].append(window)

    def taken(self) -> list[int]:
        """All open windows, fullest first; none is open then."""
        out = [w for level in range(self.size - 1, 0, -1) for w in self.windows[level]]
        self.open_at[:] = 0
        self.windows = [[] for _ in range(self.size + 1)]
        return out


Piece = tuple[int, int, int]  # document (position in the task), start, length


def pack_lengths(lengths: Iterator[int], size: int, most: int = OPEN) -> Iterator[tuple[int, list[Piece]]]:
    """(window, its pieces in order) for documents of these lengths, each a positive number; windows count from 0.

    A window is given out when it is full, those left open after the last document. At most ``most`` are open.
    """
    packer, contents, made = SumOfSquares(size), {}, 0

    def cut(keep: int) -> Iterator[tuple[int, list[Piece]]]:
        """Pieces of the emptiest windows fill the fullest, cut where they have to be, until ``keep`` are open."""
        nonlocal made
        order, spare = packer.taken(), []
        lo, hi = 0, len(order) - 1
        while lo <= hi and hi - lo + 1 > keep:
            window = order[lo]
            pieces = contents.pop(window)
            room = size - sum(p[2] for p in pieces)
            while room:
                if not spare:
                    if hi <= lo:
                        break
                    spare = contents.pop(order[hi])
                    hi -= 1
                doc, start, n = spare.pop()
                take = min(n, room)
                pieces.append((doc, start, take))
                if take < n:
                    spare.append((doc, start + take, n - take))
                room -= take
            lo += 1
            if room and keep:
                contents[window] = pieces
                packer.opened(window, size - room)
            else:
                yield window, pieces
        if spare:  # what is left of the last window that was taken apart
            window, made = made, made + 1
            if keep:
                contents[window] = spare
                packer.opened(window, sum(p[2] for p in spare))
            else:
                yield window, spare[::-1]
        for window in order[lo : hi + 1]:
            packer.opened(window, sum(p[2] for p in contents[window]))

    for doc, total in enumerate(lengths):
        at = 0
        while total - at >= size:
            yield made, [(doc, at, size)]
            made, at = made + 1, at + size
        if rest := total - at:
            window, level = packer.place(rest)
            if window is None:
                window, made = made, made + 1
            contents.setdefault(window, []).append((doc, at, rest))
            if level + rest == size:
                yield window, contents.pop(window)
            packer.opened(window, level + rest)
            if len(contents) > most:
                yield from cut(most // 2)
    yield from cut(0)


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Documents are the ids of their text and ``end_id``; a null or empty text is the end id alone. All sequences
    are padded to ``size``. Sequence ids are unique, not gapless: the partition number shifted by 33 bits, plus
    the window's number in it. Rows are packed in the order of their input split, so a lost task is repeated with
    the same result. Null and repeated keys are passed on; empty tables have no pieces; other columns are not read.
    Per task, memory holds the ids of the open windows' pieces: with size 2048 at most 32 MB (``OPEN``). The rest of a
    document that waits there is shorter than a window.
    """
    rows = prepared(df).select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = tokenizer(path), TaskContext.get().partitionId() << SHIFT
        held: dict[int, list] = {}  # documents with pieces not given out yet: key, total, bytes of the rest, its start, ids left
        end = np.array([end_id], "<u4").tobytes()
        out: list[list] = [[] for _ in range(7)]
        key_type: list[pa.DataType] = []

        def lengths() -> Iterator[int]:
            n = 0
            for batch in batches:
                key_type[:] = [batch.schema.field(0).type]
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    for k, ids in zip(part.column(0).to_pylist(), made.ids_of(part.column(1)), strict=True):
                        ids += end
                        total = len(ids) // 4
                        held[n] = [k, total, ids, 0, total]
                        n += 1
                        yield total
                        if (doc := held.get(n - 1)) and doc[4] < total:  # keep the rest that is still open, no more
                            doc[3] = total - doc[4]
                            doc[2] = ids[4 * doc[3] :]

        def rows_out() -> pa.RecordBatch:
            types = [key_type[0], *[pa.int64()] * 6]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["_key", *(f.split()[0] for f in SCHEMA.split(", "))])
            for v in out:
                v.clear()
            return batch

        for window, pieces in pack_lengths(lengths(), size):
            offset = 0
            for doc, start, n in pieces:
                k, total, ids, first, left = held[doc]
                crc = zlib.crc32(ids[4 * (start - first) : 4 * (start - first + n)])
                for column, value in zip(out, (k, start, n, crc, total, base + window, offset), strict=True):
                    column.append(value)
                offset += n
                if left == n:
                    del held[doc]
                else:
                    held[doc][4] = left - n
            if len(out[0]) >= 8192:
                yield rows_out()
        if out[0]:
            yield rows_out()

    return rows.mapInArrow(tidy(run), f"_key {kind}, {SCHEMA}").withColumnRenamed("_key", key)
