"""Interleaved document sequences: HTML becomes ordered text and media-reference structs; references are
resolved to payloads by a join on their digest, in rows, so that positions and captions stay aligned.

Stored media are grey PNG images with 8-bit samples, ``WIDTH`` samples a row; a payload is any byte string
whose length is a positive multiple of ``WIDTH`` (``padded`` makes one). Equal payloads are stored once, under
their SHA-256.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, Scratch, prepared, spread_join, tidy

#: Samples of an image's row.
WIDTH = 576
SCHEME = "media:sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Elements whose content is not text of the document.
_HIDDEN = frozenset({"script", "style", "template", "noscript", "head"})
#: Elements that end a run of text.
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_MEDIA = frozenset({"img", "video", "audio", "source", "embed"})


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """The payload's bytes as the samples of a grey image, row by row."""
    height, rest = divmod(len(payload), width)
    if rest or not height:
        raise ValueError("a payload's length is a positive multiple of the width")
    press = zlib.compressobj(level)
    parts = [press.compress(b"\0" + payload[at : at + width]) for at in range(0, len(payload), width)]  # filter 0
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join([*parts, press.flush()])) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int, int]:
    """The samples, width and height of an image that ``to_png`` made; checks every chunk's CRC."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not a plain grey image of 8-bit samples")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = zlib.decompress(b"".join(data))
    if len(rows) != height * (width + 1) or any(rows[:: width + 1]):
        raise ValueError("rows are missing or filtered")
    view = memoryview(rows)
    return b"".join([view[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1)]), width, height


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._hidden = self._figure = self._in_caption = 0
        self._first_of_figure = 0
        self._caption: list[str] = []

    def _flush(self) -> None:
        run = " ".join("".join(self._text).split())
        self._text.clear()
        if run:
            self.items.append({"kind": "text", "text": run, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self._hidden += 1
        elif tag == "figure":
            self._flush()
            self._figure, self._first_of_figure = self._figure + 1, len(self.items)
            self._caption.clear()
        elif tag == "figcaption" and self._figure:
            self._flush()
            self._in_caption += 1
        elif tag in _MEDIA and not self._hidden:
            given = dict(attrs)
            if ref := given.get("src"):
                self._flush()
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": given.get("alt") or given.get("title") or None})
        elif tag in _BLOCKS:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "figcaption" and self._in_caption:
            self._in_caption -= 1
        elif tag == "figure" and self._figure:
            self._flush()
            self._figure -= 1
            caption = " ".join("".join(self._caption).split())
            self._caption.clear()
            for item in self.items[self._first_of_figure :] if caption else ():
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag in _BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self._in_caption:
            self._caption.append(data)
        elif not self._hidden:
            self._text.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def parse_html(html: str) -> list[dict]:
    """The document's items in order: runs of text, and media references with their captions (a figure's
    caption before the element's own ``alt`` or ``title``)."""
    made = _Sequence()
    made.feed(html)
    made.close()
    return made.items


ITEMS = "array<struct<kind:string,text:string,ref:string,caption:string>>"


def sequences(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``items``, a row per input row; a null or empty document has no items."""
    rows = prepared(df).select(F.col(key).alias("_key"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    kind = rows.schema["_key"].dataType.simpleString()
    item = pa.struct([(n, pa.string()) for n in ("kind", "text", "ref", "caption")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([parse_html(h) for h in batch.column(1).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["_key", "items"])

    return rows.mapInArrow(tidy(run), f"_key {kind}, items {ITEMS}").withColumnRenamed("_key", key)


def store(payloads: DataFrame, payload: str = "payload", unique: bool = True) -> DataFrame:
    """The media table of a column of payloads: ``digest`` (of the payload) and ``image``, one row per digest.

    Null payloads are left out. Copies are dropped within a task before the shuffle, so a payload that a third
    of all rows share reaches the shuffle once a task. Without ``unique`` there is no shuffle, and a digest has a row, of the
    same image, for each task that met it: enough for ``features``, which moves no images.
    """
    rows = prepared(payloads).select(F.col(payload).cast("binary").alias("_payload")).where(F.col("_payload").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                new = []
                for p in batch.column(0).slice(at, 256).to_pylist():
                    digest = hashlib.sha256(p)
                    if digest.digest() not in done:
                        done.add(digest.digest())
                        new.append((digest.hexdigest(), to_png(p)))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in new], pa.string()), pa.array([i for _, i in new], pa.binary())], names=["digest", "image"])

    made = rows.mapInArrow(tidy(run), "digest string, image binary")
    return made.groupBy("digest").agg(F.first("image").alias("image")) if unique else made


def references(sequences: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per item: ``key``, ``position`` (from 0), ``kind``, ``text``, ``ref``, ``caption``, and the reference's ``digest``
    (null for text and for references to something else). Null and repeated keys are passed on."""
    items = sequences.select(F.col(key), F.posexplode("items").alias("position", "_item")).select(F.col(key), "position", "_item.*")
    return items.withColumn("digest", F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64)))


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id", hot: int = HOT) -> DataFrame:
    """The items of ``references`` with the media table's columns for their digest, but without the digest itself.

    Those columns are null for text and for references that the media table lacks; no item is lost, and rows of null
    or repeated keys are items like any other. The join is on the digest; a digest that very many items refer to
    (``spread_join``) is broadcast to them, so that no task gets them all. With images that is at most ``HOT_KEYS`` of
    them: join the narrow ``features_of`` of each digest instead where images are large.
    """
    scratch = Scratch(sequences.sparkSession, "media")
    items = references(sequences, key)
    refs = scratch.save(items.where("digest IS NOT NULL"))
    asked = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("_copies"))
    known = scratch.save(media.join(asked, "digest"))
    found = spread_join(refs, known, "digest", refs.count(), "left", hot=hot)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in media.schema if f.name != "digest"]
    return items.where("digest IS NULL").select("*", *none).unionByName(found).drop("digest")


def padded(text: Column, width: int = WIDTH) -> Column:
    """UTF-8 bytes of the text (null: none), with bytes 255 up to a positive multiple of ``width``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    more = F.when(n == 0, F.lit(width)).otherwise((width - n % width) % width)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), more.cast("int"))))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features_of(media: DataFrame) -> DataFrame:
    """``digest`` and ``FEATURES`` of each stored image, read back from it; null images are left out.

    ``feature`` is width, height, mean sample in thousandths, and number of distinct samples.
    """
    rows = prepared(media).where(F.col("image").isNotNull()).select("digest", "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["digest", *(f.split()[0] for f in FEATURES.split(", "))]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for image in part.column(1).to_pylist():
                    samples, width, height = from_png(image)
                    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
                    mean = int(counts @ np.arange(256)) * 1000 // len(samples)
                    feature = f"{width}x{height};mean={mean};distinct={np.count_nonzero(counts)}"
                    out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature))
                columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return rows.mapInArrow(tidy(run), f"digest string, {FEATURES}")


def features(sequences: DataFrame, media: DataFrame, key: str = "page_id", hot: int = HOT) -> DataFrame:
    """Of each item with a stored image: ``key``, ``position``, ``caption`` and ``FEATURES``.

    An image is read back once, however many items refer to it; items meet the features by digest, as in ``resolve``. The media
    table may have several rows of one image under a digest.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    narrow = features_of(media).groupBy("digest").agg(*(F.first(n).alias(n) for n in names))
    resolved = resolve(sequences, narrow, key, hot)
    return resolved.where("media_bytes IS NOT NULL").select(key, "position", "caption", *names)
