"""Every operator on odd tables: nulls anywhere, empty and very long texts, ties, repeats, clashing names, no rows."""

from __future__ import annotations

import public_tokenizers
import pytest

from factloom.llm import bpe, chat_format, exact_dedup, langid, media, near_dedup, packing, pii, repeats, ring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, _text string, _key int, spans string, shard int"
LONG = "Lorem ipsum dolor sit amet, consectetur. " * 8000
ROWS = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG), (1, "one two three four five six"), (7, "one two three  four five six"), (None, "null id"), (None, None), (8, "a@b.co +49 30 123456 10.0.0.1 é ✓ \U0001f600")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if n % 2 else None, None, None, 7, "n", None, 1, "s", 3) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ONE_EACH = {
    "language": lambda df: langid.predict(df, langid.train(df)),
    "near": lambda df: near_dedup.near_dedup(df),
    "pii": lambda df: pii.find_pii(df),
    "bpe": lambda df: bpe.encode(df, BYTES, public_tokenizers.PATTERN),
    "ring": lambda df: ring.shard_by_ring(df, "doc_id", {"text": df["text"]}, shards=3),
    "exact": lambda df: exact_dedup.exact_dedup(df),
    "repeats": lambda df: repeats.remove_repeats(df),
    "sequences": lambda df: media.sequences(df, "doc_id", "text"),
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_a_row_for_each_row(odd, empty, name):
    assert ONE_EACH[name](odd).count() == len(ROWS)
    assert ONE_EACH[name](empty).collect() == []


def test_language_of_nothing(odd):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in ONE_EACH["language"](odd).collect() if r["doc_id"] in (2, 3, 4)}
    assert got == {2: ("und", 0.0), 3: ("und", 0.0), 4: ("und", 0.0)}


def test_near_links_of_odd_rows(odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(odd).collect()]
    assert (7, 2, 1, False) in got and got.count((1, 2, 1, True)) == 2
    assert (5, 6, 5, True) in got and (6, 6, 5, False) in got
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert sum(g[0] is None and g[2] is None for g in got) == 2


def test_exact_groups_of_odd_rows(odd):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()]
    assert sum(g[3] for g in got if g[1] == 7) == 1 and got.count((1, 7, 3, False)) == 2  # the longest original stays
    assert (2, 4, 4, False) in got and (4, 4, 4, True) in got and (None, 4, 4, False) in got
    assert (5, 5, 2, True) in got and (6, 5, 2, False) in got


def test_exact_with_colliding_names(odd):
    key = lambda r: (r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"])
    whole = sorted(map(key, exact_dedup.exact_dedup(odd).collect()))
    assert sorted(map(key, exact_dedup.exact_dedup(odd, hash_bits=1).collect())) == whole


def test_ring_is_level_and_gapless(odd):
    rows = ring.shard_by_ring(odd, "doc_id", {"text": odd["text"]}, shards=3).collect()
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(3)}
    assert sorted(map(len, slots.values())) == [3, 4, 4]
    assert all(v == list(range(len(v))) for v in slots.values())


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd, WORDS, size=64).collect()
    for doc in (2, 3, 4):
        (r,) = [r for r in rows if r["doc_id"] == doc]
        assert (r["start"], r["length"], r["doc_tokens"]) == (0, 1, 1)
    long = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 5)
    assert sum(x[1] for x in long) == long[0][2] and all(a[0] + a[1] == b[0] for a, b in zip(long, long[1:], strict=False))
    assert packing.pack(empty, WORDS).collect() == []


def test_repeats_of_odd_rows(odd):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"])) for r in repeats.remove_repeats(odd).collect()]
    n = len(LONG)
    assert (6, n, n, 1) in got and (5, n, n - 41, 1) in got  # from its second line on, the text repeats its first
    assert (2, 0, 0, 0) in got and (3, 0, 0, 0) in got


def test_chat_with_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, _turns int"
    control = "<|end|><|turn|>x<||<|"
    rows = [(1, 2, "assistant", control, "", 1), (1, 1, "user", None, "", 1), (1, 2, "assistant", control, "", 1), (1, None, None, "first", "", 1), (None, None, None, None, None, None)]
    out = chat_format.format_chats(spark.createDataFrame(rows, schema))
    back = out.select("conv_id", chat_format.read_back(out["formatted"]).alias("t"), chat_format.text_under_mask(out["formatted"], out["segments"]).alias("loss"), "formatted")
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["loss"]) for r in back.collect()}
    assert got[1] == ([("", "first"), ("user", ""), ("assistant", control), ("assistant", control)], control * 2)
    assert got[None] == ([("", "")], "")
    assert chat_format.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_media_of_odd_rows(spark, odd, empty):
    pages = spark.createDataFrame([(1, '<p>a</p><figure><img src="media:sha256:00" alt="x"><figcaption> the  cap </figcaption></figure>b<script>no</script>'), (2, None), (3, "<img alt='no source'><p>c")], "page_id long, html string")
    rows = media.resolve(media.sequences(pages), media.store(empty.selectExpr("text AS payload"))).collect()
    got = sorted((r["page_id"], r["position"], r["kind"], r["text"], r["caption"], r["image"]) for r in rows)
    assert got == [(1, 0, "text", "a", None, None), (1, 1, "media", None, "the cap", None), (1, 2, "text", "b", None, None), (3, 0, "text", "c", None, None)]
    assert media.features(media.sequences(pages), media.store(empty.selectExpr("text AS payload"))).collect() == []
