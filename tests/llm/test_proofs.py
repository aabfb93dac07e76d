"""Independent proofs: rank distance by plain dictionaries, a ring walked key by key, pieces against the library, features by hand."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import chat_format, common, exact_dedup, langid, media, near_dedup, packing, pii, queries, repeats, ring

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


def grams(text):
    """n-grams of 1 to 3 letters, words padded with a space; the keys that ``langid`` orders ties by."""
    key = lambda g: sum((1 if c == " " else ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    found, word = Counter(), ""
    lowered = "".join(c if c.isalpha() else " " for c in text.lower())
    for word in lowered.split():
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return [k for _, k in sorted((-n, key(g)) for g, n in found.items())], {key(g): n for g, n in found.items()}


def test_language_by_brute_force(spark, documents):
    counts = {}
    for r in documents:
        if r["lang"] is not None and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"])[1])
    profiles = {lang: {k: i for i, (_, k) in enumerate(sorted((-n, k) for k, n in c.items())[: langid.PROFILE])} for lang, c in counts.items()}
    expected = {}
    for r in documents:
        own = grams(r["text"] or "")[0][: langid.PROFILE]
        sums = {lang: sum(abs(p[k] - i) if k in p else langid.PROFILE for i, k in enumerate(own)) for lang, p in sorted(profiles.items())}
        best = min(sums, key=lambda x: (sums[x], x))
        expected[r["doc_id"]] = (best, 1 - sums[best] / (len(own) * langid.PROFILE)) if own else ("und", 0.0)
    got = queries.op2_rank_order_language(spark, DATA).collect()
    assert len(got) == len(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] == expected[r["doc_id"]][0] and r["score"] == pytest.approx(expected[r["doc_id"]][1])


def test_language_ties_go_by_name(spark):
    model = langid.Model(("aa", "bb"), ((97,), (97,)), 3)
    rows = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, "?!")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, model).collect()}
    assert got == {1: "aa", 2: "aa", 3: "und"}


def test_ring_walked_key_by_key(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id")
    hashed = {r[0]: r[1] & (2**64 - 1) for r in rows.select("doc_id", F.xxhash64("doc_id")).collect()}
    shards, vnodes, bits = 16, 64, 14
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - bits), s) for s in range(shards) for v in range(vnodes))
    room = {s: len(hashed) // shards + (s < len(hashed) % shards) for s in range(shards)}
    taken, expected = Counter(), {}
    for doc in sorted(hashed, key=lambda d: (hashed[d] >> (64 - bits), hashed[d] - (2**64 if hashed[d] >> 63 else 0), d)):
        place = hashed[doc] >> (64 - bits)
        clockwise = [s for p, s in nodes if p >= place] + [s for p, s in nodes if p < place]
        shard = next(s for s in clockwise if taken[s] < room[s])
        expected[doc] = (shard, taken[shard])
        taken[shard] += 1
    got = queries.op6_ring_sharding(spark, DATA).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == expected
    assert max(taken.values()) - min(taken.values()) <= 1


def test_ring_query_columns(spark, documents):
    by = {r["doc_id"]: r["text"] for r in documents}
    for r in queries.op6_ring_sharding(spark, DATA).collect():
        raw = (by[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_ring_spreads_rows_without_a_key(spark):
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(id AS STRING) AS text")
    got = ring.shard_by_ring(rows, "doc_id", {"text": F.col("text")}, shards=4).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [750] * 4 and len({r["text"] for r in got}) == 3000
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(750)) for s in range(4))


def test_packing_query_by_piece(spark, documents):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in documents}
    got = queries.op7_sum_of_squares_packing(spark, DATA).collect()
    used, windows = {}, {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        used.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, parts in used.items():
        assert [p for a, n in sorted(parts) for p in range(a, a + n)] == list(range(len(ids[doc])))
    fill = []
    for parts in windows.values():
        assert [p for a, n in sorted(parts) for p in range(a, a + n)] == list(range(sum(n for _, n in parts)))
        fill.append(sum(n for _, n in parts))
    assert used.keys() == ids.keys() and max(fill) <= 2048
    tasks = len({s >> packing.SHIFT for s in windows})
    assert sum(f < 2048 for f in fill) <= tasks  # one partly filled window a task at most


@pytest.mark.parametrize("most", [2, 5, 40])
def test_packing_holds_few_windows(most):
    chance = random.Random(9)
    for size, low, high in ((16, 9, 15), (16, 1, 40), (64, 33, 40)):
        lengths = [chance.randint(low, high) for _ in range(400)]
        given, held, full = 0, 0, 0
        seen, windows = {}, {}

        def feed(lengths=lengths):
            nonlocal given
            for n in lengths:
                given += n
                yield n

        out = 0
        for w, pieces in packing.pack_lengths(feed(), size, most):
            assert w not in windows
            windows[w] = pieces
            out += sum(n for *_, n in pieces)
            held = max(held, given - out)
            full += sum(n for *_, n in pieces) == size
            for doc, start, n in pieces:
                seen.setdefault(doc, []).append((start, n))
        assert out == sum(lengths) and held <= (most + 2) * size + high
        for doc, n in enumerate(lengths):
            assert [p for a, k in sorted(seen[doc]) for p in range(a, a + k)] == list(range(n))
        assert len(windows) - full <= 1


def test_features_by_hand(spark, documents):
    by = {r["doc_id"]: (r["text"] or "").encode() for r in documents}
    for r in queries.op10_interleaved_media(spark, DATA).collect():
        raw = by[r["doc_id"]]
        samples = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert r["feature"] == f"576x{len(samples) // 576};mean={sum(samples) * 1000 // len(samples)};distinct={len(set(samples))}"


@pytest.mark.parametrize("hot", [0, 10**9])
def test_hot_digests(spark, hot):
    payload = lambda b: bytes([b]) * 576
    stored = spark.createDataFrame([(payload(b),) for b in (1, 1, 2)], "payload binary")
    name = lambda b: hashlib.sha256(payload(b)).hexdigest()
    pages = [(i, f'<img src="media:sha256:{name(1 if i else 2)}"><p>t') for i in range(20)] + [(None, f'<img src="media:sha256:{"0" * 64}">')]
    sequences = media.sequences(spark.createDataFrame(pages, "page_id long, html string"))
    rows = media.resolve(sequences, media.store(stored), hot=hot).collect()
    assert len(rows) == 41 and sum(r["image"] is not None for r in rows) == 20
    assert all(media.from_png(bytes(r["image"]))[0] == payload(1 if r["page_id"] else 2) for r in rows if r["image"] is not None)
    found = media.features(sequences, media.store(stored, unique=False), hot=hot).collect()
    assert len(found) == 20 and {r["feature"] for r in found if r["page_id"]} == {"576x1;mean=1000;distinct=1"}


@pytest.mark.parametrize("hot", [0, 3, 10**9])
def test_spread_join(spark, hot):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 8), (2, 4), (3, 1), (9, 2)) for i in range(n)], "k int, i int")
    table = spark.createDataFrame([(1, "a", 8), (2, "b", 4), (3, "c", 1)], "k int, v string, _copies long")
    inner = sorted(tuple(r) for r in common.spread_join(rows, table, "k", 15, hot=hot).collect())
    assert inner == sorted((k, i, v) for k, n, v in ((1, 8, "a"), (2, 4, "b"), (3, 1, "c")) for i in range(n))
    left = common.spread_join(rows, table, "k", 15, "left", hot=hot).collect()
    assert len(left) == 15 and sorted(r["i"] for r in left if r["v"] is None) == [0, 1]


def test_near_components_with_hot_keys(spark):
    text = " ".join(f"w{i}" for i in range(40))
    made = [(i, text if i % 3 else text + f" end{i % 2}") for i in range(60)] + [(100 + i, None) for i in range(9)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    rows = near_dedup.near_dedup(docs, hot=0).collect()
    assert {r["component_id"] for r in rows if r["doc_id"] < 100} == {0} and all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] >= 100)


def test_intersections_are_counted_in_integers():
    sets = [np.arange(5000, dtype=np.uint64), np.arange(100, 5100, dtype=np.uint64), np.arange(10**6, 10**6 + 5, dtype=np.uint64)]
    assert near_dedup.linked_pairs(sets, 96).tolist() == [[False, True, False], [True, False, False], [False] * 3]
    assert not near_dedup.linked_pairs(sets, 97).any()


def test_repeated_and_null_keys_are_documents_of_their_own(spark):
    line, other = "a line that is well over one hundred bytes long, so that its strings count as strings of the text: 12345", "x" * 40
    rows = [(1, line), (1, other), (None, "null " + line), (None, other + "!"), (None, "null " + line), (2, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    n = len(line)
    assert found == sorted([(False, 1, n, 0), (False, 1, 40, 0), (False, 2, 0, 0), (True, 0, n + 5, n), (True, 0, 41, 0), (True, 0, n + 5, n + 5)])


def test_crowded_anchors_are_split(spark):
    chance = random.Random(11)
    passage = "".join(chance.choice("abcdefgh ") for _ in range(180))
    made = {i: "".join(chance.choice("ijklmnop ") for _ in range(60)) + passage[: 180 if i % 2 else 130] + "".join(chance.choice("qrstuvw ") for _ in range(60)) for i in range(120)}
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    wide, narrow = (sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs, crowd=c).collect()) for c in (10**6, 7))
    assert wide == narrow and sum(n > 0 for _, n, _ in wide) >= 119


def test_mask_of_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "﻿" * (i % 3) + f"\U0001f600é<|{i}" * (i % 5)) for i in range(700)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = out.select(chat_format.text_under_mask(F.col("formatted"), F.col("segments")).alias("t")).first()["t"]
    assert got == "".join(t for *_, r, t in rows if r == "assistant")


def test_clashing_names_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", "x", 2)], "doc_id long, text string, score string, shard int")
    for call in (
        lambda: langid.predict(rows, langid.Model((), (), 3), carry=("score",)),
        lambda: pii.find_pii(rows, carry=("text", "spans")),
        lambda: exact_dedup.exact_dedup(rows, carry=("score", "score")),
        lambda: ring.shard_by_ring(rows, "doc_id", {"shard": F.col("shard")}),
    ):
        with pytest.raises(ValueError):
            call()


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = spark.createDataFrame([(str(i), "abc") for i in range(4)], "lang string, text string")
    with pytest.raises(ValueError):
        langid.train(rows, profile=4)


def test_operators_on_a_text_of_many_megabytes(spark):
    rows = spark.range(1).selectExpr("id AS doc_id", "repeat('Ein langer Satz mit 12 Wörtern, a@b.co und mehr. ', 400000) AS text")
    n = 400000 * 49
    assert pii.find_pii(rows).selectExpr("size(spans)").first()[0] == 400000
    assert exact_dedup.exact_dedup(rows).first()["kept"] and near_dedup.near_dedup(rows).first()["n_shingles"] == 9
    assert langid.predict(rows, langid.train(rows.selectExpr("'de' AS lang", "text"))).first()["lang_pred"] == "de"
    assert repeats.remove_repeats(rows).first()["n_bytes"] == n + 400000  # ö takes two bytes
