"""Each stage of the pipeline against brute force on what its predecessor kept; nulls and no rows at all."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import pii

from .test_brute import brute_components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 !!", "en", "x", 5), (None, "null id " * 9, None, None, 3)], docs.schema)
    out = [docs.union(odd)]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{at}/{name}"
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert all(tuple(s.columns) == corpus_pipeline.COLUMNS for s in stages[1:-1])


def test_language_rejects_only_texts_without_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert before.keys() - after.keys() == {10**6, 10**6 + 1}
    assert all(after[i]["text"] == before[i]["text"] and after[i]["lang"] for i in after)


def test_exact_copies(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = {}
    for i, r in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append((-len(r["text"]), i is None, i or 0))
    assert after.keys() == {None if null else i for _, null, i in map(min, groups.values())}


def test_near_copies(stages):
    before, after = rows(stages[2]), rows(stages[3])
    texts = {i: r["text"] for i, r in before.items() if i is not None}
    assert after.keys() == {i for i, (_, root) in brute_components(texts, 80).items() if i == root} | {None}


def test_stages_drop_only_rejected_rows(spark, stages):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    given = [(1, one), (1, one), (None, two), (None, two), (None, three), (2, one), (2, "another text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in given], stages[0].schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.exact_copies(spark, docs, DATA).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (None, two), (None, three), (2, "another text of its own")], key=str)
    given = [(None, one + " end"), (7, one), (7, two), (None, three), (None, three + " end"), (None, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in given], stages[0].schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, DATA).collect()]
    assert len(got) == 4 and {(7, one), (7, two), (None, "a text of its own")} < set(got)


def test_personal_data(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r["text"] == pii.redact(before[i]["text"], pii.find_spans(before[i]["text"]))
        assert r["n_chars"] == len(r["text"]) and not pii.find_spans(r["text"])


def test_packing(stages):
    before, pieces = rows(stages[4]), stages[5].collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in before.items():
        own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        n = len(whole.encode(r["text"], add_special_tokens=False).ids) + 1
        assert sum(x[1] for x in own) == n and all(x[2] == n for x in own)
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_no_rows(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.collect() == []


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == stages[-1].columns and got.count() > 0
