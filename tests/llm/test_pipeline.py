"""The pipeline's stages on odd rows, and the whole of it against stages worked out by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftmill.llm import ball_simhash, lsm_dedup, storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _language string, _copy int, key string, score double, digest string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    known = [r.text for r in storage.documents(spark, "/root/testdata/sf0.001").where("lang = 'en' AND n_chars > 200").orderBy("doc_id").limit(20).collect()]
    texts = [None, "", " \n", *known, known[0], known[0].upper(), known[1], " ".join(known) * 20, "12 34", "x"]
    rows = [(rng.choice([None, i % 9, i]), t, rng.choice(["en", None]), rng.choice(["a", "b", None]), i, "mine", 7, "k", 0.5, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], SCHEMA)


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows(spark, odd, stage):
    """No stage fails on NULLs, empty and long texts, repeats, clashing columns or an empty table, or makes up rows."""
    name, run = corpus_pipeline.STAGES[stage]
    got, none = run(spark, odd, ""), run(spark, odd.limit(0), "")
    assert none.count() == 0 and none.columns == got.columns
    if stage < 4:
        assert got.columns == odd.columns
        rows, given = Counter(map(tuple, got.collect())), Counter(map(tuple, odd.collect()))
        assert set(rows) <= set(given) and all(rows[r] <= given[r] * (3 if name == "mixing" else 1) for r in rows) and rows
    else:
        assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
        assert got.where("start = 0").count() == odd.count()


def test_whole_pipeline(spark):
    """Every stage on all that the one before kept, by plain Python; pieces hold each kept text whole."""
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(got.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    docs = storage.documents(spark, "/root/testdata/sf0.001")
    told = corpus_pipeline.identify_language(spark, docs, "").collect()
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    last = {}
    for r in told:
        last[low(r.text)] = max(r.doc_id, last.get(low(r.text), -1))
    exact = {r.doc_id: r.text for r in told if last[low(r.text)] == r.doc_id}
    prints = {i: ball_simhash.fingerprint_of(t) for i, t in exact.items()}
    root = {i: i for i in exact}
    while True:
        lower = {i: min(root[j] for j in exact if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in exact}
        if lower == root:
            break
        root = lower
    kept = {i: t for i, t in exact.items() if root[i] == i}
    near = corpus_pipeline.drop_near_copies(spark, lsm_dedup.drop_copies(spark.createDataFrame(told, docs.schema), keep="largest"), "")
    assert {r.doc_id for r in near.collect()} == set(kept)
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, near, "").collect())
    pieces = got.collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == mixed and set(mixed) <= set(kept)
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens * mixed[r.doc_id] for r in pieces)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
