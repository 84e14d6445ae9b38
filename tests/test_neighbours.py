"""The inverted file of vectors against brute force, and taking in batches against the plain loop."""

import numpy as np
import pytest

from siftmill.operators import indexing, neighbours
from siftmill.operators.neighbours import NeighbourIndex
from siftmill.sources.tables import new_path


def clustered(n, seed=0, width=16):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n // 20 + 1, width))[rng.integers(0, n // 20 + 1, n)] + 0.35 * rng.normal(size=(n, width))


def frame(spark, x, prefix=""):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")


def test_recall_and_exact_search(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "ASKED_BLOCK", 9)
    x = clustered(1500)
    rows = frame(spark, x)
    index = NeighbourIndex(spark, new_path(spark, "n")).build(rows.where("chunk_id % 3 > 0"))
    index.add(rows.where("chunk_id % 3 = 0"))
    index = NeighbourIndex(spark, index.path).open()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = list(range(0, 1500, 50))
    cosines = unit[asked] @ unit.T
    cosines[np.arange(len(asked)), asked] = -2
    truth = {(q, int(i)) for q, row in zip(asked, cosines) for i in np.argsort(-row, kind="stable")[:5]}
    queries = rows.where("chunk_id % 50 = 0")
    exact = {(r["query"], r["id"]) for r in index.nearest(queries, 5, others=True).collect()}
    assert exact == truth
    probed = {(r["query"], r["id"]) for r in index.nearest(queries, 5, 6, others=True).collect()}
    assert len(probed & truth) / len(truth) >= 0.9
    above = {(r["query"], r["id"]) for r in index.above(queries, 0.8).collect()}
    assert above == {(q, int(i)) for q, row in zip(asked, unit[asked] @ unit.T) for i in np.flatnonzero(row > 0.8)} and len(above) > 60


def test_lists_out_of_reach_are_not_read(spark):
    x = np.repeat(np.eye(8), 30, axis=0) + 0.01 * np.random.default_rng(1).normal(size=(240, 8))
    index = NeighbourIndex(spark, new_path(spark, "n")).build(frame(spark, x), lists=8)
    seen = []
    real = index._compared
    index._compared = lambda asked, pick: (seen.append(asked.count()), real(asked, pick))[1]
    assert index.above(frame(spark, x[:1]), 0.9).count() == 30 and seen[0] < len(index.centres)


def plain(stored, chunks, threshold):
    """The reference's loop: (added, skipped, duplicates)."""
    known, kept, skipped, duplicates = dict(stored), {}, 0, 0
    cos = lambda a, b: 0.0 if a is None or b is None or not np.any(a) or not np.any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for i, v in chunks:
        if i in known:
            skipped += 1
        elif i in kept or any(cos(v, w) > threshold for w in [*known.values(), *kept.values()]):
            duplicates += 1
        else:
            kept[i] = v
    return set(kept), skipped, duplicates


@pytest.mark.parametrize("seed", [1, 2])
def test_batches(spark, seed):
    rng = np.random.default_rng(seed)
    x = clustered(160, seed, 4)
    ids = [f"{rng.integers(0, 10**6):06d}" for _ in x]
    chunks = [(i, v.tolist()) for i, v in zip(ids, x)] + [(ids[3], x[5].tolist()), ("zz", [1.0, 2.0, 3.0, 4.0]), ("aa", [2.0, 4.0, 6.0, 8.0]), ("n1", None), ("n2", None), ("o", [0.0] * 4)]
    stored, batch = chunks[:40], chunks[20:]
    schema = "chunk_id string, embedding array<double>, source_file string, ordinal int"
    make = lambda rows: spark.createDataFrame([(i, v, "f", at) for at, (i, v) in enumerate(rows)], schema)
    index = NeighbourIndex(spark, new_path(spark, "n")).build(make(stored))
    after, told = indexing.index_chunks(make(stored), make(batch), threshold=0.9, index=index)
    added, skipped, duplicates = plain(stored, batch, 0.9)
    assert {r.chunk_id for r in after.collect()} - {i for i, _ in stored} == added
    assert told.first().asDict() == {"sources": 1, "chunks": len(batch), "skipped": skipped, "duplicates": duplicates, "added": len(added)}
    assert "aa" not in added  # equal to the earlier zz: the first of the batch stays, not the least identifier
    assert index.vectors().count() == 40 + len(added - {"n1", "n2", "o"})


def test_beaten_asks_the_nearest_list_first(spark):
    """The same queries as by all lists; only those that are above nothing in their nearest list go on, and a block sends a query once."""
    x = clustered(600, 5)
    rows = frame(spark, x)
    index = NeighbourIndex(spark, new_path(spark, "n")).build(rows.where("chunk_id % 3 = 0"))
    asked = rows.where("chunk_id % 3 > 0")
    for threshold in (0.5, 0.95):
        every = index.above(asked, threshold)
        got = [r["query"] for r in index.beaten(asked, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == {r["query"] for r in every.select("query").distinct().collect()}
        assert index.above(asked, threshold, probes=1, once=True).count() <= len(got) <= every.count()
