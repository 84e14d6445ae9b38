"""Memory deduplication and guarded SQL on hand-made cases."""

import numpy as np
import pytest

from siftmill.operators import memory
from siftmill.operators.guarded_sql import guarded_sql

SCHEMA = "id long, kind string, v array<double>, a string"


def test_pairs_greedy_components(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    rows = [(i, None if i % 5 == 0 else "k", (base[i % 8] + 0.3 * rng.normal(size=6)).tolist(), "x") for i in range(60)]
    rows += [(100, "k", None, "x"), (101, "k", [0.0] * 6, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v, _ in rows if v and any(v)}
    kind = {r[0]: r[1] for r in rows}
    want = {(a, b) for a in unit for b in unit if a < b and kind[a] == kind[b] and unit[a] @ unit[b] >= 0.9}
    pairs = memory.similar_pairs(df, ["kind"], "id", "v", 0.9, block=7)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want

    kept, label = set(), {r[0]: r[0] for r in rows}
    for i in sorted(label):
        if not any((j, i) in want for j in kept):
            kept.add(i)
    for _ in rows:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id for r in memory.greedy_kept(df, pairs, "id").where("kept").collect()} == kept
    assert {r.id: r.component for r in memory.components(df, pairs, "id").collect()} == label


def test_memory_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    pairs = memory.similar_pairs(df, ["kind"], "id", "v", 0.9)
    assert pairs.collect() == [] == memory.greedy_kept(df, pairs, "id").collect() == memory.components(df, pairs, "id").collect()


def test_guarded_sql(spark):
    assert [r.n for r in guarded_sql(spark, " WITH a AS (SELECT 1 AS n) SELECT n FROM a -- end\n;").collect()] == [1]
    assert guarded_sql(spark, "SELECT id FROM range(500)").count() == 50
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE x", "selection", ""):
        with pytest.raises(ValueError):
            guarded_sql(spark, bad)
    with pytest.raises(ValueError):
        guarded_sql(spark, "SELECT 1", 201)
    with pytest.raises(Exception):
        guarded_sql(spark, "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a")
