"""The merge index with many runs against brute force, and copies dropped from odd rows."""

import hashlib
import random
from collections import defaultdict

import pytest

from siftmill.llm import lsm_dedup


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize(("memtables", "most_bits"), [(1, None), (7, None), (7, 1 << 4)])
def test_runs_and_filters(spark, monkeypatch, memtables, most_bits):
    """One or many runs, filters that tell digests apart or are given up: the same groups."""
    if most_bits:
        monkeypatch.setattr(lsm_dedup, "MOST_BITS", most_bits)
        monkeypatch.setattr(lsm_dedup, "_CHUNK", 1 << 4)
    rng = random.Random(9)
    texts = [rng.choice(["Same", "same", "SAME ", "Übung", "übung", "", None]) if rng.random() < 0.5 else f"t{rng.randrange(120)}" for _ in range(400)]
    rows = [(None if rng.random() < 0.05 else i, t) for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    for keep, best in (("smallest", min), ("largest", max)):
        got = lsm_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), keep=keep, memtables=memtables).collect()
        want = []
        for i, t in rows:
            ids = [x for x in groups[low(t)] if x is not None]
            stays = best(ids) if ids else None
            want.append((i, stays, len(groups[low(t)]), i == stays, hashlib.sha256(low(t).encode()).hexdigest()))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_dropped_copies_of_clashing_columns(spark):
    """Columns named like the operator's own stay as they are; each text keeps one row of its kept identifier."""
    rows = [(1, "a", "x", 1, "h", None), (2, "A", "y", 2, None, "d"), (2, "A", "y", 2, None, "d"), (3, "b", "z", 3, "h", "d"), (None, "c", "n", 4, "h", "d"), (None, "C", "n", 5, "h", "d"), (4, None, "e", 6, "h", "d"), (5, "", "e", 7, "h", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, digest long, sha string, row string")
    got = sorted(map(tuple, lsm_dedup.drop_copies(df, keep="largest").collect()), key=str)
    ids = [g[0] for g in got]
    assert ids.count(2) == 1 and 1 not in ids and 3 in ids and 5 in ids and 4 not in ids and ids.count(None) == 1
    assert all(g in rows for g in got) and len(got) == 4
    assert lsm_dedup.drop_copies(df.limit(0)).columns == df.columns and lsm_dedup.drop_copies(df.limit(0)).count() == 0
