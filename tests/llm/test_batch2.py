import hashlib

import numpy as np
import pytest
from collections import defaultdict

from siftmill.llm import automaton_dedup, bradley_terry, pivot_index

from test_batch1 import ODD, SCHEMA


def brute_vectors(rows, threshold=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(close, label[None, :], len(ids)).min(1))
        if (low == label).all():
            break
        label = low
    out = {i: (0, i) for i, _ in rows}
    out |= {i: (int(close[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
    return out


def test_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(600)]
    for i in range(600, 900):
        base = np.array(rows[int(rng.integers(0, 600))][1])
        rows.append((i, (base + rng.normal(size=64) * rng.choice([0.1, 0.2, 0.3, 0.35])).astype(np.float32).tolist()))
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(1100 + i, (np.array(rows[4][1]) + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for i in range(150)]
    rows += [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] + [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [1.0] * 3), (2005, []), (2006, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df, block=32).collect()}
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.9 * links and all(got[i][0] <= want[i][0] for i in want)
    print("link recall", sum(n for n, _ in got.values()) / links)
    exact = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df, block=64, nearest=12, shared=1).collect()}
    assert exact == want
    assert pivot_index.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in pivot_index.near_vectors(df.where("vec_id = 2001")).collect()] == [(2001, 0, 2001, True)]


def brute_repeats(rows, width=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("busy, filter_routes", [(1000, 1 << 20), (3, 1 << 20), (3, 0)])
def test_repeats(spark, busy, filter_routes):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(6)]
    rows += [(5000 + i, " ".join(rng.choice(vocabulary, 60))) for i in range(40)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(6000 + i, f"{i} before {passage if i % 3 else passage[: 90 + i]} after {i}") for i in range(30)]
    rows += [(7000, "a " * 300), (7001, "a " * 40), (7002, None), (7003, ""), (None, passage), (7004, passage.upper()), (7004, passage), (7005, "x y " * 20), (7006, "x y " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in automaton_dedup.repeated_words_removed(df, busy=busy, shard_words=2000, filter_routes=filter_routes).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)
    assert automaton_dedup.repeated_words_removed(df.limit(0)).count() == 0


def test_automaton_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        pieces = [([bytes([97 + x]) for x in rng.integers(0, 3, rng.integers(4, 30))], int(d)) for d in rng.permutation(8)]
        automaton = automaton_dedup.SuffixAutomaton()
        for words, d in pieces:
            automaton.add(words, d)
        automaton.settle()
        first = {}
        for words, d in pieces:
            for k in range(len(words) - 3):
                key = tuple(words[k : k + 4])
                first[key] = min(first.get(key, 99), d)
        query = [bytes([97 + x]) for x in rng.integers(0, 3, 60)]
        for e, (size, got) in enumerate(automaton.matches(query, 4)):
            want = first.get(tuple(query[e - 3 : e + 1])) if e >= 3 else None
            assert (got if size == 4 else None) == want


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in bradley_terry.op1_bradley_terry(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    y = np.array([labels[i] for i in held])
    s = np.array([got[i].score for i in held])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    right = np.mean([(got[i].predicted == labels[i]) for i in held])
    print("held out", len(held), "AUC", auc, "accuracy", right)
    assert auc > 0.95 and right > 0.93
    odd = spark.createDataFrame(ODD, SCHEMA)
    none = bradley_terry.learn(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert bradley_terry.score_quality(odd, none, output="s").where("s between 0 and 1").count() == len(ODD)
    labels = spark.createDataFrame([(4, 1), (9, 0), (9, None), (None, 1), (77, 0)], "doc_id long, quality int")
    assert bradley_terry.score_quality(odd.limit(0), bradley_terry.learn(odd, labels), output="s").count() == 0
