"""The pivot index on vectors of several lengths, and the pivots that its size asks for."""

import numpy as np

from siftmill.llm import pivot_index


def test_lengths_and_components(spark):
    """Vectors of a rarer length are compared too; lengths never meet; large blocks and small give the same."""
    rng = np.random.default_rng(6)
    rows, vectors = [], {}
    for n, count in ((8, 300), (5, 40), (3, 2)):
        base = rng.normal(size=(count // 2, n))
        for i, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])):
            vectors[len(rows)] = v
            rows.append((len(rows), [float(x) for x in v]))
    at = len(rows)
    rows += [(at, rows[0][1]), (at + 1, [0.0] * 8), (at + 2, []), (at + 3, None), (at + 4, [1e300, 1e300, 1e300]), (at + 5, [1e-300] * 3), (None, rows[0][1])]
    vectors |= {at: vectors[0], at + 4: np.ones(3), at + 5: np.ones(3)}
    near = {a: {b for b in vectors if a != b and len(vectors[a]) == len(vectors[b]) and vectors[a] @ vectors[b] >= 0.95 * np.linalg.norm(vectors[a]) * np.linalg.norm(vectors[b])} for a in vectors}
    root = {a: a for a in vectors}
    for _ in vectors:
        root = {a: min([root[a], *(root[b] for b in near[a])]) for a in root}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (16, 64):
        got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df, block=block, nearest=8, shared=1).collect()}
        assert got == {i: (len(near.get(i, ())), root.get(i, i)) if i is not None else (0, None) for i, _ in rows}


def test_recall_of_clustered_vectors(spark):
    """With the pivots that follow from the size, at least 0.9 of the links from 0.95 to 1 are found."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(10, 32))[rng.integers(0, 10, 3000)] * 0.6 + rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x[:1000].shape)
    y -= (y * x[:1000]).sum(1, keepdims=True) * x[:1000]
    c = rng.uniform(0.951, 1, (1000, 1))
    x = np.concatenate([x, c * x[:1000] + np.sqrt(1 - c**2) * y / np.linalg.norm(y, axis=1, keepdims=True)])
    cosine = x @ x.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / 1.0)], "vec_id long, embedding array<double>")
    found = pivot_index.near_vectors(df).selectExpr("sum(n_links)").first()[0]
    true = int(cosine.sum()) - len(x)
    print("recall", found / true)
    assert 0.9 <= found / true <= 1
    assert pivot_index.pivots_for(50_000) == 512 and pivot_index.pivots_for(10) == 128 and pivot_index.pivots_for(10**12) == 8192
