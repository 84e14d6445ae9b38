"""Runs against a word-by-word search, and the whole query against the contract read plainly."""

import hashlib
import random
import zlib

import pytest

from siftmill.llm import periodic_runs as pr


def plain_runs(words, least=12):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                stretch = (i, j - i + p)
                if not any(stretch == r[:2] for r in out):
                    out.add((*stretch, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng, texts = random.Random(seed), []
    for _ in range(60):
        words = [rng.choice("ab" if seed % 2 else "abcdef").encode() for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.6:
            words += (words[: rng.randrange(1, 9)] or [b"x"]) * rng.randrange(1, 9) + words[:3]
        texts.append(words)
    texts += [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 300]
    for least in (12, 2):
        assert [[tuple(map(int, r)) for r in found] for found in pr.runs_of(texts, least)] == [plain_runs(t, least) for t in texts]


def test_pieces_of_the_grid(monkeypatch):
    rng = random.Random(5)
    texts = [[rng.choice(b"ab") for _ in range(200)] for _ in range(5)]
    texts = [[bytes([w]) for w in t] for t in texts]
    whole = [r.tolist() for r in pr.runs_of(texts)]
    monkeypatch.setattr(pr, "BLOCK_PAIRS", 7)
    assert [r.tolist() for r in pr.runs_of(texts)] == whole


def test_operator_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b " * 9, "y"), (3, "z " + "a\tb\n" * 6 + "c", "y"), (3, "z " + "a\tb\n" * 6 + "c", "y"), (4, "w" * 50_000 + " q" * 20, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(docs).collect()), key=lambda r: r[0])
    assert got == [
        (0, [(0, 18, 2)], "a b"), (1, [], ""), (2, [], ""), (3, [(1, 12, 2)], "z a b c"), (3, [(1, 12, 2)], "z a b c"), (4, [(1, 20, 1)], "w" * 50_000 + " q"),
    ]
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def contract(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {d.doc_id: contract(d.doc_id, d.text) for d in docs if len(d.text or "") < 3000}  # the plain search is cubic
    got = {r.doc_id: tuple(r) for r in pr.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert {k: got[k] for k in short} == short
    assert sum(r[1] for r in short.values()) > 5
