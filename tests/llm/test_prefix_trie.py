"""The trie against a plain one, with buckets of every size, long shared beginnings and large classes."""

import hashlib
import random
import re
import zlib

import pytest

from siftmill.llm import prefix_trie as pt

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(conversations):
    """Nodes of {conv_id: [(key, words)]}."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        own = sorted(members[path])
        children = [c for c in members if len(c) == len(path) + 1 and c[: len(path)] == path]
        saved = (len(own) - 1) * (path[-1][1] if path else 0) + sum(out[c][6] for c in children)
        ends = ",".join(str(c) for c in own if len(conversations[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[path] = (own[0], len(path), parent, len(own), len(children), sum(out[c][5] for c in children) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def nodes(df):
    return sorted(tuple(r[c] for c in pt.COLUMNS) for r in df.collect())


def sequences(spark, conversations):
    rows = [(c, [k for k, _ in t], [w for _, w in t]) for c, t in conversations.items()]
    return spark.createDataFrame(rows, "conv_id long, codes array<long>, words array<long>")


@pytest.mark.parametrize("local", [0, 5, 4096])
def test_trie(spark, local):
    rng, made = random.Random(local), {}
    start = [(100 + i, i % 4) for i in range(30)]
    for c in range(120):
        turns = [(rng.randrange(3), 2) for _ in range(rng.randrange(0, 6))]
        made[c * 7 + 3] = start[: rng.choice((0, 29, 30))] + turns
    made |= {5000 + c: made[3] for c in range(50)} | {9000: [], 9001: []}
    assert nodes(pt.trie(sequences(spark, made), local)) == plain(made)


def test_large_classes(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    made = {c: [(1, 1)] if c % 3 else [(1, 1), (2, 3)] for c in range(500)}
    assert nodes(pt.trie(sequences(spark, made), 3)) == plain(made)


def test_edges(spark):
    assert pt.trie(sequences(spark, {5: []})).collect() == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
    rows = [(1, 2, "u", "b b", "x"), (1, None, "a", None, "x"), (1, 1, None, "a " * 30_000, "x"), (2, None, "a", "", "x"), (2, 1, "", "a " * 30_000, "x"), (None, 1, "u", "lost", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, codes string")
    assert [r[1:4:2] + (r[6],) for r in nodes(pt.trie(pt.encode(turns)))] == [(0, 2, 30_000), (1, 2, 30_000), (2, 2, 30_000), (3, 1, 0)]
    empty = pt.trie(pt.encode(turns.limit(0)))
    assert empty.columns == pt.COLUMNS and empty.count() == 0


def contract(rows):
    own = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn is not None, r.turn)):
        own.setdefault(r.conv_id, []).append(((r.role or "", r.text or ""), len(WORD.findall(r.text or ""))))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return made


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert nodes(pt.op13_prefix_trie(spark, sf_dir)) == plain(contract(rows))
    partial = [r for r in rows if r.conv_id % 20 != 0 and not (r.conv_id % 3 and r.turn > 1)]  # no beginnings to take; some left without turns
    got = pt.trie(pt.rebuilt(pt.encode(spark.createDataFrame(partial, "conv_id long, turn long, role string, text string"))))
    assert nodes(got) == plain(contract(partial))
