import sys
sys.path.insert(0, "tests")
import numpy as np
import pytest
import zlib
from collections import defaultdict

from oracle import compare
from siftmill.llm import ball_simhash, hyperdim_lang, lsm_dedup, registry, slack_packing, systematic_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string"
ODD = [
    (1, None, "en", "a", 0, "x", "y"), (2, "", "en", None, 0, "x", "y"), (3, "  \t", None, "a", 3, None, None),
    (4, "Hello World again", "en", "b", 1, "x", "y"), (5, "hello world AGAIN", "en", "b", 1, "x", "y"), (5, "hello world AGAIN", "en", "b", 1, "x", "y"),
    (None, "hello world again", "en", None, 1, "x", "y"), (7, "É é", "fr", "c", 1, "x", "y"), (8, "é é", "fr", "c", 1, "x", "y"),
    (9, "mot " * 30000, "fr", "c", 1, "x", "y"), (10, "one", "en", "b", 1, "x", "y"), (11, "123 456", "en", "b", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(registry.queries()[name](spark, d), registry.oracle_sql()[name], d)


def test_exact_dedup_odd_rows(spark, odd):
    got = {(r.doc_id, r.text_sha256): r for r in lsm_dedup.exact_dedup(odd).collect()}
    by = {r.doc_id: r for r in got.values()}
    assert by[1].keep_id == by[2].keep_id == 1 and by[1].group_size == 2
    assert by[4].group_size == 4 and by[5].keep_id == 4 and not by[5].kept and by[None].keep_id == 4
    assert by[7].keep_id == 7 and by[8].keep_id == 8
    assert lsm_dedup.exact_dedup(odd.limit(0)).count() == 0
    assert sorted(r.doc_id for r in lsm_dedup.drop_copies(odd).collect()) == [1, 3, 4, 7, 8, 9, 10, 11]


def test_exact_dedup_colliding_digests(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lsm_dedup.exact_dedup(df, digest=lambda t: F.substr(F.sha2(t, 256), F.lit(1), F.lit(0 + 1)).substr(1, 0)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for r in got:
        own = groups[f"text {r.doc_id % 7}"]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))


def brute_simhash(rows):
    import xxhash

    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for a in keys:
        for b in keys:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in keys}


def test_simhash_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    long = max((t for _, t in rows), key=len)
    rows += [(10_000 + k, long + " x" * k) for k in range(3)] + [(20_000, None), (20_001, " "), (20_002, "a"), (20_003, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in ball_simhash.simhash_groups(df).collect()}
    assert got == brute_simhash(rows)


def test_simhash_chain_and_odd_rows(spark, odd):
    prints = [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | (1 << 62) | 1 << 61 | 1 << 60 | 1 << 59, -1]
    df = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")
    from siftmill.llm.graph import connected_components

    roots = {r.node: r.root for r in connected_components(ball_simhash.fingerprint_links(df)).collect()}
    assert len({roots[x] for x in (0, 1, 3, 7, 15, -(1 << 63))}) == 1 and -1 not in roots
    got = ball_simhash.simhash_groups(odd)
    assert got.count() == len(ODD) and got.where("doc_id in (1,2,3)").select("fingerprint").distinct().collect()[0][0] == "0" * 16
    assert ball_simhash.simhash_groups(odd.limit(0)).count() == 0
    assert ball_simhash.drop_near_copies(odd).count() == 8


def test_components_random(spark):
    from siftmill.llm.graph import connected_components

    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_mix(spark, odd):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = systematic_mix.op5_systematic_mix(spark, d).collect()
        per = defaultdict(lambda: [0, 0.0, 0])
        for r in rows:
            assert r.taken <= 3 * r["size"]
            per[r.source_size][0] += r.taken
            per[r.source_size][1] = r.target
            per[r.source_size][2] = max(per[r.source_size][2], r["size"])
        for taken, target, largest in per.values():
            assert abs(taken - target) <= 2 * largest
        print(d, max(abs(t - g) / g for t, g, _ in per.values() if g))
    got = systematic_mix.systematic_copies(odd)
    assert got.count() == len(ODD) and systematic_mix.systematic_copies(odd.limit(0)).count() == 0
    assert systematic_mix.mix_documents(odd).columns == odd.columns


def test_targets_water_fill(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, "e": 0, None: 300}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: share.get(s, 3 * sizes[s]) for s in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in systematic_mix.source_targets(df).collect()}
    assert got == pytest.approx(want)


def test_language(spark, odd):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in hyperdim_lang.op9_hyperdim_lang(spark, d).collect()}
    truth = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [i for i in got if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i].held_out for i in got)
    right = np.mean([got[i].lang_pred == truth[i].lang for i in held])
    print("held-out accuracy", right, min(r.score for r in got.values()))
    assert right > 0.9
    told = hyperdim_lang.identify(odd, hyperdim_lang.learn(odd)).select("doc_id", "language.*").collect()
    assert {r.doc_id: r.lang for r in told}[1] == "und" and {r.doc_id: r.lang for r in told}[11] == "und"
    assert hyperdim_lang.identify(odd, hyperdim_lang.learn(odd.limit(0))).where("language.lang <> 'und'").count() == 0


def test_best_fill_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, 20, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(1, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        used = slack_packing.best_fill(counts, room)
        assert sum(x * n for x, n in used.items()) == max(sums) and all(n <= counts[x] for x, n in used.items())


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(slack_packing.tokenizer_path())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts.items()}
    at, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        at[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(at) == set(ids)
    for i, spans in at.items():
        end = 0
        for s, n in sorted(spans):
            assert s == end and n > 0
            end += n
        assert end == len(ids[i])
    total = 0
    for spans in seqs.values():
        end = 0
        for s, n in sorted(spans):
            assert s == end
            end += n
        assert end <= capacity
        total += end if end & (end - 1) == 0 else capacity
    return sum(map(len, ids.values())) / total


def test_packing(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        print("fill", check_packing(slack_packing.op2_slack_packing(spark, d).collect(), texts))
    odd = {1: None, 2: "", 3: "<|endoftext|> and <|startoftext|>x", 4: "ΣΑΣ İstanbul ﬁn café́ a b 𝔘 ½ x_y it's'll", 5: "word " * 40000, 6: "don't 3rd ¿qué? «x» ​", 7: "\x00 a\x1fb", 8: "日本語 テキスト"}
    df = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    check_packing(slack_packing.pack_documents(df, slack_packing.tokenizer_path()).collect(), odd)
    assert slack_packing.pack_documents(df.limit(0), slack_packing.tokenizer_path()).count() == 0
