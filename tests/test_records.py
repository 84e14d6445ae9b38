"""JSON lines over splits, trees of JSON, verdict keys, rerankers."""

import hashlib
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from siftmill.operators import rerank, trees
from siftmill.plans import record_queries
from siftmill.sources import jsonlines


def test_line_numbers_over_splits(spark, tmp_path):
    rng = random.Random(1)
    texts = {}
    for name in ("a.jsonl", "b c.jsonl"):
        texts[name] = [rng.choice(["", "  ", json.dumps({"id": f"q{rng.randrange(60)}", "n": i, "v": rng.choice([1, 2.5, "x", None])}), "{bad", "[1, 2]", '"text"']) for i in range(300)]
        (tmp_path / name).write_text("\n".join(texts[name]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        lines = jsonlines.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.line): r.text for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): t for name, own in texts.items() for i, t in enumerate(own, 1)}
    found = jsonlines.records(lines)
    want = set()
    for name, own in texts.items():
        seen = {}
        for i, t in enumerate(own, 1):
            if not t.strip():
                continue
            if t == "{bad":
                want.add((name, i, "invalid JSON"))
            elif not t.startswith("{"):
                want.add((name, i, "not a JSON object"))
            else:
                row = json.loads(t)
                if row["id"] in seen:
                    want.add((name, i, f"duplicate id (first on line {seen[row['id']]})"))
                seen.setdefault(row["id"], i)
                if not isinstance(row["v"], (int, float)):
                    want.add((name, i, "v is not of type double"))
    assert {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.line, r.message) for r in jsonlines.findings(found, {"id": "string", "v": "double"}).collect()} == want
    last = {(r.path.rsplit("/", 1)[1].replace("%20", " "), r.id): r.line for r in jsonlines.latest_records(found, {"id": "$.id string"}).collect()}
    assert last == {(name, json.loads(t)["id"]): i for name, own in texts.items() for i, t in enumerate(own, 1) if t.startswith("{") and t != "{bad"}
    assert jsonlines.findings(found.limit(0), {"id": "string"}).count() == 0


def test_many_logs_in_a_file(spark, tmp_path):
    """Logs in turns in one file of many splits, and one of a name of its own in another."""
    rng, logs, packed = random.Random(2), {}, []
    for i in range(600):
        name = rng.choice(("a", "a", "b", "")) if i < 300 else "c"
        logs.setdefault(name, []).append(rng.choice(("", "x\ty", json.dumps({"id": i}))))
        packed.append(f"{name}\t{logs[name][-1]}")
    (tmp_path / "1.txt").write_text("\n".join(packed[:300]) + "\n")
    (tmp_path / "2.txt").write_text("\n".join(packed[300:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = {(r.path, r.line): r.text for r in jsonlines.numbered_lines(spark, str(tmp_path), named=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, i): t for name, own in logs.items() for i, t in enumerate(own, 1)}


def test_logs_of_many_users_are_few_files(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    rows = [(i, i % 500, "view", float(i), '{"k": %d}' % i) for i in range(1000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "sf" / "events.parquet"))
    lines = record_queries._lines(spark, str(tmp_path / "sf"))
    assert lines.select("path").distinct().count() == 500 and lines.count() == 1000 + 334
    shared = spark.conf.get("spark.checkpoint.dir")
    newest = max(Path(shared, "siftmill").glob("lines-*/*.txt"), key=lambda p: p.stat().st_mtime).parent
    assert len(list(newest.glob("*.txt"))) <= 8


def test_a_line_is_parsed_once(spark):
    texts = ['{"id": "a"}', " \t\x0b", "", None, "{bad", "[1]", "null", '\u00a0', '"x"', '{"id": "b"} ']
    found = jsonlines.records(spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "path string, line long, text string"))
    assert {r.line: (r.record and r.record.toJson(), r.error) for r in found.collect()} == {
        0: ('{"id":"a"}', None), 4: (None, "invalid JSON"), 5: (None, "not a JSON object"), 6: (None, "not a JSON object"),
        7: (None, "invalid JSON"), 8: (None, "not a JSON object"), 9: ('{"id":"b"}', None),
    }
    last = jsonlines.latest_records(found, {"id": "$.id string"})
    assert {(r.id, r.line) for r in last.collect()} == {("a", 0), ("b", 9)}
    assert last._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_tree_differences(spark):
    a = {"x": 1, "y": {"z": [1, {"q": None}], "e": {}}, "t": "1", "r": 1.50, "same": [True]}
    b = {"x": 2, "y": {"z": [1, {"q": 0}, 3], "e": {}}, "t": 1, "r": 1.5, "same": [True]}
    make = lambda *rows: spark.createDataFrame(rows, "k int, j string")
    got = trees.differences(make((1, json.dumps(a)), (2, '{"only": "here"}'), (3, "not json")), make((1, json.dumps(b)), (3, "5")), ["k"], "j")
    assert {tuple(r) for r in got.collect()} == {
        (1, "x", "value", "1", "2"), (1, "y.z[1].q", "type", "null", "0"), (1, "y.z[2]", "added", None, "3"), (1, "t", "type", '"1"', "1"),
        (2, "only", "missing", '"here"', None), (3, "", "added", None, "5"),
    }
    assert trees.differences(make((1, json.dumps(a))), make((1, json.dumps(dict(reversed(a.items()))))), ["k"], "j").count() == 0
    assert [r.c for r in spark.createDataFrame([('{"b": 1,  "a": [1,2]}',), ("{",), (None,)], "j string").select(trees.canonical(F.col("j")).alias("c")).collect()] == ['{"a":[1,2],"b":1}', None, None]


def test_verdict_keys_and_cache(spark):
    texts = ["plain", 'say "yes"\\\n\t', "é ü — 中 😀 \x01 \x7f", "", None, "/slash"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, user string")
    key = trees.content_address({"user": F.col("user"), "model": F.lit("m"), "system": F.lit("s")})
    want = [hashlib.sha256(json.dumps({"model": "m", "system": "s", "user": t}, sort_keys=True).encode()).hexdigest() for t in texts]
    assert [r.k for r in df.orderBy("i").select(key.alias("k")).collect()] == want
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5), (None, 6)], "key string, n int")
    told, misses = trees.cached_verdicts(asked, spark.createDataFrame([("a", "yes"), ("a", "yes"), ("z", "no")], "key string, verdict string"))
    assert {r.n: (r.verdict, r.hit) for r in told.collect()} == {1: ("yes", True), 2: ("yes", True), 3: (None, False), 4: (None, False), 5: (None, False), 6: (None, False)}
    assert {(r.key, r.asked, r.example.n) for r in misses.collect()} == {("b", 2, 3), ("c", 1, 5)}


def test_rerank(spark):
    leg = lambda *rows: spark.createDataFrame(rows, "q int, id string, rank int, text string")
    dense, sparse = leg((1, "a", 1, "dense a"), (1, "b", 2, None), (2, "a", 1, "alone")), leg((1, "a", 2, "sparse a"), (1, "b", 1, "sparse b"), (1, "c", 3, "red fox here"))
    hits = rerank.resolved(dense, sparse, ["q"])
    assert {(r.q, r.id): (r.dense_rank, r.sparse_rank, r.text) for r in hits.collect()} == {
        (1, "a"): (1, 2, "dense a"), (1, "b"): (2, 1, None), (1, "c"): (None, 3, "red fox here"), (2, "a"): (1, None, "alone"),
    }
    order = [(r.q, r.id) for r in rerank.fused(hits, ["q"], top=2).orderBy("q", F.desc("fused"), "id").collect()]
    assert order == [(1, "a"), (1, "b"), (2, "a")]
    best = rerank.reranked(rerank.fused(hits, ["q"]).withColumn("query", F.lit("the red fox")), ["q"], "query", rerank.OverlapScorer, top=2).orderBy("q", "place").collect()
    assert [(r.q, r.id) for r in best] == [(1, "c"), (1, "b"), (2, "a")] and abs(best[0].score - 1 / (1 + 2.718281828459045 ** -(2 - 0.012))) < 1e-12
    assert best[1].score == 0.5 and best[1].text is None
