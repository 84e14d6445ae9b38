"""The kept index against one built anew, its plan, failed writes and merges."""

from collections import Counter

import pyarrow as pa
import pytest

from siftmill.functions import batches
from siftmill.functions import text as T
from siftmill.operators import bm25, inverted
from siftmill.operators.inverted import InvertedIndex
from siftmill.sources.tables import new_path
from pyspark.sql import functions as F

FIRST = [("a", "Worker restarts with FERRY-429 and ferry.worker.concurrency"), ("b", "The worker and the queue"), ("c", None), ("d", "the the the"), ("e", "queue of the day"), (None, "no id")]
SECOND = [("b", "queue queue restarts"), ("f", "FERRY-429 the"), ("d", "x-y the old"), ("d", "x-y the new")]


def anew(spark, rows, query, k=10):
    df = spark.createDataFrame(rows, "id string, text string").select("id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    tokens = spark.range(1).select(T.bm25_tokens(F.lit(query)).alias("t")).first()["t"]
    return [(r.id, round(r.score, 9)) for r in bm25.bm25_top_k(df, tokens, k).collect()]


def found(index, query, k=10):
    return [(r.id, round(r.score, 9)) for r in index.search(query, k).collect()]


@pytest.fixture
def index(spark):
    return InvertedIndex(spark, new_path(spark, "inverted"), buckets=8)


def test_upserts_equal_a_rebuild(spark, index):
    assert found(index, "x") == [] and index.totals() == (0, 0)
    index.upsert(spark.createDataFrame(FIRST, "chunk_id string, text string"))
    now = dict(FIRST[:5])
    queries = ("ferry-429 queue", "the worker the", "absent", "", "THE restarts x-y new old")
    for q in queries[:3]:
        assert found(index, q) == anew(spark, now.items(), q)
    index.upsert(spark.createDataFrame(SECOND, "chunk_id string, text string"))
    now |= {"b": SECOND[0][1], "f": SECOND[1][1], "d": "x-y the old"}  # of one batch's rows of one identifier the greatest text
    index.delete(spark.createDataFrame([("e",), ("nowhere",)], "chunk_id string"))
    del now["e"]
    for merged in (False, True):
        if merged:
            index.merge()
            assert len(index.commits()) == 1
        for q in queries:
            assert found(index, q) == anew(spark, now.items(), q), (merged, q)
        df = bm25.term_stats(spark.createDataFrame([(i, t or "") for i, t in now.items()], "id string, text string").select("id", T.bm25_tokens(F.col("text")).alias("tokens")))
        assert sorted(map(tuple, index.term_frequencies().collect())) == sorted((r.term, r.df) for r in df.collect())
    index.upsert(spark.createDataFrame([("a", "reborn"), ("e", "reborn")], "chunk_id string, text string"))
    now |= {"a": "reborn", "e": "reborn"}
    assert found(index, "reborn ferry-429") == anew(spark, now.items(), "reborn ferry-429")


def test_order_column(spark, index):
    rows = [("a", "zebra", 1), ("a", "ant", 2)]
    index.upsert(spark.createDataFrame(rows, "chunk_id string, text string, at int"), order_col="at")
    assert [i for i, s in found(index, "ant")] == ["a"] and index.postings_of(["zebra"]).count() == 0


def test_a_failed_write_changes_nothing(spark, index, monkeypatch):
    index.upsert(spark.createDataFrame(FIRST, "chunk_id string, text string"))
    before = found(index, "queue the")
    real = spark.createDataFrame

    def failing(data, schema=None, **more):
        if schema and str(schema).startswith("segment int, base"):
            raise OSError("the commit can't be written")
        return real(data, schema, **more)

    monkeypatch.setattr(spark, "createDataFrame", failing)
    with pytest.raises(OSError):
        index.upsert(real(SECOND, "chunk_id string, text string"))
    monkeypatch.undo()
    assert found(index, "queue the") == before
    index.upsert(spark.createDataFrame(SECOND, "chunk_id string, text string"))  # takes the same number
    assert found(index, "x-y") == anew(spark, (dict(FIRST[:5]) | {"b": SECOND[0][1], "f": SECOND[1][1], "d": "x-y the old"}).items(), "x-y")


def test_a_query_reads_its_terms_only(spark, index):
    index.upsert(spark.createDataFrame(FIRST, "chunk_id string, text string"))
    plan = index.postings_of(["queue"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan.replace("EqualTo(term", "In(term")
    assert "regexp" not in index.search("queue the")._jdf.queryExecution().toString()


def test_texts_are_counted_in_bounded_parts(spark):
    texts = ["x" * n for n in (0, 5, 900, 10, 3000, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": pa.array(texts, pa.string())})
    cut = [p.column("text").to_pylist() for p in batches.parts(batch, "text", 1000)]
    assert sum(cut, []) == texts and all(sum(len(t or "") for t in c) <= 2000 for c in cut if 3000 not in map(len, filter(None, c)))
    assert list(batches.parts(batch.slice(0, 0), "text")) == []
    rows = spark.range(40).selectExpr("id", "repeat(concat('w', id, ' '), 20000) text").coalesce(1)
    counted = inverted._counted(rows)
    assert {(r.id, r.length, r.terms[0].tf) for r in counted.collect()} == {(i, 20000, 20000) for i in range(40)}


def test_texts_are_counted_without_python_workers(spark):
    texts = ["b a-b a b b.c a-b", "", "x", "A a a._b ..", "été 1.2.3 1.2 1", "z z " * 3]
    counted = inverted._counted(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert "InArrow" not in counted._jdf.queryExecution().toString() and "Python" not in counted._jdf.queryExecution().toString()
    want = {r.id: Counter(r.tokens) for r in spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.bm25_tokens(F.col("text")).alias("tokens")).collect()}
    assert {r.id: (r.length, {t.term: t.tf for t in r.terms}, len(r.terms)) for r in counted.collect()} == {i: (own.total(), dict(own), len(own)) for i, own in want.items()}
    assert want[0] == {"a": 3, "b": 5, "c": 1, "a-b": 2, "b.c": 1}
