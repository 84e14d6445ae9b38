"""Files of a folder read as documents, chunked, indexed twice and written."""

import json

import pytest
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import answers, indexing
from siftmill.sources import corpus


def test_folder_to_chunks(spark, tmp_path):
    files = {"a b.txt": "one\r\ntwo  \n\n\n\nthree\n", "sub/g.MD": "# A { #x }\nbody\n## B\nmore", "sub/p.html": "<title>T</title><h1>H</h1><p>x</p>", "skip.bin": "no", "sub/deep/c+d.md": " \n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    read = corpus.read_files(spark, str(tmp_path))
    docs = corpus.documents(read)
    got = {r.source_file: (r.doc_type, [(b.heading, b.path, b.text) for b in r.blocks]) for r in docs.collect()}
    assert got == {
        "a b.txt": ("text", [(None, [], "one\ntwo\n\nthree")]), "sub/g.MD": ("markdown", [("A { #x }", ["A"], "body"), ("B", ["A", "B"], "more")]),
        "sub/p.html": ("html", [("H", ["T", "H"], "x")]), "sub/deep/c+d.md": ("markdown", []),
    }
    chunks = corpus.document_chunks(docs, lambda t: T.fixed_windows(t, 10, 2), "fixed", paths=True)
    rows = sorted((r.source_file, r.ordinal, r.text) for r in chunks.collect())
    assert [r for r in rows if r[0] == "sub/g.MD"] == [("sub/g.MD", 0, "A\n\nbody"), ("sub/g.MD", 1, "A > B\n\nmore")]
    assert corpus.read_files(spark, str(tmp_path), ["sub/**/*.*"], ["**/*.html"]).count() == 2
    corpus.write_documents(docs, str(tmp_path / "out"))
    written = [p.parent.name for p in (tmp_path / "out").rglob("*.json")]
    assert sorted(written) == ["name=a b.txt", "name=sub__deep__c+d.md", "name=sub__g.MD", "name=sub__p.html"] or len(written) == 4
    with pytest.raises(Exception, match="unsupported"):
        corpus.documents(spark.createDataFrame([("x.bin", b"y")], "source_file string, content binary")).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "a b+c.md").write_text("")
    (tmp_path / "d.txt").write_text("x")
    got = {r.source_file: bytes(r.content) for r in corpus.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a b+c.md": b"", "d.txt": b"x"}


def test_index_twice(spark):
    rows = [("a", "f", 0, [1.0, 0.0]), ("b", "f", 1, [1.0, 0.01]), ("c", "g", 0, [0.0, 1.0]), ("c", "g", 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, ordinal int, embedding array<double>")
    index, told = indexing.index_chunks(df.limit(0), df)
    assert {r.chunk_id for r in index.collect()} == {"a", "c"} and told.first().asDict() == {"sources": 2, "chunks": 4, "skipped": 0, "duplicates": 2, "added": 2}
    again, told = indexing.index_chunks(index, df.where("chunk_id <> 'b'"))
    assert again.count() == 2 and told.first().added == 0
    assert [r.chunk_id for r in indexing.chunks_in_order(df.dropDuplicates(["chunk_id"]), "f").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        indexing.copy_collection(df.where("chunk_id = 'a'"), df)


def test_claims_and_refusals(spark):
    df = spark.createDataFrame([("One [1]. Two [2, 1]! Three.", 1), ("One [1]. Two [12].", 2), ("  none ", 3)], "a string, n int")
    assert [r.c for r in df.select(answers.claim_of(F.col("a"), F.col("n")).alias("c")).collect()] == ["One [1]. Two [2, 1]!", "One [1]. Two [12].", "none"]
    said = [("Supported.", True), ("UNSUPPORTED: not supported", False), ("it is supportedly so", False), (None, False)]
    got = spark.createDataFrame([(s,) for s, _ in said], "s string").select(answers.verdict(F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in said]
    scores = spark.createDataFrame([(0.5,), (0.1234567,)], "score double")
    assert abs(answers.config_value(0.12345678, scores) - 0.12345678) < 1e-12
    assert answers.config_value(0.5, scores) == 0.5 and answers.config_value(0.1234569, scores) == 0.1234569
    records = spark.createDataFrame([("i", "m", "lookup", True, None)], "id string, mode string, category string, refused boolean, refused_by string")
    with pytest.raises(Exception, match="disagree"):
        answers.false_refusals(records, ["category"]).collect()
    config = json.dumps({"a": {"b": 3}, "c": "x"})
    wanted = spark.createDataFrame([("a.b", "3"), ("c", "y"), ("d.e", "1")], "key string, expected string")
    assert {r.key: r.served for r in answers.config_mismatches(wanted, F.lit(config)).collect()} == {"c": "x", "d.e": None}
