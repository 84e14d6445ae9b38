"""Markdown sections, semantic chunks, excerpts and renderings on hand-made cases."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from siftmill.operators import excerpts, markdown, rendering, structure

MARKDOWN = "intro\n# A { #a }\nbody a\n```\n# not a heading\n```\n### C\ndeep\n#\nmore\n## B\nbody b\n# D\n"


def test_sections(spark):
    df = spark.createDataFrame([(1, MARKDOWN), (2, "# Only\n"), (3, ""), (4, None), (5, "  ##Tight\r\nx")], "id long, text string")
    got = {r.id: r.s for r in df.select("id", markdown.sections(F.col("text")).alias("s")).collect()}
    assert [(s.heading, s.path, s.text) for s in got[1]] == [
        (None, [], "intro"), ("A { #a }", ["A"], "body a\n```\n# not a heading\n```"), ("C", ["A", "C"], "deep"), ("C", ["A", "C"], "more"), ("B", ["A", "B"], "body b"),
    ]
    assert [(s.heading, s.path, s.text) for s in got[2]] == [("Only", ["Only"], "")]
    assert [(s.heading, s.path, s.text) for s in got[3]] == [(None, [], "")]
    assert got[4] is None
    assert [(s.heading, s.path, s.text) for s in got[5]] == [("Tight", ["Tight"], "x")]


def test_section_chunks(spark):
    df = spark.createDataFrame([(1, "# A\n## B\n" + "x" * 25), (2, None), (None, "y")], "doc_id long, text string")
    got = markdown.section_chunks(df, lambda t: structure.recursive_chunks(t, 10), "r", paths=True).collect()
    assert sorted((r.doc_id or 0, r.ordinal, r.heading, r.chunk) for r in got) == [
        (0, 0, None, "y"), (1, 0, "B", "A > B\n\n" + "x" * 10), (1, 1, "B", "A > B\n\n" + "x" * 10), (1, 2, "B", "A > B\n\n" + "x" * 5),
    ]
    assert len({r.chunk_id for r in got}) == 4


def test_semantic_chunks(spark):
    rows = [(1, 0, "aa", [1.0, 0.0]), (1, 1, "bb", [1.0, 0.1]), (1, 2, "cc", [0.0, 1.0]), (1, 3, "d" * 12, None), (1, 4, None, [0.0, 1.0]), (2, 0, "fits", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc long, at int, s string, v array<double>")
    got = markdown.semantic_chunks(df, "doc", "at", "s", "v", 0.5, 9).collect()
    assert sorted((r.doc, r.ordinal, r.chunk) for r in got) == [(1, 0, "aa bb\n\ncc"), (1, 1, "d" * 9), (1, 2, "d" * 3), (2, 0, "fits")]


def _plain_excerpt(text, terms, limit):
    """Every run of whole lines that fits, tried one by one."""
    lines, best = text.split("\n"), (0, "")
    for a in range(len(lines)):
        fitting = [b for b in range(a + 1, len(lines) + 1) if len(json.dumps("\n".join(lines[a:b]))) - 2 <= limit]
        if fitting:
            own = "\n".join(lines[a : max(fitting)])
            n = len(terms & excerpts.query_terms(own))
            if n > best[0]:
                best = (n, own)
    return best[1]


def test_excerpt():
    text = "\n".join(["nothing here", "alpha beta", 'a "quoted" line', "beta", "gamma é alpha", "", "tail"])
    terms = excerpts.query_terms("Alpha beta GAMMA of it")
    assert terms == {"alpha", "beta", "gamma"}
    for limit in range(12, 60):
        assert excerpts.excerpt(text, terms, limit) == _plain_excerpt(text, terms, limit), limit
    assert excerpts.excerpt("éé" + "x" * 40, terms, 14) == "ééxx"  # six characters for each é
    assert excerpts.excerpt("short", terms, 5) == "short" and excerpts.excerpt("", terms, 0) == ""


def test_fit_hits(spark):
    rows = [("q alpha", "dense", i, f"c{i}", "f.md", None, 1.0 / i, t) for i, t in ((1, "x" * 100), (2, "alpha line\n" * 40), (3, "small"), (4, None))]
    df = spark.createDataFrame(rows, "query string, mode string, rank int, chunk_id string, source_file string, section_heading string, score double, text string")
    got = sorted(excerpts.fit_hits(df, 900).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and [r.complete for r in got] == [True, False, True, True]
    shown = [{"chunk_id": r[3], "source_file": r[4], "section_heading": None, "score": r[6], "complete": g.complete, "text": g.text} for r, g in zip(rows, got)]
    assert len(json.dumps({"query": "q alpha", "mode": "dense", "hits": shown})) <= 900
    assert excerpts.fit_hits(df, 60).count() == 0 and excerpts.fit_hits(df.limit(0)).count() == 0


def test_token_positions(spark):
    words = ["alpha", "beta", "x1", "7"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for dim in (7, 256, 1000):
        got = {r.w: r.p for r in df.select("w", rendering.token_position(F.col("w"), dim).alias("p")).collect()}
        assert got == {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in words}
    docs = spark.createDataFrame([(1, "Alpha alpha beta"), (2, None), (3, "!")], "doc_id long, text string")
    rows = rendering.token_hash_vectors(docs, dim=1000).collect()
    assert {r.doc_id for r in rows} == {1} and sorted(round(r.value * math.sqrt(5)) for r in rows) == [1, 2]


def test_outcomes_and_digest(spark):
    calls = spark.createDataFrame(
        [("t", 3, "write", "success", "a.md"), ("t", 1, "search", "failure", None), ("t", 2, "search", "failure", None), ("t", 4, None, "odd", None)],
        "task string, seq int, tool string, status string, path string",
    )
    assert rendering.tool_outcomes(calls, ["task"], path_col="path").first().outcomes == "search failed x2; write `a.md` succeeded;  odd"
    df = spark.createDataFrame([(["zero", "one  two", "x" * 30, "last"],), ([],)], "lines array<string>")
    got = [r.d for r in df.select(rendering.transcript_digest(F.col("lines"), 3, 32).alias("d")).collect()]
    assert got == ["one two\n" + "x" * 9 + "…\nlast", ""]


def test_words_are_counted_in_their_row(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "B c"), (None, "a"), (None, "a"), (2, "Zoo zoo"), (3, None)], "doc_id long, text string")
    found = rendering.token_hash_vectors(docs, dim=1 << 20)
    at = {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % (1 << 20) for w in ("a", "b", "c", "zoo")}
    root = math.sqrt(6)
    want = {(1, at["a"], 1 / root), (1, at["b"], 2 / root), (1, at["c"], 1 / root), (None, at["a"], 1.0), (2, at["zoo"], 1.0)}
    assert {(r.doc_id, r.position, round(r.value, 9)) for r in found.collect()} == {(i, p, round(v, 9)) for i, p, v in want}
    assert "word" not in found._jdf.queryExecution().optimizedPlan().toString()
