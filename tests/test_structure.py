"""Blocks and chunks on hand-made cases."""

from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import structure


def test_html_sections():
    html = "<title>T</title><nav><p>no</p><h2>Menu</h2></nav><p>before</p><h1>One</h1><ul><li>a<p>b</p></li></ul><script>x</script><h2></h2><p>still</p><h2>Two</h2><pre>c</pre><h1>Three</h1><td>x<!-- y -->z</td>"
    assert structure.html_sections(html) == [
        ("T", ("T",), "before"), ("One", ("T", "One"), "a b\nb"), ("One", ("T", "One"), "still"), ("Two", ("T", "One", "Two"), "c"), ("Three", ("T", "Three"), "x z"),
    ]
    assert structure.html_sections(None) == [] and structure.html_sections("") == [(None, (), "")]
    assert structure.html_sections("<title>T</title><body><div>only <b>plain</b> text<br>here</div></body>") == [("T", ("T",), "only plain text here")]
    assert structure.html_sections("<p>head</p><body><div><p>a</div>b<p>c</body>") == [(None, (), "a\nc")]


def test_recursive_chunks(spark):
    text = "# A\n" + "One two. " * 6 + "\n\n" + "Three four! " * 4 + "\n# B\nshort"
    rows = [(1, text), (2, "x" * 95), (3, "tiny"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.chunks for r in df.select("id", structure.recursive_chunks(F.col("text"), 40).alias("chunks")).collect()}
    assert got[2] == ["x" * 40, "x" * 40, "x" * 15] and got[3] == ["tiny"] and got[4] == [] and not got[5]
    assert all(len(c) <= 40 for c in got[1]) and got[1][-1] == "# B\nshort"
    assert "".join("".join(got[1]).split()) == "".join(text.split())


def test_text_functions(spark):
    rows = [("see [2, 1] and [2]. Not [x]. End.", "my_password = hunter2 ok"), ("none", "nothing here")]
    df = spark.createDataFrame(rows, "answer string, secret string")
    got = df.select(T.citation_indices(F.col("answer")).alias("n"), T.redact(F.col("secret")).alias("r")).collect()
    assert got[0].n == [2, 1] and got[1].n == []
    assert got[0].r == "my_password = [redacted] ok" and got[1].r == "nothing here"


def test_pages_are_parsed_in_bounded_parts(spark, monkeypatch):
    from siftmill.functions import batches

    monkeypatch.setattr(structure, "parts", lambda batch, column: batches.parts(batch, column, 100))
    pages = spark.createDataFrame([(i, f"<h1>t{i}</h1><p>{'x' * i}</p>" if i % 7 else None) for i in range(60)], "page_id long, html string")
    got = {r.page_id: (r.ordinal, r.heading, list(r.path), r.text) for r in structure.html_blocks(pages).collect()}
    assert got == {i: (0, f"t{i}", [f"t{i}"], "x" * i) for i in range(60) if i % 7}
