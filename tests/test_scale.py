"""Operators that must not depend on how many rows share a value, against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import bm25, evaluation, logs, memory, overlap, prefix, ranking


def test_checksum_sees_every_row(spark):
    """Negative, huge and missing identifiers all count, in any order of rows."""
    rows = [(i, f"t{i}") for i in (1, 5, 2**30, 2**31, -5, -(2**40), 2**62, None)]
    sum_of = lambda r: logs.collection_checksum(spark.createDataFrame(r, "id long, text string"), "id", F.col("text")).first().digest
    whole = sum_of(rows)
    assert sum_of(rows[::-1]) == whole
    for i in range(len(rows)):
        assert sum_of([*rows[:i], (rows[i][0], "other"), *rows[i + 1 :]]) != whole
        assert sum_of(rows[:i] + rows[i + 1 :]) != whole
    assert sum_of([]) == hashlib.sha256(b"").hexdigest()


def test_running_totals_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {(r.g, r.o): (r.v_before, r.v_total) for r in prefix.running_totals(df, ["g"], ["o"], ["v"]).collect()}
    for g, o, _ in rows:
        own = [r for r in rows if r[0] == g]
        assert got[g, o] == (sum(r[2] for r in own if r[1] < o), sum(r[2] for r in own))
    values = [(g, rng.random() if rng.random() < 0.5 else rng.randrange(3) / 1.0) for g, _, _ in rows]
    ranks = prefix.nearest_ranks(spark.createDataFrame([*values, ("a", None)], "g string, x double"), ["g"], "x", (1, 50, 99, 100)).collect()
    for r in ranks:
        own = sorted(x for g, x in values if g == r.g)
        assert r.n == len(own) and [r.p1, r.p50, r.p99, r.p100] == [own[max(1, -(-p * len(own) // 100)) - 1] for p in (1, 50, 99, 100)]
    assert len(ranks) == 3 and prefix.nearest_ranks(df.limit(0), ["g"], "v", (50,)).count() == 0


def test_sweep_of_many_scores(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(300)]
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluation.refusal_sweep(spark.createDataFrame(rows, "score double, expected boolean")).collect()}
    assert set(got) == {s for s, _ in rows} | {float("inf")}
    for t, (tp, fp, fn) in got.items():
        assert (tp, fp, fn) == (sum(e and s < t for s, e in rows), sum(not e and s < t for s, e in rows), sum(e and s >= t for s, e in rows))


def test_split_of_repeated_rows(spark):
    rows = [(i // 2, "x" if i < 60 else None) for i in range(100)]
    got = ranking.stratified_split(spark.createDataFrame(rows, "id int, s string"), ["s"], "id", "seed").collect()
    assert len(got) == 100
    for s, n in (("x", 30), (None, 20)):
        order = sorted({i for i, t in rows if t == s}, key=lambda i: hashlib.sha256(f"seed:{i}".encode()).hexdigest())
        dev = set(order[: int(n * 0.4 + 0.5)])
        assert all((r.split == "dev") == (r.id in dev) for r in got if r.s == s)


def test_quotes_of_any_length(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
    texts = [(i, "  ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(60, None), (61, "")]
    quotes = [(i, " ".join(word() for _ in range(1 + i % 6))) for i in range(60)] + [(60, " "), (61, None), (62, "a\tb")]
    own = lambda s: " ".join(s.split())
    want = {(t, q) for t, text in texts for q, quote in quotes if text and quote and quote.strip() and own(quote) in own(text)}
    got = overlap.contained_quotes(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(quotes, "item_id int, quote string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    none = overlap.contained_quotes(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(1, "")], "item_id int, quote string"))
    assert none.columns == ["doc_id", "item_id"] and none.count() == 0


def test_bm25_without_terms_or_rows(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["c"])], "id int, tokens array<string>")
    got = {r.id: r.score for r in bm25.bm25_scores(docs, ["c", "zz"]).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[4] > 0
    assert bm25.bm25_scores(docs.limit(0), ["c"]).count() == 0 and {r.score for r in bm25.bm25_scores(docs, []).collect()} == {0.0}


def test_spanning_links_keep_components(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g int, v array<double>")
    full = memory.similar_pairs(df, ["g"], "id", "v", 0.9, block=16)
    some = memory.similar_pairs(df, ["g"], "id", "v", 0.9, block=16, spanning=True)
    a, b = ({r.id: r.component for r in memory.components(df.select("id"), p, "id").collect()} for p in (full, some))
    assert a == b and some.count() < full.count()


def test_bm25_reads_the_tokens_once(spark):
    """With a term in over half the rows, which needs the mean idf of the vocabulary, too."""
    read = spark.sparkContext.accumulator(0)

    def words(text):
        read.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, f"the word{i} the") for i in range(20)], "id int, text string")
    scores = bm25.bm25_scores(docs.select("id", F.udf(words, "array<string>")("text").alias("tokens")), ["the"]).collect()
    assert len({r.score for r in scores}) == 1 and scores[0].score > 0 and read.value == 20


def test_compounds(spark):
    """As the plain pattern finds them; one of many parts takes no stack."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1._-é A") for _ in range(rng.randrange(60))) for _ in range(2000)]
    plain = re.compile(r"[a-z0-9]+(?:[._-][a-z0-9]+)+")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.bm25_tokens(F.col("text")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: re.findall("[a-z0-9]+", t.lower()) + plain.findall(t.lower()) for i, t in enumerate(texts)}
    long = spark.range(1).select(F.size(T.bm25_tokens(F.repeat(F.lit("ab-"), 100_000))).alias("n"))
    assert long.first().n == 100_001
