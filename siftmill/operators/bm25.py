"""Okapi BM25 over a token-array column, as an inverted index of joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.sources.tables import written

# The Okapi constants of the public rank_bm25 package.
K1, B, EPSILON = 1.5, 0.75, 0.25


def term_stats(docs: DataFrame, tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """Per term: document frequency and idf; negative idf becomes EPSILON times the mean idf.

    The counts of the vocabulary are written, as the mean and the rows both read them.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = (
        docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    df = written(df, "vocabulary")
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select(
        "term", "df",
        F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"),
    )


def term_counts(docs: DataFrame, terms: list[str], tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, length, tf, terms): the number of tokens of each row and of each of ``terms`` among them, in their order;
    the row's different tokens."""
    split = docs.select(id_col, F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias("_tokens"))
    n = F.size("_tokens")
    tf = F.array(*[n - F.size(F.array_remove("_tokens", t)) for t in terms])
    return split.select(id_col, n.alias("length"), tf.alias("tf"), F.array_distinct("_tokens").alias("terms"))


def bm25_scores(docs: DataFrame, query_terms: list[str], tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, score) of every document; documents without a query term score 0; repeated query terms count again.

    One pass over the tokens leaves a row a document, written to the shared folder: its numbers, and its
    different terms in a column of their own. The driver reads one row of corpus figures off it, so scores are
    plain arithmetic in the scan of the numbers. Only if a query term is in over half the documents is the mean
    idf of the whole vocabulary needed, and the column of terms is read. Nothing is tokenised again. NULL tokens
    count as none.
    """
    terms = list(dict.fromkeys(query_terms))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    counted = written(term_counts(docs, terms, tokens, id_col), "bm25")
    seen = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avgdl"), *seen).first()
    idf = [math.log(corpus["n"] - corpus[f"df{i}"] + 0.5) - math.log(corpus[f"df{i}"] + 0.5) for i in range(len(terms))]
    if min(idf) < 0:
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        mean = df.agg(F.avg(F.log(F.lit(corpus["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean")).first()["mean"]
        idf = [EPSILON * mean if x < 0 else x for x in idf]
    norm = F.lit(1 - B) + F.lit(B / corpus["avgdl"]) * F.col("length") if corpus["avgdl"] else F.lit(1.0)
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        tf = F.col("tf")[i].cast("double")
        score = score + F.lit(query_terms.count(term) * idf[i] * (K1 + 1)) * tf / (tf + F.lit(K1) * norm)
    return counted.select(id_col, F.when(F.col("length") > 0, score).otherwise(0.0).alias("score"))


def bm25_top_k(docs: DataFrame, query_terms: list[str], k: int = 10, tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """The k best by (score desc, id asc), zero scores included."""
    return bm25_scores(docs, query_terms, tokens, id_col).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
