"""Overlap of texts: contained quotes, shared word runs and token Jaccard, all as equi-joins on word anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T

#: Words of a quote's anchor; its first and last word may be parts of longer words in the text.
ANCHOR = 3
#: Characters of a word that anchor a quote of one or two words.
LETTERS = 3


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of a word array, space-joined, in order; empty for fewer than n words.

    ``words`` must be a column, not an expression: a lambda evaluates what it holds once per n-gram.
    """
    last = F.size(words) - n
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    )


def gram_rows(rows: DataFrame, key: str, words: Column, n: int, name: str) -> DataFrame:
    """(key, name): each different n-gram of a row's words once; the words are split once a row."""
    split = rows.select(key, words.alias("_words")).where(F.size("_words") >= n)
    return split.select(key, F.explode(F.array_distinct(ngrams(F.col("_words"), n))).alias(name))


def _pieces(word: Column, n: int) -> Column:
    """The different runs of n characters of a word."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(word) - n + 1), lambda i: F.substr(word, i, F.lit(n))))


def contained_quotes(texts: DataFrame, quotes: DataFrame, text_id: str = "doc_id", quote_id: str = "item_id", text_col: str = "text", quote_col: str = "quote") -> DataFrame:
    """(text_id, quote_id) where the text contains the quote, white space normalised on both sides.

    Inner words of a quote stand whole in any text that contains it, so an anchor of up to three of them is
    joined with the texts' n-grams and only those pairs are compared. A quote of one or two words has no
    inner word: its longest word is part of a word of the text, so the vocabulary is joined by runs of its
    letters. All joins are on equal keys; Catalyst broadcasts the anchors below its size threshold and
    shuffles beyond it. The driver reads which anchor lengths occur, four numbers at most.
    """
    own = texts.select(F.col(text_id).alias("_id"), T.normalize_ws(F.col(text_col)).alias("_text"))
    asked = quotes.select(F.col(quote_id).alias("_quote_id"), T.normalize_ws(F.col(quote_col)).alias("_quote")).where("_quote <> ''")
    asked = asked.withColumn("_words", F.split("_quote", " ")).withColumn("_n", F.greatest(F.lit(0), F.least(F.lit(ANCHOR), F.size("_words") - 2)))
    lengths = sorted(r["_n"] for r in asked.select("_n").distinct().collect())
    legs = []
    for n in lengths:
        here = asked.where(F.col("_n") == n)
        if n:
            anchored = here.select("_quote_id", "_quote", F.array_join(F.slice("_words", 2, n), " ").alias("_anchor"))
            legs.append(gram_rows(own, "_id", F.split("_text", " "), n, "_anchor").join(anchored, "_anchor").select("_id", "_quote_id", "_quote"))
            continue
        longest = F.element_at(F.array_sort(F.transform("_words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))), -1)["w"]
        keyed = here.select("_quote_id", "_quote", longest.alias("_part")).withColumn("_piece", F.substr("_part", F.lit(1), F.least(F.lit(LETTERS), F.char_length("_part"))))
        words = own.select("_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("_word")).where("_word <> ''")
        vocabulary = words.select("_word").distinct()
        pieces = vocabulary.select("_word", F.explode(F.flatten(F.array(*[
            F.when(F.char_length("_word") >= k, _pieces(F.col("_word"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, LETTERS + 1)
        ]))).alias("_piece"))
        holds = pieces.join(keyed, "_piece").where(F.contains("_word", "_part")).select("_word", "_quote_id", "_quote").distinct()
        legs.append(words.join(holds, "_word").select("_id", "_quote_id", "_quote").distinct())
    if not legs:
        return own.select(F.col("_id").alias(text_id)).crossJoin(asked.select(F.col("_quote_id").alias(quote_id))).limit(0)
    pairs = reduce(DataFrame.union, legs)
    found = pairs.join(own, "_id").where(F.contains("_text", "_quote"))
    return found.select(F.col("_id").alias(text_id), F.col("_quote_id").alias(quote_id)).distinct()


def shared_runs(questions: DataFrame, texts: DataFrame, length: int = 6, question_id: str = "item_id", text_id: str = "doc_id", col: str = "text") -> DataFrame:
    """(question_id, text_id, run): the question's first run of ``length`` words that the text has too."""
    split = questions.select(question_id, T.word_tokens(F.col(col)).alias("_words"))
    asked = split.select(question_id, F.posexplode(ngrams(F.col("_words"), length)).alias("_pos", "_run"))
    there = gram_rows(texts, text_id, T.word_tokens(F.col(col)), length, "_run")
    return asked.join(there, "_run").groupBy(question_id, text_id).agg(F.min_by("_run", "_pos").alias("run"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; 0 when both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard_pairs(rows: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, jaccard) of the pairs a < b whose token Jaccard is above ``threshold``.

    Prefix filtering: with the tokens of a row ordered from rare to frequent, two rows above the threshold
    share one of their first n - ceil(t n) + 1 tokens, so frequent tokens are hardly ever joined on.
    """
    sets = rows.select(F.col(id_col).alias("id"), F.array_distinct(T.word_tokens(F.col(text_col))).alias("tokens")).where(F.size("tokens") > 0)
    exploded = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    prefix = exploded.join(df, "token").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "token")
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "token")
    sizes_fit = F.least("n_a", "n_b") > F.greatest("n_a", "n_b") * threshold
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & sizes_fit).select("a", "b").distinct()
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("t_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("t_b")), "b")
    return both.select("a", "b", jaccard(F.col("t_a"), F.col("t_b")).alias("jaccard")).where(F.col("jaccard") > threshold)
