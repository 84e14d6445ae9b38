"""A golden set of questions: what may be drafted from, what a draft is flagged for, findings, quotas and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import overlap
from siftmill.operators.prefix import joined_on, running_totals

# Limits of chunks, quotes and questions, and the kinds of questions without an answer.
MIN_CHARS, MAX_CODE, QUOTE_CHARS, LEAK_WORDS, SAME, SERVED = 300, 0.6, (12, 120), 6, 0.6, 2
NO_ANSWER_KINDS = ("near-miss", "knows-elsewhere", "out-of-scope")


def eligible(chunks: DataFrame, quotes: DataFrame, chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks long enough, with little enough code and without any of the quotes, to draft a question from."""
    fit = chunks.where((F.char_length(text) >= MIN_CHARS) & (T.code_share(F.col(text)) <= MAX_CODE))
    used = overlap.contained_quotes(fit, quotes, chunk_id, "item_id", text, "quote")
    return fit.join(used.select(chunk_id), chunk_id, "left_anti")


def draft_flags(drafts: DataFrame) -> DataFrame:
    """``drafts`` (draft_id, question, quote, chunk_text) with ``flags``: the quote isn't in the chunk, its length, a leak of words, an earlier question like it."""
    leaks = overlap.shared_runs(
        drafts.select("draft_id", F.col("question").alias("text")), drafts.select(F.col("draft_id").alias("_chunk"), F.col("chunk_text").alias("text")), LEAK_WORDS, "draft_id", "_chunk"
    ).where(F.col("draft_id") == F.col("_chunk")).select("draft_id", F.lit(True).alias("_leak"))
    alike = overlap.jaccard_pairs(drafts, SAME, "draft_id", "question").groupBy(F.col("b").alias("draft_id")).agg(F.lit(True).alias("_alike"))
    quote = T.normalize_ws(F.col("quote"))
    inside = F.coalesce(F.contains(T.normalize_ws(F.col("chunk_text")), quote) & (quote != ""), F.lit(False))
    flags = F.array_compact(F.array(
        F.when(~inside, "quote_not_in_chunk"), F.when(~F.coalesce(F.char_length(quote).between(*QUOTE_CHARS), F.lit(False)), "quote_length"),
        F.when(F.col("_leak"), "leak"), F.when(F.col("_alike"), "duplicate"),
    ))
    return drafts.join(leaks, "draft_id", "left").join(alike, "draft_id", "left").withColumn("flags", flags).drop("_leak", "_alike")


def findings(questions: DataFrame) -> DataFrame:
    """(line, id, message) of rows (line, id, question, category, split, n_quotes) that break a rule; a repeated id names its first line."""
    rules = [
        (F.coalesce(F.trim("id"), F.lit("")) == "", "no id"), (F.coalesce(F.trim("question"), F.lit("")) == "", "no question"),
        (~F.coalesce(F.col("category").isin("lookup", "multi_hop", "no_answer", "ambiguous"), F.lit(False)), "unknown category"),
        (~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)), "unknown split"),
        ((F.col("category") == "no_answer") & (F.col("n_quotes") > 0), "evidence for a question without an answer"),
        ((F.col("category") != "no_answer") & (F.col("n_quotes") == 0), "no evidence"),
    ]
    broken = questions.select("line", "id", F.explode(F.array_compact(F.array(*[F.when(rule, message) for rule, message in rules]))).alias("message"))
    firsts = questions.where("id IS NOT NULL").groupBy("id").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = questions.join(firsts, "id").where(F.col("line") > F.col("_first")).select("line", "id", F.concat(F.lit("id of line "), F.col("_first").cast("string")).alias("message"))
    return broken.union(twice)


def corpus_findings(quotes: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """(item_id, n, message) of quotes in no chunk, or in more than two."""
    served = overlap.contained_quotes(chunks, quotes, chunk_id).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    counted = quotes.select("item_id").join(served, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
    told = F.when(F.col("n") == 0, "in no chunk").when(F.col("n") > SERVED, "in more than two chunks")
    return counted.withColumn("message", told).where("message IS NOT NULL")


def coverage(questions: DataFrame, by: list[str], targets: dict[str, int]) -> DataFrame:
    """(by..., n, target): numbers of questions in all, by each column and by all, with the targets of the first column."""
    sets = [[], [by[0]], by]
    table = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    counted = questions.groupingSets(sets, *by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    only = (1 << (len(by) - 1)) - 1
    return counted.withColumn("target", F.when(F.col("_level") == only, F.try_element_at(table, F.col(by[0])))).drop("_level")


def no_answer_kind(notes: Column, category: Column | None = None) -> Column:
    """The word before the first colon of the notes, if it is a known kind, else ``unlabelled``; NULL for a ``category`` other than no_answer."""
    word = F.trim(F.split_part(F.coalesce(notes, F.lit("")), F.lit(":"), F.lit(1)))
    kind = F.when(word.isin(*NO_ANSWER_KINDS), word).otherwise("unlabelled")
    return kind if category is None else F.when(category == "no_answer", kind)


def first_of_files(chunks: DataFrame, seed: str, file: str = "source_file", order: str = "ordinal") -> DataFrame:
    """The first chunk of each file, with the file's place by seeded hash within its top folder."""
    firsts = chunks.groupBy(file).agg(F.min_by(F.struct(*[c for c in chunks.columns if c != file]), order).alias("_first")).select(file, "_first.*")
    top = F.when(F.col(file).contains("/"), F.split_part(F.col(file), F.lit("/"), F.lit(1))).otherwise("")
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(file)), 256)))
    return firsts.withColumn("folder", top).withColumn("place", place)


def stratified_sample(rows: DataFrame, strata: list[str], id_col: str, seed: str, quota: int) -> DataFrame:
    """``quota`` rows dealt over the strata by largest remainder (ties to the first name), by seeded hash within each.

    The windows run over one row a stratum, and over a stratum only as a top-k, which Spark cuts in each task.
    """
    counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    exact = counts.withColumn("_exact", F.lit(quota) * F.col("_n") / F.sum("_n").over(Window.partitionBy()))
    left = F.lit(quota) - F.sum(F.floor("_exact")).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), *strata))
    shares = exact.withColumn("_left", left).withColumn("_place", place).select(*strata, (F.floor("_exact") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)).alias("_share"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(order))).where(F.col("_rank") <= quota)
    return joined_on(ranked, shares, strata).where(F.col("_rank") <= F.col("_share")).drop("_rank", "_share")


def next_number(ids: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """One row: one more than the largest number among identifiers of the prefix; 1 without any."""
    number = F.try_to_number(F.regexp_extract(F.col(id_col), f"^{prefix}(\\d{{1,18}})$", 1), F.lit("9" * 18)).cast("long")
    return ids.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def promoted(golden: DataFrame, candidates: DataFrame, id_col: str, strata: list[str], seed: str, dev_share: float = 0.4) -> DataFrame:
    """``golden`` with the verified candidates that it lacks, which get splits so that each stratum has its share of dev.

    Rows that have a split keep it. A stratum's new rows, by seeded hash, fill dev up to round-half-up of its
    share and are test beyond. NULL is a stratum; rows are numbered by ranges, so a stratum isn't one task's.
    """
    fresh = candidates.where("verified").join(golden.select(id_col), id_col, "left_anti")
    had = golden.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("split") == "dev").alias("_dev"))
    new = joined_on(fresh.groupBy(*strata).agg(F.count(F.lit(1)).alias("_new")), had, strata, "left")
    room = new.select(*strata, (F.floor((F.col("_new") + F.coalesce("_n", F.lit(0))) * dev_share + 0.5) - F.coalesce("_dev", F.lit(0))).alias("_room"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    numbered = running_totals(fresh.withColumn("_order", order).withColumn("_one", F.lit(1)), strata, ["_order", id_col], ["_one"])
    placed = joined_on(numbered, room, strata)
    return golden.unionByName(placed.withColumn("split", F.when(F.col("_one_before") < F.col("_room"), "dev").otherwise("test")).select(golden.columns))


def quote_lines(text: Column, quote: Column) -> Column:
    """struct(first, last): the shortest run of lines, from 1, whose text holds the quote, white space normalised; the
    first of equally short ones, NULL without one.

    From each line on, the rest of the text is searched once for the quote; where it starts within that line, the
    run ends with the line that its last character is in, however many lines that takes.
    """
    lines, asked = F.transform(F.split(text, "\n"), T.normalize_ws), T.normalize_ws(quote)

    def run(lines: Column, at: Column) -> Column:
        rest = F.filter(F.transform(F.slice(lines, at, F.size(lines)), lambda line, i: F.struct(line.alias("line"), (at + i).alias("number"))), lambda x: x["line"] != "")
        place = F.position(asked, F.array_join(F.transform(rest, lambda x: x["line"]), " "))
        begins = (F.get(lines, at - 1) != "") & (place > 0) & (place <= F.char_length(F.get(lines, at - 1)))

        def reach(state: Column, x: Column) -> Column:
            used = state["used"] + F.char_length(x["line"]) + 1
            last = F.when(state["last"].isNull() & (used >= place + F.char_length(asked)), x["number"]).otherwise(state["last"])
            return F.struct(used.alias("used"), last.alias("last"))

        last = F.aggregate(rest, F.struct(F.lit(0).alias("used"), F.lit(None).cast("int").alias("last")), reach)["last"]
        return F.when(begins, F.struct((last - at).alias("n"), at.alias("first"), last.alias("last")))

    runs = F.get(F.transform(F.array(lines), lambda own: F.transform(F.sequence(F.lit(1), F.size(own)), lambda at: run(own, at))), F.lit(0))
    best = F.array_min(F.array_compact(runs))
    return F.when(best.isNotNull() & (asked != ""), F.struct(best["first"].alias("first"), best["last"].alias("last")))
