"""Answers: contexts, citations and their verdicts, and the scores of recorded answers and refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import text as T
from siftmill.operators import evaluation as E
from siftmill.operators.prefix import joined_on, medians, nearest_ranks, running_totals
from siftmill.operators.rendering import source_label

# The refusal asked of a model, a passing rating, and the decimals of a configured threshold.
REFUSAL_OPENING = "i don't know based on the provided documentation"
PASS_RATING, CONFIG_DIGITS = 4, (6, 9, 12)
# The wording around contexts and claims.
PROMPT_ORDER = ("Context passages:\n\n", "\n\nQuestion: ", "\n\nAnswer using only the context above, with [n] citations.")


def context_blocks(contexts: DataFrame, by: list[str], rank: str, source: str, heading: str, page: str, text: str) -> DataFrame:
    """(by..., contexts): each passage as ``[n] (label)`` and its text, numbered by rank, parted by empty lines."""
    block = F.struct(F.col(rank).alias("rank"), source_label(F.col(source), F.col(heading), F.col(page)).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = contexts.groupBy(*by).agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    shown = F.transform("_blocks", lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), b["label"], F.lit(")\n"), b["text"]))
    return ordered.select(*by, F.array_join(shown, "\n\n").alias("contexts"))


def grounded_prompt(contexts: Column, question: Column) -> Column:
    start, middle, end = PROMPT_ORDER
    return F.concat(F.lit(start), contexts, F.lit(middle), question, F.lit(end))


def judge_prompt(claim: Column, source_text: Column) -> Column:
    return F.concat(F.lit("CLAIM:\n"), claim, F.lit("\n\nSOURCE:\n"), source_text)


def refusal_form(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, without quotes and emphasis around it."""
    straight = F.translate(text, "‘’“”", "''\"\"")
    return F.lower(F.regexp_replace(T.normalize_ws(straight), "^[\"'*_` ]+|[\"'*_` ]+$", ""))


def is_refusal(text: Column) -> Column:
    """Whether an answer starts with the refusal's first sentence, however it is quoted or spaced."""
    return refusal_form(text).startswith(REFUSAL_OPENING)


def claim_of(answer: Column, number: Column) -> Column:
    """The sentences that cite ``number``, joined by spaces; the whole answer where none does."""
    marker = F.concat(F.lit(r"\[\s*(?:\d+\s*,\s*)*"), number.cast("string"), F.lit(r"(?:\s*,\s*\d+)*\s*\]"))
    cited = F.filter(F.split(answer, r"(?<=[.!?])\s+"), lambda s: F.regexp_like(s, marker))
    claim = F.regexp_replace(F.array_join(cited, " "), r"^\s+|\s+$", "")
    return F.when(claim != "", claim).otherwise(F.regexp_replace(answer, r"^\s+|\s+$", ""))


def verdict(reply: Column) -> Column:
    """True only for a reply that says supported and not unsupported, as words of any case."""
    says = lambda word: F.regexp_like(reply, F.lit(rf"(?i)\b{word}\b"))
    return F.coalesce(~says("unsupported") & says("supported"), F.lit(False))


def citations(answers: DataFrame, contexts: DataFrame, answer_id: str, answer: str, rank: str = "rank") -> DataFrame:
    """A row a citation: (answer_id, index, place, claim, resolved) and the columns of the context of that rank.

    ``contexts`` has the answer's identifier and the rank; a number without a context is not resolved.
    """
    cited = answers.select(answer_id, answer, F.posexplode(T.citation_indices(F.col(answer))).alias("place", "index"))
    found = contexts.withColumnRenamed(rank, "index").withColumn("_there", F.lit(True))
    joined = cited.withColumn("claim", claim_of(F.col(answer), F.col("index"))).join(found, [answer_id, "index"], "left")
    return joined.withColumn("resolved", F.coalesce("_there", F.lit(False))).drop("_there", answer)


def citation_coverage(verified: DataFrame, answer_id: str, supported: str = "supported") -> DataFrame:
    """(answer_id, n, unresolved, coverage): the share of judged citations that are supported; NULL without one."""
    judged = F.count(supported)
    return verified.groupBy(answer_id).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("unresolved"), F.try_divide(F.count_if(supported).cast("double"), judged).alias("coverage")
    )


def correct(category: Column, refused: Column, rating: Column) -> Column:
    """Correct end to end; NULL while an answer lacks its rating."""
    return F.when(category == "no_answer", refused).when(refused, False).otherwise(rating >= PASS_RATING)


def faithfulness(refused: Column, supported: Column) -> Column:
    """Share of supported claims; NULL for refusals, without claims and without a verdict."""
    claims = F.when(F.size(supported) > 0, F.size(F.filter(supported, lambda s: s)) / F.size(supported))
    return F.when(~refused & supported.isNotNull(), claims)


def with_verdicts(records: DataFrame) -> DataFrame:
    """Answer records with ``correct`` and ``faithfulness``."""
    return records.withColumns({
        "correct": correct(F.col("category"), F.col("refused"), F.col("rating")), "faithfulness": faithfulness(F.col("refused"), F.col("supported")),
    })


def answer_scores(records: DataFrame, by: list[str]) -> DataFrame:
    """Per group of answer records: correct rate with its interval, ratings, faithfulness, citations, cost, p50 and p95.

    Percentiles are nearest-rank over running totals, so a mode's latencies never meet in one task.
    """
    rows = with_verdicts(records)
    right, known = F.count_if("correct"), F.count("correct")
    low, high = E.wilson(right, known)
    fully, judged = F.count_if(F.col("faithfulness") == 1.0), F.count("faithfulness")
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), right.alias("k_correct"), known.alias("n_correct"), F.try_divide(right.cast("double"), known).alias("correct_rate"),
        low.alias("correct_low"), high.alias("correct_high"), F.avg(F.when(~F.col("refused"), F.col("rating"))).alias("mean_rating"),
        F.count(F.when(~F.col("refused"), F.col("rating"))).alias("rated"), F.avg("faithfulness").alias("faithfulness"),
        F.try_divide(fully.cast("double"), judged).alias("fully_supported"),
        F.try_divide(F.sum("citations_supported").cast("double"), F.sum("citations_verified")).alias("citation_accuracy"),
        F.avg("cost_usd").alias("cost_per_query"), F.sum("cost_usd").alias("cost_total"), F.sum("judge_cost_usd").alias("judge_cost"),
    )
    counted = rows.where("total_ms IS NOT NULL").groupBy(*by, F.col("total_ms").alias("_ms")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, by, ["_ms"], ["_n"])
    at = lambda p: F.max(F.when((F.col("_n_before") < F.ceil(F.col("_n_total") * p / 100)) & (F.ceil(F.col("_n_total") * p / 100) <= F.col("_n_before") + F.col("_n")), F.col("_ms")))
    return joined_on(totals, ranked.groupBy(*by).agg(at(50).alias("p50_ms"), at(95).alias("p95_ms")), by, "left")


def prf_with_intervals(rows: DataFrame, by: list[str], expected: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and f1 of each group, with Wilson intervals of precision and recall."""
    counted = rows.groupBy(*by).agg(*E.prf(expected, actual))
    p_low, p_high = E.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    r_low, r_high = E.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision_low": p_low, "precision_high": p_high, "recall_low": r_low, "recall_high": r_high})


def config_value(threshold: float, scores: DataFrame, score: str = "score") -> float:
    """The threshold cut to six decimals, or to nine or twelve where fewer would let a score cross it."""
    for digits in CONFIG_DIGITS:
        value = F.floor(F.lit(threshold) * 10**digits) / 10**digits
        crossed, cut = scores.agg(F.count_if((F.col(score) >= value) & (F.col(score) < threshold)), F.first(value)).first()
        if not crossed:
            return threshold if cut is None else cut
    return threshold


def refusal_scores(records: DataFrame, configured: float | None = None) -> tuple[float | None, DataFrame]:
    """The threshold that is best on the dev split, and (gate, split, tp..., f1) of it on both and of ``configured`` on test.

    Records have split, category and top_score. Without a dev question to refuse, no threshold is chosen.
    """
    should = F.col("category") == "no_answer"
    rows = records.select("split", F.col("top_score").alias("score"), should.alias("expected"))
    dev = rows.where("split = 'dev'")
    chosen = None
    if not dev.where("expected").isEmpty():
        chosen = E.choose_threshold(E.refusal_sweep(dev)).first()["threshold"]
    legs = [(chosen, "chosen", ("dev", "test")), (configured, "configured", ("test",))]
    out = rows.select(F.lit("").alias("gate"), "split", F.lit(False).alias("expected"), F.lit(False).alias("actual")).limit(0)
    for value, name, splits in legs:
        if value is not None:
            out = out.union(rows.where(F.col("split").isin(*splits)).select(F.lit(name), "split", "expected", F.col("score") < value))
    return chosen, prf_with_intervals(out, ["gate", "split"], F.col("expected"), F.col("actual"))


def refusals_by_kind(records: DataFrame, threshold: float) -> DataFrame:
    """(kind, split, n, refused, median): no_answer questions that a gate at ``threshold`` refuses; the median is the kind's."""
    rows = records.where("category = 'no_answer'")
    middle = medians(rows, ["no_answer_kind"], "top_score").select("no_answer_kind", "median")
    counts = rows.groupBy("no_answer_kind", "split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("top_score") < threshold).alias("refused"))
    return joined_on(counts, middle, ["no_answer_kind"], "left")


def agreement(records: DataFrame) -> DataFrame:
    """(n, raw, kappa) of answers that a person and the judge graded."""
    graded = with_verdicts(records).where("human_pass IS NOT NULL AND rating IS NOT NULL")
    return graded.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("correct") == F.col("human_pass")).cast("double")).alias("raw"), E.cohens_kappa(F.col("correct"), F.col("human_pass")).alias("kappa"))


def disagreements(records: DataFrame) -> DataFrame:
    graded = with_verdicts(records).where("human_pass IS NOT NULL AND rating IS NOT NULL AND correct <> human_pass")
    return graded.select("id", "mode", "category", "rating", F.col("correct").alias("judge_pass"), "human_pass").orderBy("mode", "id")


def false_refusals(records: DataFrame, strata: list[str]) -> DataFrame:
    """(mode, strata..., n, refused, by_gate, by_model) of answerable questions: in all and within each stratum.

    A record whose ``refused`` and ``refused_by`` disagree raises an error when the result is computed.
    """
    rows = records.where("category <> 'no_answer'")
    agrees = F.col("refused") == F.col("refused_by").isNotNull()
    checked = F.when(F.coalesce(agrees, F.lit(False)), F.col("refused")).otherwise(F.raise_error("refused and refused_by disagree").cast("boolean"))
    return rows.withColumn("refused", checked).groupingSets([["mode"], *[["mode", s] for s in strata]], "mode", *strata).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused"),
        F.count_if(F.col("refused_by") == "gate").alias("by_gate"), F.count_if(F.col("refused_by") == "model").alias("by_model"),
    )


def paired(records: DataFrame, a: str, b: str, value: str, keep: list[str]) -> DataFrame:
    """(id, keep..., in_a, in_b): the value of each question in both modes, for those that have it in both."""
    side = lambda mode, name: records.where(F.col("mode") == mode).where(F.col(value).isNotNull()).select("id", F.col(value).alias(name), *(keep if name == "in_a" else []))
    return side(a, "in_a").join(side(b, "in_b"), "id")


def mcnemar(records: DataFrame, a: str, b: str, strata: list[str]) -> DataFrame:
    """(strata..., n, only_a, only_b, p): exact test on end-to-end correctness, in all and within each stratum."""
    pairs = paired(with_verdicts(records), a, b, "correct", strata)
    counts = pairs.groupingSets([[], *[[s] for s in strata]], *strata).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a") & F.col("in_b")).alias("only_b")
    )
    return counts.withColumn("p", E.mcnemar_p(F.col("only_a"), F.col("only_b")))


def outcome(refused: Column, refused_by: Column, rating: Column) -> Column:
    """What became of a question, in words; NULL ``refused`` means that it wasn't asked."""
    return F.when(refused.isNull(), "not asked").when(refused, F.concat(F.lit("refused by "), F.coalesce(refused_by, F.lit("?")))).otherwise(
        F.coalesce(F.concat(F.lit("rated "), rating.cast("string")), F.lit("not judged"))
    )


def ambiguous_outcomes(retrieval: DataFrame, records: DataFrame, top: int = 5) -> DataFrame:
    """(id, mode, readings, found, outcome) of ambiguous questions; ``retrieval`` has (id, mode, category, n_items, rank, item)."""
    asked = retrieval.where("category = 'ambiguous'").groupBy("id", "mode").agg(
        F.first("n_items").alias("readings"), F.count_distinct(F.when(F.col("rank") <= top, F.col("item"))).alias("found")
    )
    told = records.select("id", "mode", "refused", "refused_by", "rating")
    return asked.join(told, ["id", "mode"], "left").select("id", "mode", "readings", "found", outcome(F.col("refused"), F.col("refused_by"), F.col("rating")).alias("outcome"))


def missing_verdicts(category: Column, refused: Column, rating: Column, supported: Column, n_contexts: Column) -> Column:
    """The verdicts that an answer still needs: none for a refusal, correctness if answerable, faithfulness if it had contexts."""
    wanted = F.array(
        F.when(~refused & (category != "no_answer") & rating.isNull(), "correctness"), F.when(~refused & (n_contexts > 0) & supported.isNull(), "faithfulness"),
    )
    return F.array_compact(wanted)


def resumable(asked: DataFrame, recorded: DataFrame, keys: list[str], order: str, error: str = "error") -> DataFrame:
    """The rows of ``asked`` whose latest record is missing or an error."""
    last = recorded.groupBy(*keys).agg(F.max_by(F.col(error).isNull(), order).alias("_done")).where("_done")
    return asked.join(last.select(*keys), keys, "left_anti")


def latency(records: DataFrame, by: list[str], timings: str = "timings_ms") -> DataFrame:
    """(by..., stage, n, p50, p95) of each stage in a map of stage to milliseconds."""
    stages = records.select(*by, F.explode(timings).alias("stage", "_took"))
    return nearest_ranks(stages, [*by, "stage"], "_took", (50, 95))


def config_mismatches(expected: DataFrame, served: Column) -> DataFrame:
    """(key, expected, served) of dotted keys whose value in the served JSON text is missing or another."""
    value = F.call_function("get_json_object", served, F.concat(F.lit("$."), F.col("key")))
    return expected.withColumn("served", value).where(~F.col("expected").eqNullSafe(F.col("served")))
