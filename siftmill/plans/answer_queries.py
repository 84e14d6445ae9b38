"""Answer records made from documents, twice (dense and hybrid), and what is scored on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import answers as A
from siftmill.operators import retrieval_metrics
from siftmill.sources.tables import read_table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a question in both modes; ratings, verdicts and times follow from its number and length."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    rows = docs.withColumn("mode", F.explode(F.array(F.lit("dense"), F.lit("hybrid"))))
    x = F.col("doc_id") * 7 + F.when(F.col("mode") == "dense", 0).otherwise(3) + F.col("n_chars") % 13
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    rows = rows.withColumn("x", x).withColumn("category", pick(4, "lookup", "multi_hop", "no_answer", "ambiguous")).withColumn("refused", x % 5 == 0)
    return rows.select(
        F.col("doc_id").alias("id"), "mode", "category", pick(3, "near-miss", "knows-elsewhere", "out-of-scope").alias("no_answer_kind"), F.col("lang").alias("origin"),
        F.when(F.col("doc_id") % 5 < 2, "dev").otherwise("test").alias("split"), "refused",
        F.when(F.col("refused"), F.when(x % 2 == 0, "gate").otherwise("model")).alias("refused_by"), F.when(x % 11 > 0, (x % 5 + 1).cast("int")).alias("rating"),
        F.when(x % 7 > 0, F.transform(F.sequence(F.lit(1), (x % 4 + 1).cast("int")), lambda i: (x + i) % 3 > 0)).alias("supported"),
        (x % 4).alias("citations_verified"), F.least(x % 4, x % 3).alias("citations_supported"), (x % 100 / 10000.0).alias("cost_usd"), F.lit(0.001).alias("judge_cost_usd"),
        (F.col("n_chars") % 997 + x % 50).cast("double").alias("total_ms"), F.when(x % 3 == 0, x % 2 == 0).alias("human_pass"), (x % 17 / 16.0).alias("top_score"),
    )


RECORDS = """d AS (SELECT doc_id, lang, coalesce(n_chars, 0) AS n, mode, doc_id * 7 + CASE mode WHEN 'dense' THEN 0 ELSE 3 END + coalesce(n_chars, 0) % 13 AS x
  FROM documents, (VALUES ('dense'), ('hybrid')) m(mode)),
r0 AS (SELECT doc_id AS id, mode, x, ['lookup', 'multi_hop', 'no_answer', 'ambiguous'][doc_id % 4 + 1] AS category, ['near-miss', 'knows-elsewhere', 'out-of-scope'][doc_id % 3 + 1] AS no_answer_kind, lang AS origin,
  CASE WHEN doc_id % 5 < 2 THEN 'dev' ELSE 'test' END AS split, x % 5 = 0 AS refused, CASE WHEN x % 11 > 0 THEN x % 5 + 1 END AS rating,
  CASE WHEN x % 7 > 0 THEN list_transform(range(1, x % 4 + 2), lambda i: (x + i) % 3 > 0) END AS supported,
  (n % 997 + x % 50)::DOUBLE AS total_ms, CASE WHEN x % 3 = 0 THEN x % 2 = 0 END AS human_pass, x % 17 / 16.0::DOUBLE AS top_score FROM d),
r AS (SELECT *, CASE WHEN refused THEN CASE WHEN x % 2 = 0 THEN 'gate' ELSE 'model' END END AS refused_by,
  CASE WHEN category = 'no_answer' THEN refused WHEN refused THEN false ELSE rating >= 4 END AS correct,
  CASE WHEN NOT refused AND supported IS NOT NULL THEN len(list_filter(supported, lambda s: s)) / len(supported) END AS faithfulness FROM r0)"""


def _wilson(k: str, n: str, low: str, high: str) -> str:
    centre, half, spread = f"({k} / {n} + 1.9208 / {n})", f"(1.96 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n})))", f"(1 + 3.8416 / {n})"
    bound = lambda sign, default: f"CASE WHEN {n} = 0 THEN {default} ELSE round(CAST(({centre} {sign} {half}) / {spread} AS DOUBLE), 9) END"
    return f"greatest(0, {bound('-', '0.0')})::DOUBLE AS {low}, least(1, {bound('+', '1.0')})::DOUBLE AS {high}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in names else c for c in df.columns])


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.answer_scores(_records(spark, sf_dir), ["mode", "category"])
    return _rounded(found, *(f.name for f in found.schema.fields if f.dataType.simpleString() == "double"))


ANSWER_SQL = f"""WITH {RECORDS}, p AS (SELECT mode, category, total_ms, row_number() OVER (PARTITION BY mode, category ORDER BY total_ms) AS rn, count(*) OVER (PARTITION BY mode, category) AS n FROM r),
q AS (SELECT mode, category, max(total_ms) FILTER (rn = (n * 50 + 99) // 100) AS p50_ms, max(total_ms) FILTER (rn = (n * 95 + 99) // 100) AS p95_ms FROM p GROUP BY ALL),
s AS (SELECT mode, category, count(*) AS n, count_if(correct)::BIGINT AS k_correct, count(correct) AS n_correct, avg(CASE WHEN NOT refused THEN rating END) AS mean_rating, count(CASE WHEN NOT refused THEN rating END) AS rated,
  avg(faithfulness) AS faithfulness, count_if(faithfulness = 1) / nullif(count(faithfulness), 0) AS fully_supported, sum(least(x % 4, x % 3)) / nullif(sum(x % 4), 0) AS citation_accuracy,
  avg(x % 100 / 10000.0::DOUBLE) AS cost_per_query, sum(x % 100 / 10000.0::DOUBLE) AS cost_total, count(*) * 0.001::DOUBLE AS judge_cost FROM r GROUP BY ALL)
SELECT mode, category, n, k_correct, n_correct, round(k_correct / nullif(n_correct, 0), 9) AS correct_rate, {_wilson('k_correct', 'n_correct', 'correct_low', 'correct_high')},
  round(mean_rating, 9) AS mean_rating, rated, round(faithfulness, 9) AS faithfulness, round(fully_supported, 9) AS fully_supported, round(citation_accuracy, 9) AS citation_accuracy,
  round(cost_per_query, 9) AS cost_per_query, round(cost_total, 9) AS cost_total, round(judge_cost, 9) AS judge_cost, round(p50_ms, 9) AS p50_ms, round(p95_ms, 9) AS p95_ms FROM s JOIN q USING (mode, category)"""


def refusal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the dense mode: the threshold chosen on dev, on both splits, and 0.5 as the configured one on test."""
    _, found = A.refusal_scores(_records(spark, sf_dir).where("mode = 'dense'"), 0.5)
    return _rounded(found, "precision", "recall", "f1", "precision_low", "precision_high", "recall_low", "recall_high")


REFUSAL_SQL = f"""WITH {RECORDS}, g AS (SELECT split, top_score AS s, category = 'no_answer' AS e FROM r WHERE mode = 'dense'), v AS (SELECT * FROM g WHERE split = 'dev'),
t AS (SELECT DISTINCT s AS t FROM v UNION ALL SELECT 'inf'::DOUBLE), c AS (SELECT t, 2.0::DOUBLE * count_if(e AND s < t) / nullif(2 * count_if(e AND s < t) + count_if(NOT e AND s < t) + count_if(e AND s >= t), 0) AS f1 FROM t, v GROUP BY t),
b AS (SELECT t FROM c ORDER BY f1 DESC NULLS LAST, t LIMIT 1),
k AS (SELECT 'chosen' AS gate, split, e, s < (SELECT t FROM b) AS a FROM g UNION ALL SELECT 'configured', split, e, s < 0.5 FROM g WHERE split = 'test'),
n AS (SELECT gate, split, count_if(e AND a)::BIGINT AS tp, count_if(NOT e AND a)::BIGINT AS fp, count_if(e AND NOT a)::BIGINT AS fn, count_if(NOT e AND NOT a)::BIGINT AS tn FROM k GROUP BY ALL)
SELECT gate, split, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1,
  {_wilson('tp', '(tp + fp)', 'precision_low', 'precision_high')}, {_wilson('tp', '(tp + fn)', 'recall_low', 'recall_high')} FROM n"""


def refusals_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.refusals_by_kind(_records(spark, sf_dir).where("mode = 'hybrid'"), 0.5), "median")


KIND_SQL = f"""WITH {RECORDS}, k AS (SELECT * FROM r WHERE mode = 'hybrid' AND category = 'no_answer'), m AS (SELECT no_answer_kind, median(top_score) AS median FROM k GROUP BY 1)
SELECT no_answer_kind, split, count(*) AS n, count_if(top_score < 0.5)::BIGINT AS refused, round(any_value(median), 9) AS median FROM k JOIN m USING (no_answer_kind) GROUP BY no_answer_kind, split"""


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.agreement(_records(spark, sf_dir)), "raw", "kappa")


AGREEMENT_SQL = f"""WITH {RECORDS}, g AS (SELECT * FROM r WHERE human_pass IS NOT NULL AND rating IS NOT NULL), c AS (SELECT count(*) AS n, avg((correct = human_pass)::INT) AS raw, avg(correct::INT) AS a, avg(human_pass::INT) AS b FROM g)
SELECT n, round(raw, 9) AS raw, round((raw - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 9) AS kappa FROM c"""


def judge_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.disagreements(_records(spark, sf_dir))


DISAGREE_SQL = f"""WITH {RECORDS} SELECT id, mode, category, CAST(rating AS INT) AS rating, correct AS judge_pass, human_pass FROM r WHERE human_pass IS NOT NULL AND rating IS NOT NULL AND correct <> human_pass"""


def false_refusal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.false_refusals(_records(spark, sf_dir), ["category", "split", "origin"])


FALSE_REFUSAL_SQL = f"""WITH {RECORDS} SELECT mode, category, split, origin, count(*) AS n, count(*) FILTER (refused) AS refused, count(*) FILTER (refused_by = 'gate') AS by_gate, count(*) FILTER (refused_by = 'model') AS by_model
FROM r WHERE category <> 'no_answer' GROUP BY GROUPING SETS ((mode), (mode, category), (mode, split), (mode, origin))"""


def mcnemar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.mcnemar(_records(spark, sf_dir), "dense", "hybrid", ["category", "split", "origin"]), "p")


MCNEMAR_SQL = f"""WITH RECURSIVE {RECORDS}, p AS (SELECT a.category, a.split, a.origin, a.correct AS a, b.correct AS b FROM r a JOIN r b ON a.id = b.id AND a.mode = 'dense' AND b.mode = 'hybrid' WHERE a.correct IS NOT NULL AND b.correct IS NOT NULL),
c AS (SELECT category, split, origin, count(*) AS n, count_if(a AND NOT b)::BIGINT AS only_a, count_if(NOT a AND b)::BIGINT AS only_b FROM p GROUP BY GROUPING SETS ((), (category), (split), (origin))),
t AS (SELECT *, exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)) AS term FROM (SELECT *, unnest(range(least(only_a, only_b) + 1)) AS i FROM c))
SELECT category, split, origin, n, only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * sum(term)) END, 9) AS p FROM t GROUP BY category, split, origin, n, only_a, only_b"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three found items for a question, of four: their ranks follow from its number."""
    rows = _records(spark, sf_dir).select("id", "mode", "category", F.lit(4).alias("n_items"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("item"))
    return rows.withColumn("rank", ((F.col("id") * F.col("item") + F.length("mode")) % 9 + 1).cast("int"))


RANKED = "k AS (SELECT id, mode, category, 4 AS n_items, item, (id * item + length(mode)) % 9 + 1 AS rank FROM r, UNNEST([1, 2, 3]) AS g(item))"


def ambiguous_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ambiguous_outcomes(_ranked(spark, sf_dir), _records(spark, sf_dir))


AMBIGUOUS_SQL = f"""WITH {RECORDS}, {RANKED}, f AS (SELECT id, mode, count(DISTINCT item) FILTER (rank <= 5) AS found FROM k WHERE category = 'ambiguous' GROUP BY ALL)
SELECT id, mode, 4 AS readings, found, CASE WHEN refused THEN 'refused by ' || refused_by WHEN rating IS NULL THEN 'not judged' ELSE 'rated ' || rating END AS outcome FROM f JOIN r USING (id, mode)"""


def retrieval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall at 5, MRR and nDCG at 10 by mode, in all and by category."""
    ranked = _ranked(spark, sf_dir).where("category <> 'no_answer'").withColumn("question", F.struct("id", "mode", "category"))
    wanted = ranked.groupBy("question").agg(F.first("n_items").alias("n_items"))
    scores = retrieval_metrics.scores(wanted, ranked.select("question", "rank", "item"), (1, 5), 10).select("question.*", "recall_at_1", "recall_at_5", "mrr_at_10", "ndcg_at_10")
    found = scores.groupingSets([["mode"], ["mode", "category"]], "mode", "category").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in scores.columns[3:]])
    return _rounded(found, *scores.columns[3:])


MEANS_SQL = f"""WITH {RECORDS}, {RANKED}, f AS (SELECT id, mode, category, item, rank, row_number() OVER (PARTITION BY id, mode ORDER BY rank, item) AS j FROM k WHERE category <> 'no_answer'),
s AS (SELECT mode, category, count_if(rank <= 1) / 4.0::DOUBLE AS r1, count_if(rank <= 5) / 4.0::DOUBLE AS r5, 1.0::DOUBLE / min(rank) AS mrr, sum(1 / log2(greatest(rank, j) + 1)) / list_sum([1 / log2(i + 1) FOR i IN range(1, 5)]) AS ndcg FROM f GROUP BY id, mode, category)
SELECT mode, category, count(*) AS n, round(avg(r1), 9) AS recall_at_1, round(avg(r5), 9) AS recall_at_5, round(avg(mrr), 9) AS mrr_at_10, round(avg(ndcg), 9) AS ndcg_at_10 FROM s GROUP BY GROUPING SETS ((mode), (mode, category))"""


def missing_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = A.missing_verdicts(F.col("category"), F.col("refused"), F.col("rating"), F.col("supported"), F.col("citations_verified"))
    return _records(spark, sf_dir).select("id", "mode", F.array_join(needs, ",").alias("needs")).where("needs <> ''")


MISSING_SQL = f"""WITH {RECORDS}, m AS (SELECT id, mode, array_to_string(list_filter([CASE WHEN category <> 'no_answer' AND rating IS NULL THEN 'correctness' END, CASE WHEN x % 4 > 0 AND supported IS NULL THEN 'faithfulness' END], lambda v: v IS NOT NULL), ',') AS needs FROM r WHERE NOT refused)
SELECT * FROM m WHERE needs <> ''"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers of two sentences: the first cites by the id, the second context 2."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\].!?\s]+", " "), "^ +| +$", "")
    answer = F.concat(F.lit("On this "), body, F.lit(" ["), (F.col("doc_id") % 6).cast("string"), F.lit(", 2]. Then "), F.coalesce("lang", F.lit("?")), F.lit(" [2]! End."))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), answer.alias("answer"))


ANSWERS = r"""a AS (SELECT doc_id AS answer_id, doc_id % 6 AS c, 'On this ' || trim(regexp_replace(coalesce(text, ''), '[\[\].!?\s]+', ' ', 'g'), ' ') || ' [' || doc_id % 6 || ', 2].' AS one, 'Then ' || coalesce(lang, '?') || ' [2]!' AS two FROM documents)"""


def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each citation of each answer with its claim and the source of its context; contexts are four sources."""
    contexts = _answers(spark, sf_dir).select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("rank"))
    contexts = contexts.withColumn("source", F.concat(F.lit("s"), ((F.col("answer_id") + F.col("rank")) % 9).cast("string")))
    return A.citations(_answers(spark, sf_dir), contexts, "answer_id", "answer").select("answer_id", "index", "place", "claim", "source", "resolved")


CITED_SQL = f"""WITH {ANSWERS}, i AS (SELECT *, UNNEST(CASE WHEN c = 2 THEN [2] ELSE [c, 2] END) AS index FROM a)
SELECT answer_id, CAST(index AS INT) AS index, CASE WHEN index = c THEN 0 ELSE 1 END AS place, CASE WHEN index = 2 THEN one || ' ' || two ELSE one END AS claim,
  CASE WHEN index BETWEEN 1 AND 4 THEN 's' || (answer_id + index) % 9 END AS source, index BETWEEN 1 AND 4 AS resolved FROM i"""


def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a judge to the resolved citations, read and summed up by answer."""
    x = F.col("answer_id") + F.col("index")
    reply = F.when(x % 3 == 0, "Supported. Reason: it says so").when(x % 3 == 1, "UNSUPPORTED, not supported").otherwise("cannot tell")
    cited = resolved_citations(spark, sf_dir).withColumn("supported", F.when(F.col("resolved"), A.verdict(reply)))
    return _rounded(A.citation_coverage(cited, "answer_id"), "coverage")


COVERAGE_SQL = f"""WITH {ANSWERS}, i AS (SELECT answer_id, UNNEST(CASE WHEN c = 2 THEN [2] ELSE [c, 2] END) AS index FROM a)
SELECT answer_id, count(*) AS n, count_if(index NOT BETWEEN 1 AND 4)::BIGINT AS unresolved, round(count_if(index BETWEEN 1 AND 4 AND (answer_id + index) % 3 = 0) / nullif(count_if(index BETWEEN 1 AND 4), 0), 9) AS coverage FROM i GROUP BY answer_id"""


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as numbered passages, and the prompt about them."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lit(None).cast("string").alias("heading"), (F.col("turn") - 1).alias("page"), "text")
    blocks = A.context_blocks(turns, ["conv_id"], "turn", "role", "heading", "page", "text")
    return blocks.select("conv_id", A.grounded_prompt(F.col("contexts"), F.lit("What?")).alias("prompt"))


BLOCKS_SQL = """WITH t AS (SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] (' || role || CASE WHEN turn - 1 > 0 THEN ' (p.' || turn - 1 || ')' ELSE '' END || ')' || chr(10) || coalesce(text, '') AS b FROM conversations)
SELECT conv_id, 'Context passages:' || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: What?' || chr(10) || chr(10) || 'Answer using only the context above, with [n] citations.' AS prompt FROM t GROUP BY conv_id"""


def model_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that start as a refusal does, in odd quotes and spaces, every seventh made one."""
    said = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  “*I  don’t know based\non the provided documentation. "), F.coalesce("text", F.lit("")), F.lit("*”"))).otherwise(F.col("text"))
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", A.is_refusal(said).alias("refusal"))


MODEL_SQL = "SELECT doc_id, doc_id % 7 = 0 AS refusal FROM documents WHERE text IS NOT NULL"

QUERIES = {
    f.__name__: f for f in (
        answer_scores, refusal_scores, refusals_by_kind, judge_agreement, judge_disagreements, false_refusal_stats, mcnemar_stats, ambiguous_outcomes, retrieval_means,
        missing_verdicts, resolved_citations, citation_coverage, context_blocks, model_refusals,
    )
}
ORACLES = {
    "answer_scores": ANSWER_SQL, "refusal_scores": REFUSAL_SQL, "refusals_by_kind": KIND_SQL, "judge_agreement": AGREEMENT_SQL, "judge_disagreements": DISAGREE_SQL,
    "false_refusal_stats": FALSE_REFUSAL_SQL, "mcnemar_stats": MCNEMAR_SQL, "ambiguous_outcomes": AMBIGUOUS_SQL, "retrieval_means": MEANS_SQL, "missing_verdicts": MISSING_SQL,
    "resolved_citations": CITED_SQL, "citation_coverage": COVERAGE_SQL, "context_blocks": BLOCKS_SQL, "model_refusals": MODEL_SQL,
}
