"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import ball_simhash, hyperdim_lang, lsm_dedup, slack_packing, storage, systematic_mix

#: Cosine below which a text is like no language learned, and how many n-grams (in effect) it takes to say so.
#: Runs of words of the test documents with 60 or more score 0.25 at least, random letters 0.16 at most; with
#: fewer the two overlap, so short texts are never rejected for their cosine.
LEAST_COSINE, LEAST_BREADTH = 0.15, 60


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no letters, or enough of them and resembles no language; the rest keeps its columns.

    NULL and empty texts have no letters. Repeated rows go or stay alike; an empty table stays empty.
    """
    name = "_language"
    while name in docs.columns:
        name += "_"
    profiles = hyperdim_lang.learn(hyperdim_lang.learning_rows(docs))
    told = hyperdim_lang.identify(docs, profiles, output=name)
    like = (F.col(f"{name}.score") >= LEAST_COSINE) | (F.col(f"{name}.breadth") < LEAST_BREADTH)
    return told.where((F.col(f"{name}.lang") != hyperdim_lang.UNDETERMINED) & like).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row of the largest doc_id, once; NULL counts as empty.

    Of a text that only rows without doc_id have, one stays. An empty table stays empty.
    """
    return lsm_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of two or fewer differing bits, that of the least doc_id.

    Rows of one doc_id with different texts are judged each by its own; rows without doc_id all stay; NULL
    texts are linked like empty ones. An empty table stays empty.
    """
    return ball_simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times: sources come near their target weights.

    NULL is a source of its own; NULL and repeated identifiers are taken like others. An empty table stays empty.
    """
    return systematic_mix.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op2's contract, of every row: a row that the mix repeats is packed each time."""
    return slack_packing.pack_documents(docs, slack_packing.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID learns vectors and packing runs a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again,
    and removed when the next stage's are written."""
    docs, before = storage.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, at = storage.written_at(stage(spark, docs, sf_dir), name)
        if before:
            storage.remove(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
