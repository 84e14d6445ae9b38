"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1. A letter's place in an n-gram permutes (rotates) its vector, the
rotated vectors bind by multiplication into the n-gram's vector, and the n-grams of a text bundle by
addition. A language's prototype bundles the unit vectors of its learning texts; a text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmill.llm.storage import documents

DIM = 1024
NGRAM = 3
#: About this many learning texts of each language are bundled; they are picked by a hash of doc_id.
PER_LANGUAGE = 3000
#: n-gram vectors that a worker keeps; 4 x DIM bytes each.
KEPT_VECTORS = 16384
UNDETERMINED = "und"
_SPACE = 32
_WIDTH = 21  # bits of a code point
_SCALE = 1_000_000


@dataclass
class Encoder:
    """Texts to bundled vectors; the same on every machine, as letter vectors follow from code points."""

    dim: int = DIM
    ngram: int = NGRAM
    seed: int = 7
    rows: dict[int, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    letters: np.ndarray | None = None

    def letter(self, code: int) -> np.ndarray:
        return np.random.default_rng((self.seed, code)).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(self.ngram):
            out *= np.roll(self.letter((gram >> (_WIDTH * place)) & ((1 << _WIDTH) - 1)), place)
        return out

    def index(self, grams: list[int]) -> np.ndarray:
        if self.table is None:
            self.table = np.empty((KEPT_VECTORS, self.dim), np.float32)
        known = self.rows
        missing = [g for g in grams if g not in known]
        if len(known) + len(missing) > KEPT_VECTORS:
            known.clear()
            missing = grams
        for g in missing:
            self.table[len(known)] = self.bound(g)
            known[g] = len(known)
        return np.fromiter(map(known.__getitem__, grams), np.int64, len(grams))

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The different n-grams of a text and their counts; None without a letter."""
        if not text:
            return None
        if self.letters is None:
            self.letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letters[codes]
        if not is_letter.any():
            return None
        codes = np.where(is_letter, codes, _SPACE).astype(np.int64)
        codes = np.concatenate(([_SPACE], codes, [_SPACE]))
        codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
        n = len(codes) - self.ngram + 1
        grams = np.zeros(max(n, 1), np.int64)
        for place in range(self.ngram):
            part = codes[place : place + len(grams)]
            grams[: len(part)] |= part << (_WIDTH * place)
        grams, counts = np.unique(grams, return_counts=True)
        return grams, counts.astype(np.float32)

    def encode(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None without a letter."""
        return self.bundled(self.counted(text))

    def bundled(self, counted: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray | None:
        """The unit vector of counted n-grams."""
        if counted is None:
            return None
        grams, counts = counted
        total = np.zeros(self.dim, np.float32)
        step = KEPT_VECTORS // 2
        for i in range(0, len(grams), step):
            at = self.index(grams[i : i + step].tolist())
            total += counts[i : i + step] @ self.table[at]
        length = float(np.linalg.norm(total))
        return total / length if length else None


def breadth(counts: np.ndarray) -> float:
    """How many equally frequent n-grams tell as much as these: all of them if none repeats, few if one rules."""
    counts = counts.astype(np.float64)
    return float(counts.sum() ** 2 / (counts**2).sum())


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, ngram: int) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    return _encoders.setdefault((dim, ngram), Encoder(dim, ngram))


@dataclass(frozen=True)
class Profiles:
    """Languages in order and their prototypes as unit rows."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    ngram: int = NGRAM

    def column(self):
        """A column function: text to struct(lang, score, breadth)."""
        languages, prototypes, ngram = self.languages, self.prototypes, self.ngram

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = encoder(prototypes.shape[1], ngram)
            for texts in batches:
                found = []
                for text in texts:
                    counted = own.counted(text) if languages else None
                    vector = own.bundled(counted)
                    if vector is None:
                        found.append((UNDETERMINED, 0.0, 0.0))
                    else:
                        cosines = prototypes @ vector
                        best = int(np.argmax(cosines))
                        found.append((languages[best], min(1.0, max(0.0, float(cosines[best]))), breadth(counted[1])))
                yield pd.DataFrame(found, columns=["lang", "score", "breadth"])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("breadth", T.DoubleType())]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, dim: int = DIM, ngram: int = NGRAM) -> Profiles:
    """Prototypes from the rows of ``docs`` with a language and a text.

    Of each language about ``per_language`` rows are bundled, picked by a hash of the identifier. The tasks
    send sums, not texts, and the driver receives one vector a language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    shares = known.groupBy("lang").agg((F.lit(float(per_language * _SCALE)) / F.count(F.lit(1))).alias("below"))
    picked = known.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(_SCALE)) < F.col("below")).select("lang", "text")

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, sums = encoder(dim, ngram), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                vector = own.encode(text)
                if vector is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(vector * _SCALE).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "total": [v.tolist() for v in sums.values()]})

    parts = picked.mapInPandas(bundle, "lang string, total array<bigint>").select("lang", F.posexplode("total").alias("pos", "value"))
    rows = parts.groupBy("lang", "pos").agg(F.sum("value").alias("value")).collect()  # languages x DIM numbers
    languages = tuple(sorted({r["lang"] for r in rows}))
    prototypes = np.zeros((len(languages), dim), np.float32)
    for r in rows:
        prototypes[languages.index(r["lang"]), r["pos"]] = r["value"]
    lengths = np.linalg.norm(prototypes, axis=1, keepdims=True) if languages else 1
    return Profiles(languages, prototypes / np.maximum(lengths, 1e-9), ngram)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", output: str = "language") -> DataFrame:
    """``docs`` with a column struct(lang, score, breadth): no join, no shuffle.

    NULL, empty and letterless texts are ``und`` with score 0, as is everything if nothing was learned.
    Texts are encoded whole; on a tie the language that sorts first wins. A column of the name ``output`` is replaced,
    so give a name that ``docs`` doesn't have to keep it.
    """
    return docs.withColumn(output, profiles.column()(F.col(text_col)))


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.crc32(F.col(id_col).cast("string")) % 4 != 2)


def op9_hyperdim_lang(spark, sf_dir: str) -> DataFrame:
    """The language of each document; held_out is NULL where doc_id is, and such rows teach nothing."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    profiles = learn(learning_rows(docs))
    told = identify(docs.select("doc_id", "text"), profiles)
    return told.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
