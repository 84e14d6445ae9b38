"""Packing token sequences by minimum bin slack.

A document is its token ids and an end id. Whole windows are cut off a long document; the rests are dealt
by hash into groups of bounded size, and each group fills its windows one after another: the longest rest
left opens a window, a bitset subset-sum over the lengths left finds the fill closest to the capacity, the
counts are backtracked, and the same fill is repeated as often as the lengths left allow. A group leaves
at most about one window with padding, so padding falls with the size of a group, not of the input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import documents, written

CAPACITY = 4096
END_ID = 2
#: A group holds about this many tokens and pieces: what one task packs at a time.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 17
#: Words whose ids a worker keeps (about 250 bytes each).
KEPT_WORDS = 500_000

_PLAIN = re.compile(r"[!-~¡¿«»à-öø-ÿß]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
_OTHER = re.compile(r"[^\t-\r -~¡¿«»À-ÖØ-öø-ÿß]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it is printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts through the tokenizer file, word by word.

    The tokenizer never joins what white space parts, so a text's ids are its words' ids in order. Ids of
    plain Latin words come from the file's BPE model directly; all other words, and texts that may hold a
    special token, go through the tokenizer itself. Both give what ``encode`` gives for the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.kept: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if _PLAIN.fullmatch(low):
            ids = [
                t.id for piece in _PIECES.findall(low)
                for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))
            ]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        found = self.kept[word] = np.array(ids, "<u4").tobytes()
        return found

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not _OTHER.search(text):
            text = text.lower()
        get = self.kept.get
        return b"".join([get(w) or self._word(w) for w in re.split("[\t-\r ]+", text) if w])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own tokenizer, kept from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document cut at multiples of the capacity."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                ids = own.ids(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    stop = min(n, start + capacity)
                    rows.append((key, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), n))
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"id": batch["id"].dtype})

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and their counts, out of ``counts``, whose sum comes closest to ``room`` from below.

    Bit s of a bitset says that the lengths so far can add up to s. A length with count n is added in
    doubling steps; the bitset before each length is kept to backtrack how often it was used.
    """
    mask, reach, before = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        if reach >> room & 1:
            break
        before.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
    total, used = reach.bit_length() - 1, {}
    for length, earlier in reversed(before):
        n = 0
        while not earlier >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece of one group; windows are numbered from 0."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    values, starts, sizes = np.unique(lengths[order], return_index=True, return_counts=True)
    place = {int(v): [int(s), int(s + n)] for v, s, n in zip(values, starts, sizes)}
    left = {int(v): int(n) for v, n in zip(values, sizes)}
    number = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        if not left[longest]:
            del left[longest]
        fill = Counter(best_fill(left, capacity - longest))
        fill[longest] += 1
        left[longest] = left.get(longest, 0) + 1
        repeats = min(left[x] // n for x, n in fill.items())
        for _ in range(repeats):
            at = 0
            for x in sorted(fill, reverse=True):
                for _ in range(fill[x]):
                    i = order[place[x][0]]
                    place[x][0] += 1
                    window[i], offset[i] = number, at
                    at += x
            number += 1
        for x, n in fill.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
    return window, offset


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. Sequence numbers are unique, not dense.

    Pieces are dealt into groups by what they hold and, where there is one, by their number in the written
    table (``_salt``), so rows without an identifier, or all alike, are not one group.
    """
    spark = pieces.sparkSession
    tokens, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, round(tokens / group_tokens), round(rows / group_pieces))
    fields = pieces.drop("_salt").schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        window, offset = pack_lengths(group["length"].to_numpy(), capacity)
        number = int(group["_group"].iloc[0]) << 32
        return group.drop(columns="_group").assign(sequence_id=window + number, offset=offset)

    keys = ["id", "start", "length", "ids_crc32", *(c for c in pieces.columns if c == "_salt")]
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))).drop("_salt")
    packed = dealt.groupBy("_group").applyInPandas(fill, f"{fields}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece.

    NULL and empty texts are the end id alone; long texts are tokenized whole and cut. Repeated rows, ties
    and NULL identifiers are packed like any rows; an empty table gives an empty result; other columns are
    not read. The pieces are written to the shared folder first, so nothing is tokenized twice.
    """
    return pack(written(token_pieces(docs, path, id_col, text_col, capacity).withColumn("_salt", F.monotonically_increasing_id()), "pieces"), id_col, capacity)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_slack_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
