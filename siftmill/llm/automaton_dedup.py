"""Removal of repeated passages with suffix automata of reference shards.

A window is ``width`` consecutive words. Streaming every document against the automaton of every shard
would read the corpus once a shard, so a window is routed by its content: its route is the least hash of
the word k-grams in it, which equal windows share and most neighbours too. Routes met in one document only
cannot hold a repetition and go no further: a bit filter of bounded size tells them apart, or a join where
there are too many for it. A maximal run of windows with one route, cut at PIECE windows, is a piece; the
different pieces of a route, with the least document of each, are the reference of its shard. The shard's
task builds their generalized suffix automaton and streams the pieces through it: where the match is at
least a window long, the state gives the first document that has the window.

What doesn't come out of an automaton: a route that has one different piece (copies of a passage with the
same surroundings) is answered by the least document of the piece, and a busy route, of very many documents
or windows, is routed window by window instead, so that no automaton holds more than a bounded number of
words; a window that is all its route has is answered by its least document too. Automata are not
broadcast: each goes to the task of its own route's pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import documents, remove, written, written_at

WIDTH, GRAM = 13, 5
#: Routes of more documents, or of more windows in all, are cut up: a window of theirs is its own piece.
BUSY, BUSY_WINDOWS = 1000, 100_000
#: Windows of a piece at most; pieces of one run overlap by a window's words less one.
PIECE = 512
#: Repeated routes up to this many go to the tasks as a bit filter of at most 32 MB; more are joined.
FILTER_ROUTES = 1 << 25
#: Words in one automaton at most, but for a single route.
SHARD_WORDS = 50_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3
_CHUNK = 4096  # bytes of one bitmap


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # for bytes: exactly the six ASCII white-space characters


def _rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each n consecutive words."""
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i : i + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MULTIPLIER)
    return out ^ (out >> np.uint64(29))


def _routes(words: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The route of each window, and the hashes of the words."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = _rolled(hashes, gram)
    n = len(words) - width + 1
    routes = grams[:n].copy()
    for i in range(1, width - gram + 1):
        np.minimum(routes, grams[i : i + n], out=routes)
    return routes.view(np.int64), hashes


def _runs(routes: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal routes, and the end."""
    return np.concatenate(([0], np.flatnonzero(np.diff(routes)) + 1, [len(routes)]))


def _bits(entries: int) -> int:
    """Eight to sixteen bits an entry, one bitmap at least."""
    return max(8 * _CHUNK, 1 << (8 * entries).bit_length())


def _filter(routes: DataFrame, bits: int) -> np.ndarray:
    """A bit a route, by its low bits: ``bits`` / 8 bytes whatever the number of rows."""
    at = F.pmod("route", F.lit(bits))
    rows = (
        routes.groupBy(F.floor(at / (8 * _CHUNK)).alias("chunk"))
        .agg(F.bitmap_construct_agg((at % (8 * _CHUNK)).cast("long")).alias("bitmap")).collect()  # at most bits / 8 bytes
    )
    out = np.zeros(max(bits // 8, _CHUNK), np.uint8)
    for r in rows:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out


def _set(routes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bit of each route is set."""
    at = routes & np.int64(len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class SuffixAutomaton:
    """Generalized suffix automaton over words; a state keeps the least document of its strings."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.first.append(None)
        return len(self.length) - 1

    def _branch(self, state: int, word: bytes) -> int:
        """The state for the strings of ``state`` and ``word``, cut off a longer one where it must be."""
        target, size = self.next[state][word], self.length[state] + 1
        if self.length[target] == size:
            return target
        clone = self._state(size, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def add(self, words: list[bytes], document) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._branch(last, word)
            else:
                new, state = self._state(self.length[last] + 1, {}, 0), last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = new
                    state = self.link[state]
                self.link[new] = 0 if state < 0 else self._branch(state, word)
                last = new
            if self.first[last] is None or document < self.first[last]:
                self.first[last] = document

    def settle(self) -> None:
        """Hands the least documents down from longer strings to their suffixes; call it after the last add."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[state], self.first[state]
            if up > 0 and own is not None and (self.first[up] is None or own < self.first[up]):
                self.first[up] = own

    def matches(self, words: list[bytes], width: int) -> Iterator[tuple[int, object]]:
        """(length, first document) at each word: the longest match that ends there, up to ``width`` words."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], min(size + 1, width)
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
            yield size, self.first[state] if size else None


def _first_documents(batches: Iterator[pd.DataFrame], width: int, shard_words: int) -> Iterator[pd.DataFrame]:
    """For each piece, sorted by route, the first document of each of its windows."""

    def resolve(shard: list[tuple[int, int, list[bytes], object]]) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for _, _, words, document in shard:
            automaton.add(words, document)
        automaton.settle()
        firsts = [[first for size, first in automaton.matches(words, width) if size == width] for _, _, words, _ in shard]
        return told(shard, firsts)

    def told(pieces: list, firsts: list) -> pd.DataFrame:
        return pd.DataFrame({"route": [s[0] for s in pieces], "piece_id": [s[1] for s in pieces], "firsts": firsts})

    def routes() -> Iterator[list[tuple[int, int, list[bytes], object]]]:
        own: list = []
        for batch in batches:
            for now, piece_id, piece, document in zip(batch["route"], batch["piece_id"], batch["piece"], batch["document"]):
                if own and now != own[0][0]:
                    yield own
                    own = []
                own.append((now, piece_id, piece.encode().split(b" "), document))
        if own:
            yield own

    shard, size, alone = [], 0, []
    for pieces in routes():
        if len(pieces) == 1:  # the piece is all its route has: each of its windows first starts where it does
            alone += pieces
        else:
            shard += pieces
            size += sum(len(p[2]) for p in pieces)
        if size >= shard_words:
            yield resolve(shard)
            shard, size = [], 0
        if len(alone) >= 10_000:
            yield told(alone, [[p[3]] * (len(p[2]) - width + 1) for p in alone])
            alone = []
    if shard:
        yield resolve(shard)
    if alone:
        yield told(alone, [[p[3]] * (len(p[2]) - width + 1) for p in alone])


def repeated_words_removed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, busy: int = BUSY, shard_words: int = SHARD_WORDS,
    with_text: bool = True, filter_routes: int = FILTER_ROUTES, busy_windows: int = BUSY_WINDOWS,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, ``with_text``, kept_text) of every row.

    A word goes if a window over it also starts in a document with a smaller identifier. NULL and empty
    texts have no words (kept_text is empty, its digest that of the empty string); texts shorter than a
    window lose nothing; long texts are read whole. A NULL identifier is not smaller or larger than any:
    its row loses nothing and takes nothing. Repeated rows are equal documents and don't count against each
    other; rows of one identifier with different texts are judged each by its own text. An empty table
    gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    known = own.where("id IS NOT NULL")

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found = [], []
            for key, text in zip(batch["id"], batch["text"]):
                words = words_of(text)
                if len(words) >= width:
                    found.append(np.unique(_routes(words, width, gram)[0], return_counts=True))
                    ids.append(key)
            if ids:
                own = np.repeat(np.array(ids), [len(f) for f, _ in found])
                yield pd.DataFrame({"route": np.concatenate([f for f, _ in found]), "windows": np.concatenate([n for _, n in found]).astype(np.int32), "id": own})

    routed = known.mapInPandas(routes, f"route long, windows int, id {kind}")
    counted = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("windows").alias("windows")).where("n > 1")
    again = written(counted.select("route", ((F.col("n") > busy) | (F.col("windows") > busy_windows)).alias("busy")), "routes")
    repeated = again.count()
    if repeated <= filter_routes:
        # a bit may stand for several routes: a piece too many is its route's only one and harmless
        hot = again.where("busy")
        held = docs.sparkSession.sparkContext.broadcast((_filter(again, _bits(repeated)), _filter(hot, _bits(hot.count()))))
        with_routes = known.withColumns({"quiet": F.lit(None).cast("array<bigint>"), "busy": F.lit(None).cast("array<bigint>")})
    else:
        held = None
        candidates = routed.join(again, "route").groupBy("id").agg(
            F.collect_list(F.when(~F.col("busy"), F.col("route"))).alias("quiet"), F.collect_list(F.when(F.col("busy"), F.col("route"))).alias("busy")
        )
        with_routes = known.join(candidates.select(F.col("id").alias("_id"), "quiet", "busy"), F.col("id") == F.col("_id")).select("id", "text", "quiet", "busy")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"route": [], "piece": [], "id": [], "text_key": [], "start": []}
            for key, text, quiet, hot in zip(batch["id"], batch["text"], batch["quiet"], batch["busy"]):
                words = words_of(text)
                if len(words) < width:
                    continue
                own_routes, hashes = _routes(words, width, gram)
                bounds = _runs(own_routes)
                starts, stops = bounds[:-1], bounds[1:]
                if held is not None:
                    is_busy = _set(own_routes, held.value[1])
                    is_quiet = (_set(own_routes, held.value[0]) & ~is_busy)[starts]
                else:
                    is_busy, is_quiet = np.isin(own_routes, hot), np.isin(own_routes[starts], quiet)
                singles = np.flatnonzero(is_busy)
                spans = [
                    (int(own_routes[a]), int(at), int(min(at + PIECE, b))) for a, b in zip(starts[is_quiet], stops[is_quiet]) for at in range(a, b, PIECE)
                ]
                if len(singles):
                    by_window = _rolled(hashes, width).view(np.int64)
                    spans += [(int(by_window[a]), int(a), int(a) + 1) for a in singles]
                text_key = np.uint64(xxhash.xxh64_intdigest(text.encode())).view(np.int64)
                out["route"] += [s[0] for s in spans]
                out["piece"] += [b" ".join(words[a : b + width - 1]).decode() for _, a, b in spans]
                out["start"] += [s[1] for s in spans]
                out["id"] += [key] * len(spans)
                out["text_key"] += [text_key] * len(spans)
            yield pd.DataFrame(out)

    found = with_routes.mapInPandas(pieces, f"route long, piece string, id {kind}, text_key long, start int").withColumn("piece_id", F.xxhash64("piece"))
    found, found_at = written_at(found, "pieces", compression="zstd")
    references = found.groupBy("route", "piece_id", "piece").agg(F.min("id").alias("document"))
    shards = references.repartition("route").sortWithinPartitions("route", "piece_id")
    firsts, firsts_at = written_at(
        shards.mapInPandas(lambda batches: _first_documents(batches, width, shard_words), f"route long, piece_id long, firsts array<{kind}>"), "firsts"
    )
    later = F.filter(F.transform("firsts", lambda first, i: F.when(first < F.col("id"), F.col("start") + i)), lambda x: x.isNotNull())
    hits = found.select("route", "piece_id", "id", "text_key", "start").join(firsts, ["route", "piece_id"]).select("id", "text_key", later.alias("starts")).where(F.size("starts") > 0)
    hits = written(hits, "hits")
    remove(docs.sparkSession, found_at)  # before the texts are shuffled
    remove(docs.sparkSession, firsts_at)
    removed = hits.groupBy("id").agg(F.collect_list(F.struct("text_key", "starts")).alias("removed"))
    judged = known.join(removed.select(F.col("id").alias("_id"), "removed"), F.col("id") == F.col("_id"), "left").select("id", "text", "removed")
    judged = judged.unionByName(own.where("id IS NULL").select("id", "text", F.lit(None).cast(judged.schema["removed"].dataType).alias("removed")))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, removed in zip(batch["text"], batch["removed"]):
                words = words_of(text)
                n = len(words)
                if removed is not None and len(removed):
                    text_key = np.uint64(xxhash.xxh64_intdigest(text.encode())).view(np.int64)
                    edge = np.zeros(n + width + 1, np.int32)
                    for entry in removed:
                        if entry["text_key"] == text_key:
                            starts = np.unique(entry["starts"])
                            edge[starts] += 1
                            edge[starts + width] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    words = [w for w, g in zip(words, gone) if not g]
                kept = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            yield pd.DataFrame(rows, columns=names).assign(id=batch["id"])

    names = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return judged.mapInPandas(clean, schema).withColumnRenamed("id", id_col)


ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT doc_id, i, w[i:i+12] AS win FROM d, UNNEST(range(1, len(w) - 11)) AS g(i)),
f AS (SELECT win, min(doc_id) AS first FROM n GROUP BY win),
h AS (SELECT DISTINCT n.doc_id, n.i + k AS i FROM n JOIN f USING (win), UNNEST(range(0, 13)) AS g(k) WHERE f.first < n.doc_id),
p AS (SELECT doc_id, i, w[i] AS word FROM d, UNNEST(range(1, len(w) + 1)) AS g(i)),
k AS (SELECT p.doc_id, count(h.i) AS n_removed, sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (h.i IS NULL), '')) AS kept FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def op7_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    cleaned = repeated_words_removed(documents(spark, sf_dir, "doc_id", "text"), with_text=False)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")
