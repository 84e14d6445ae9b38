"""Blocks out of HTML and Markdown, and chunks out of paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.batches import parts

# The elements that carry text, those that are dropped and those without an end tag.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TEXT_TAGS = ("p", "li", "pre", "td")
DROPPED = ("script", "style", "nav")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


class _Blocks(HTMLParser):
    """The strings of a page and of each of its headings and text elements, in order of opening.

    An end tag closes its element and all that is open within it; one that nothing opened is passed over.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.strings: list[str] = []  # of the whole page, outside dropped elements
        self.found: list[tuple[str, int, bool]] = []  # tag, first string, whether in the body
        self.ends: dict[int, int] = {}
        self.places: list[tuple[int, int]] = []  # depth and number of the open headings and text elements
        self.title: list[str] | None = None
        self.body: list[int] | None = None
        self.run = ""

    def _end_string(self):
        text, self.run = self.run.strip(), ""
        if not text or any(t in DROPPED for t in self.open):
            return
        if "title" in self.open and self.title is not None:
            self.title.append(text)
        self.strings.append(text)

    def handle_data(self, data):
        self.run += data

    def handle_comment(self, data):
        self._end_string()

    def handle_starttag(self, tag, attrs):
        self._end_string()
        if tag in VOID:
            return
        self.open.append(tag)
        if any(t in DROPPED for t in self.open):
            return
        if tag == "title" and self.title is None:
            self.title = []
        elif tag == "body" and self.body is None:
            self.body = [len(self.open), len(self.strings), -1]
        elif tag in HEADINGS or tag in TEXT_TAGS:
            self.places.append((len(self.open), len(self.found)))
            self.found.append((tag, len(self.strings), self.body is not None and self.body[2] < 0))

    def handle_endtag(self, tag):
        self._end_string()
        if tag in self.open:
            self._leave(len(self.open) - self.open[::-1].index(tag))

    def _leave(self, depth: int):
        del self.open[depth - 1 :]
        while self.places and self.places[-1][0] >= depth:
            self.ends[self.places.pop()[1]] = len(self.strings)
        if self.body is not None and self.body[2] < 0 and self.body[0] >= depth:
            self.body[2] = len(self.strings)

    def close(self):
        super().close()
        self._end_string()
        self._leave(1)


def html_sections(html: str | None) -> list[tuple[str | None, tuple[str, ...], str]]:
    """(heading, path, text) of each section of a page: headings, and the texts up to the next one a line each.

    The title heads what comes before the first heading and stands first in every path; a heading closes
    the open ones of its level and deeper; one without text only ends a section. Strings of an element are
    joined by spaces; an element within another gives its text twice. Without any such text the whole
    body's is one section. NULL gives none.
    """
    if html is None:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    title = "".join(parser.title or ()) or None
    out, heading, lines = [], title, []
    path = [(0, title)] if title else []

    def flush():
        if lines:
            out.append((heading, tuple(name for _, name in path), "\n".join(lines)))

    for i, (tag, start, inside) in enumerate(parser.found):
        text = " ".join(parser.strings[start : parser.ends[i]])
        if parser.body is not None and not inside:
            continue
        if tag in HEADINGS:
            flush()
            lines = []
            if text:
                heading, level = text, int(tag[1])
                path = [*(h for h in path if h[0] < level), (level, text)]
        elif text:
            lines.append(text)
    flush()
    if not out:
        first, last = parser.body[1:] if parser.body else (0, len(parser.strings))
        out.append((title, (title,) if title else (), " ".join(parser.strings[first:last])))
    return out


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, ordinal, heading, path, text) of each section of each page; NULL pages have none."""
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, "html")):
            rows = [(i, n, *section) for i, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist()) for n, section in enumerate(html_sections(html))]
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "ordinal", "heading", "path", "text"])

    return own.mapInArrow(run, f"id {kind}, ordinal long, heading string, path array<string>, text string").withColumnRenamed("id", id_col)


def merged(parts: Column, size: int, joiner: str) -> Column:
    """Neighbouring parts joined while they fit ``size``; a longer part stays alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buffer"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["buffer"], F.lit(joiner), part)
        fits = (acc["buffer"] != "") & (F.char_length(joined) <= size)
        flushed = F.when(acc["buffer"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buffer"]))
        return F.struct(F.when(fits, acc["out"]).otherwise(flushed).alias("out"), F.when(fits, joined).otherwise(part).alias("buffer"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["buffer"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buffer"])))


# Where headings, paragraphs and sentences part, and what joins them again.
LEVELS = ((r"(?m)(?=^#{1,6}\s)", "\n"), (r"\n\s*\n", "\n\n"), (r"(?<=[.!?])\s+", " "))


def _splitter(pattern: str, joiner: str, size: int):
    """A lambda: a piece over ``size`` to its merged parts; a piece without two parts stays."""

    def split(piece: Column) -> Column:
        parts = F.filter(F.transform(F.split(piece, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
        return F.when((F.char_length(piece) <= size) | (F.size(parts) <= 1), F.array(piece)).otherwise(merged(parts, size, joiner))

    return split


def cut_hard(piece: Column, size: int) -> Column:
    """Cuts of ``size`` characters; an empty piece is one cut."""
    last = F.greatest(F.floor((F.char_length(piece) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(piece, i * size + 1, F.lit(size)))


def recursive_chunks(text: Column, size: int = 800) -> Column:
    """Pieces of at most ``size`` characters: by headings, else paragraphs, else sentences, else cut hard."""
    pieces = F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    for pattern, joiner in LEVELS:
        pieces = F.flatten(F.transform(pieces, _splitter(pattern, joiner, size)))
    return F.flatten(F.transform(pieces, lambda p: cut_hard(p, size)))
