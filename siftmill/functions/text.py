"""Text expressions: normalisation, tokenising, chunking and parsing as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define the token classes.
WORD = r"[a-z0-9]+"
# A word without a mark after it is given up at once, not tried again from each of its letters; a long compound takes no stack.
COMPOUND = r"(?<![a-z0-9])[a-z0-9]++(?:[._-][a-z0-9]++)++"


def normalize_text(text: Column) -> Column:
    """LF line ends, no trailing blanks on lines, at most one empty line in a row, no outer newlines."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+(?=\n|$)", "")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\n+|\n+$", "")


def normalize_ws(text: Column) -> Column:
    """Every run of white space (Unicode) becomes one space; outer white space goes."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased words, then the compounds (dotted, dashed, underscored) whole; repeats stay."""
    low = F.lower(text)
    return F.concat(
        F.regexp_extract_all(low, F.lit(WORD), F.lit(0)),
        F.regexp_extract_all(low, F.lit(COMPOUND), F.lit(0)),
    )


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores (Unicode), lower-cased; repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between white space that follows a full stop, exclamation or question mark; empty parts go."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def code_share(text: Column) -> Column:
    """Share of characters inside fences, the fence lines included.

    A text may start inside a fence: with an odd number of fence lines the larger of both readings counts.
    """
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))
    is_fence = lambda line: F.ltrim(line).startswith("```") | F.ltrim(line).startswith("~~~")
    start = F.struct(F.lit(0).alias("fences"), F.lit(0).alias("odd"), F.lit(0).alias("even"), F.lit(0).alias("marks"))

    def step(acc: Column, line: Column) -> Column:
        n, fence = F.char_length(line), is_fence(line)
        inside = F.pmod(acc["fences"], F.lit(2)) == 1
        return F.struct(
            (acc["fences"] + fence.cast("int")).alias("fences"),
            (acc["odd"] + F.when(~fence & inside, n).otherwise(0)).alias("odd"),
            (acc["even"] + F.when(~fence & ~inside, n).otherwise(0)).alias("even"),
            (acc["marks"] + F.when(fence, n).otherwise(0)).alias("marks"),
        )

    def finish(acc: Column) -> Column:
        code = F.when(F.pmod(acc["fences"], F.lit(2)) == 1, F.greatest(acc["odd"], acc["even"])).otherwise(acc["odd"])
        return (code + acc["marks"]).cast("double") / F.greatest(F.char_length(text), F.lit(1))

    return F.aggregate(lines, start, step, finish)


# Names and formats of credentials.
_SECRET_NAME = (
    r"(?:secret|secret[_-]?key|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|account[_-]?key"
    r"|(?:access|auth|refresh|session|api)[_-]?token)"
)
REDACTED = "[redacted]"
REDACTIONS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)", REDACTED),
    (r"\b([A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]+):[^\s/@]+@", "$1:" + REDACTED + "@"),
    (r"(?i)\b(bearer\s+)(?=[\w.~+/=-]*\d)[\w.~+/=-]{8,}", "$1" + REDACTED),
    (r"(?i)(?<![\w-])([\w-]*" + _SECRET_NAME + r"[\"']?\s*[:=]\s*[\"']?)[^\s\"',;&}]+", "$1" + REDACTED),
    (
        r"\b(?:sk-[\w-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|AKIA[0-9A-Z]{16}"
        r"|xox[abposr]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})", REDACTED,
    ),
)


def redact(text: Column) -> Column:
    """Credentials replaced, the patterns applied in their order."""
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


# Fixed value: how a citation looks.
CITATION = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"


def citation_indices(answer: Column) -> Column:
    """The numbers cited as [1] or [1, 2], each once, in order of first appearance."""
    inner = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0)), lambda m: F.split(F.regexp_replace(m, r"[\[\]\s]", ""), ","))
    return F.array_distinct(F.transform(F.flatten(inner), lambda n: n.cast("int")))


def answer_completeness(answer: Column) -> Column:
    """Share of sentences that carry a citation; 0 without a sentence."""
    parts = sentences(answer)
    cited = F.size(F.filter(parts, lambda s: F.regexp_like(s, F.lit(CITATION))))
    return F.coalesce(F.try_divide(cited.cast("double"), F.size(parts)), F.lit(0.0))


def fixed_windows(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """Windows of ``size`` code points every ``size - overlap``; the first to reach the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")
    step = size - overlap
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * step + 1, F.lit(size)))
    )


def chunk_id(source: Column, strategy: Column, ordinal: Column, heading: Column, page: Column, text: Column) -> Column:
    """The first 16 hex digits of the SHA-1 over the chunk's identity; NULL heading and page count as empty."""
    blank = F.lit("")
    parts = (source, strategy, ordinal.cast("string"), heading, page.cast("string"), text)
    return F.substr(F.sha1(F.concat_ws("|", *[F.coalesce(p, blank) for p in parts])), F.lit(1), F.lit(16))
