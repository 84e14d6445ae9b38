"""JSON values as trees: dotted paths, differences, canonical text and content addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.sources.tables import written


def leaves(rows: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys..., path, kind, value) of the leaves of each row's JSON: dotted names, list places in brackets.

    A leaf is a text, number, truth value, null, or an empty object or list; ``value`` is its JSON text. Numbers
    that aren't whole are compared as doubles (kind REAL). What isn't JSON has no leaves. Trees are taken apart
    level by level with ``variant_explode``: as many rounds as the deepest tree has levels, each over the parts that are
    still objects or lists.
    """
    now = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    found = []
    while True:
        now = written(now.withColumn("kind", kind(F.col("v"))), "tree")
        inner = F.col("kind").isin("OBJECT", "ARRAY") & ~F.to_json("v").isin("{}", "[]")
        real = F.col("kind").isin("DECIMAL", "DOUBLE", "FLOAT")
        text = F.when(real, F.try_variant_get("v", "$", "double").cast("string")).otherwise(F.to_json("v"))
        found.append(now.where(~inner).select(*keys, "path", F.when(real, "REAL").otherwise(F.col("kind")).alias("kind"), text.alias("value")))
        deeper = now.where(inner)
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, found)
        part = deeper.sparkSession.tvf.variant_explode(F.col("v").outer())
        step = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") != "", ".").otherwise(""), "_key"))
        now = deeper.select(*keys, "path", "v").lateralJoin(part.toDF("_pos", "_key", "_part")).select(*keys, F.concat("path", step).alias("path"), F.col("_part").alias("v"))


def differences(before: DataFrame, after: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """(keys..., path, change, before, after): the leaves that only one side has, or with another type or value.

    ``change`` is missing, added, type or value. Keys must be different within a side; a row that only one side
    has differs in all its leaves.
    """
    a, b = leaves(before, keys, json_col), leaves(after, keys, json_col)
    a, b = (x.select(*keys, "path", F.struct("kind", "value").alias(side)) for x, side in ((a, "_a"), (b, "_b")))
    both = a.join(b, [*keys, "path"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a.kind") != F.col("_b.kind"), "type").otherwise("value")
    return both.select(*keys, "path", change.alias("change"), F.col("_a.value").alias("before"), F.col("_b.value").alias("after"))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys, no spaces and one form a number: equal values, equal texts. NULL for what isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def ascii_letter(c: Column) -> Column:
    """One character as it stands in JSON text in ASCII, but for quotes, backslashes and the short escapes."""
    n = F.ascii(c)  # its code point
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n.cast("long")), 4, "0")))
    pair = F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
    return F.when(n > 0xFFFF, pair).when((n > 0x7E) | (n < 0x20), unit(n)).otherwise(c)


def json_string(text: Column) -> Column:
    """The text as a JSON string in ASCII: what isn't is written as \\u and four small hexadecimal digits, in pairs beyond them."""
    plain = F.to_json(F.array(text))
    plain = F.substring(plain, 2, F.char_length(plain) - 2)
    short = F.create_map(*[F.lit(x) for pair in {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}.items() for x in pair])

    def letter(c: Column) -> Column:
        return F.coalesce(F.try_element_at(short, c), ascii_letter(c))

    escaped = F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), letter), ""), F.lit('"'))
    return F.when(F.regexp_like(text, F.lit(r"[^\x20-\x7E\n\r\t]")), escaped).otherwise(plain)


def content_address(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON object of the texts, its keys sorted, in ASCII, with ", " and ": "; NULL is null."""
    parts = [F.concat(F.lit(f'"{name}": '), F.coalesce(json_string(value), F.lit("null"))) for name, value in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).cast("binary"), 256)


def cached_verdicts(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """What a cache (key, verdict) answers of ``asked``, and what is still to be judged.

    The first table is ``asked`` with ``verdict`` and ``hit``; the second has one row a missing key, though many rows ask
    for it, with how many do and one of them as ``example``. Rows without a key are neither.
    """
    once = cache.groupBy(key).agg(F.min("verdict").alias("verdict"))
    told = asked.join(once, key, "left").withColumn("hit", F.col("verdict").isNotNull())
    rest = [c for c in asked.columns if c != key]
    misses = asked.where(F.col(key).isNotNull()).join(once, key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("asked"), F.min(F.struct(*rest)).alias("example"))
    return told, misses
