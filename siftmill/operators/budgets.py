"""JSON cut to a budget of characters: long values, any result of a tool, the list of a corpus's sources.

Widths are those of JSON text in ASCII with ``, `` and ``: `` between its parts, escapes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.operators.trees import ascii_letter, json_string
from siftmill.sources.tables import written

# Characters of a value, of a tool's result (the least budget, too) and of a list of sources.
VALUE_CHARS, OUTPUT_CHARS, LEAST_OUTPUT, SOURCES_CHARS = 200, 2000, 200, 3600
COUNTS = "truncated"


def json_width(text: Column) -> Column:
    """Characters that ``text`` takes inside a JSON string; NULL for NULL."""
    short = F.regexp_replace(text, r'["\\\n\r\t\x08\f]', "x" * 2)
    pairs = F.regexp_replace(short, r"[\x{10000}-\x{10FFFF}]", "x" * 12)
    return F.char_length(F.regexp_replace(pairs, r"[^ -~]", "x" * 6))


def _pieces(json: Column) -> Column:
    """The strings of JSON text, quotes included, and what stands between them, in order."""
    return F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]++'), F.lit(0))


def _in_ascii(string: Column) -> Column:
    """A JSON string with its characters that aren't ASCII escaped; its own escapes stay."""
    return F.when(F.regexp_like(string, F.lit("[^ -~]")), F.array_join(F.transform(F.split(string, ""), ascii_letter), "")).otherwise(string)


def _between(piece: Column) -> Column:
    """What stands between strings, with one space behind each comma and colon and none elsewhere."""
    return F.regexp_replace(F.regexp_replace(piece, r"\s+", ""), "([,:])", "$1 ")


def spaced(json: Column) -> Column:
    """Valid JSON text in ASCII with one space behind each comma and colon, none elsewhere."""
    return F.array_join(F.transform(_pieces(json), lambda t: F.when(t.startswith('"'), _in_ascii(t)).otherwise(_between(t))), "")


def _strings(json: Column) -> Column:
    """struct(piece, value) of each piece, spaced; ``value`` is the text of a string that isn't a key, else NULL.

    The pieces are bound to a lambda's variable, as they would be made again for each of them otherwise.
    """
    text = lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))
    is_value = lambda pieces, t, i: t.startswith('"') & ~F.ltrim(F.coalesce(F.get(pieces, i + 1), F.lit(""))).startswith(":")
    told = lambda pieces: F.transform(pieces, lambda t, i: F.struct(F.when(t.startswith('"'), t).otherwise(_between(t)).alias("piece"), F.when(is_value(pieces, t, i), text(t)).alias("value")))
    return F.get(F.transform(F.array(_pieces(json)), told), F.lit(0))


def cut_values(arguments: Column, limit: int = VALUE_CHARS) -> Column:
    """The JSON with each string over ``limit`` characters cut to it and its length noted, at any depth; NULL
    where it isn't JSON."""
    def cut(s: Column) -> Column:
        n = F.char_length(s["value"])
        note = F.concat(F.substring(s["value"], 1, limit), F.lit("… ("), n.cast("string"), F.lit(" chars)"))
        return F.when(n > limit, json_string(note)).otherwise(_in_ascii(s["piece"]))

    return F.when(F.try_parse_json(arguments).isNotNull(), F.array_join(F.transform(_strings(arguments), cut), ""))


def _cut_to(value: Column, limit: Column) -> Column:
    return F.concat(F.left(value, limit), F.lit("…[+"), (F.char_length(value) - limit).cast("string"), F.lit(" chars]"))


def _shortened(parts: Column, budget: int) -> Column:
    """The pieces joined with their strings cut to the largest common length that the budget allows; NULL if none does.

    Of each string the shorter JSON of itself and its cut counts. The length is narrowed by halves on widths
    alone: a string's width is that of its cut's text, so nothing is put together before it is known.
    """
    kept = F.aggregate(parts, F.lit(0), lambda n, s: n + F.when(s["value"].isNull(), F.char_length(s["piece"])).otherwise(0))
    cut_width = lambda s, limit: F.least(F.char_length(s["piece"]), F.when(F.char_length(s["value"]) > limit, 2 + json_width(_cut_to(s["value"], limit))).otherwise(F.char_length(s["piece"])))
    width = lambda limit: kept + F.aggregate(parts, F.lit(0), lambda n, s: n + F.when(s["value"].isNotNull(), cut_width(s, limit)).otherwise(0))
    longest = F.least(F.lit(budget), F.aggregate(parts, F.lit(0), lambda n, s: F.greatest(n, F.coalesce(F.char_length(s["value"]), F.lit(0)))))

    def halve(state: Column, step: Column) -> Column:
        middle = state["low"] + step
        fits = (middle <= longest) & (width(middle) <= budget)
        return F.struct(F.when(fits, middle).otherwise(state["low"]).alias("low"))

    steps = F.array(*[F.lit(1 << k) for k in range(budget.bit_length(), -1, -1)])
    limit = F.when(width(F.lit(0)) <= budget, F.aggregate(steps, F.struct(F.lit(0).alias("low")), halve)["low"])
    changed = lambda s, at: F.when(s["value"].isNull() | (F.char_length(s["value"]) <= at) | (2 + json_width(_cut_to(s["value"], at)) >= F.char_length(s["piece"])), s["piece"]).otherwise(json_string(_cut_to(s["value"], at)))
    return F.element_at(F.transform(F.array(limit), lambda at: F.when(at.isNotNull(), F.array_join(F.transform(parts, lambda s: changed(s, at)), ""))), 1)


def _members(json: Column) -> Column:
    """struct(key, text, items) of an object's members in its own order; ``items`` of a list, else NULL. NULL for what isn't an object."""
    whole = F.map_entries(F.from_json(json, "map<string,variant>"))
    show = lambda v: spaced(F.to_json(v))
    items = lambda v: F.transform(F.try_variant_get(v, "$", "array<variant>"), show)
    return F.transform(whole, lambda m: F.struct(m["key"].alias("key"), show(m["value"]).alias("text"), items(m["value"]).alias("items")))


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: F.concat(json_string(m["key"]), F.lit(": "), m["text"])), ", ")


def fitted_outputs(rows: DataFrame, output: str, to: str = "fitted", budget: int = OUTPUT_CHARS) -> DataFrame:
    """``rows`` with a tool's JSON object in at most ``budget`` characters; NULL where it isn't one.

    Whole if it fits. Else with the first items of its longest list (a member of it or of its ``content``, the first of equal ones),
    as many as fit, and ``truncated`` with their number and that of all right behind it, in place of one there was.
    Else with all strings that aren't keys cut to one length; else both, with one item; else the start of the
    text as a string. Members keep their order in the object and in ``content``; below, keys are sorted where a list is cut.
    What the items take is added up once over the list, as far as a budget can hold any. The rows are written to the
    shared folder between the steps.
    """
    if budget < LEAST_OUTPUT:
        raise ValueError(f"a budget has at least {LEAST_OUTPUT} characters")
    json = F.col(output)
    own = rows.withColumn("_whole", F.when(F.schema_of_variant(F.try_parse_json(json)).startswith("OBJECT"), spaced(json)))
    over = F.char_length("_whole") > budget
    content = F.try_element_at(F.from_json(json, "map<string,string>"), F.lit("content"))
    own = own.withColumn("_top", F.when(over, _members(json))).withColumn("_content", F.when(over, _members(content)))
    lists = lambda name, inner: F.transform(
        F.filter(F.coalesce(F.col(name), F.array().cast("array<struct<key:string,text:string,items:array<string>>>")), lambda m: (F.size(m["items"]) > 0) & (m["key"] != COUNTS)),
        lambda m, i: F.struct(F.char_length(m["text"]).alias("width"), F.lit(not inner).alias("outer"), (-i).alias("place"), m["key"].alias("key"), m["items"].alias("items")),
    )
    own = own.withColumn("_list", F.array_max(F.concat(lists("_top", False), lists("_content", True))))
    own = written(own, "outputs")  # each written table also keeps the plan's expressions from growing into each other
    key, inner = F.col("_list.key"), ~F.col("_list.outer")
    held = F.filter(F.when(inner, F.col("_content")).otherwise(F.col("_top")), lambda m: m["key"] != COUNTS)
    at = F.array_position(F.transform(held, lambda m: m["key"]), key).cast("int")
    around = lambda members, i: (F.concat(_joined(F.slice(members, F.lit(1), i - 1)), F.when(i > 1, ", ").otherwise("")), F.concat(F.when(i < F.size(members), ", ").otherwise(""), _joined(F.slice(members, i + 1, F.size(members)))))
    before, after = around(held, at)
    place = F.array_position(F.transform("_top", lambda m: m["key"]), F.lit("content")).cast("int")
    outer_before, outer_after = around(F.col("_top"), place)
    own = own.withColumn("_before", F.concat(F.lit("{"), F.when(inner, F.concat(outer_before, F.lit('"content": {'))).otherwise(""), before, json_string(key), F.lit(": [")))
    own = own.withColumn("_after", F.concat(after, F.lit("}"), F.when(inner, F.concat(outer_after, F.lit("}"))).otherwise("")))
    own = written(own.drop("_top", "_content"), "outputs")
    all_ = F.size("_list.items")
    counts = lambda n: F.concat(F.lit(f'], "{COUNTS}": {{"shown": '), n.cast("string"), F.lit(', "of": '), all_.cast("string"), F.lit("}"))
    fixed = F.char_length("_before") + F.char_length("_after")
    first = F.slice("_list.items", 1, budget)

    def take(state: Column, item: Column) -> Column:
        n, used = state["n"] + 1, state["used"] + F.char_length(item) + F.when(state["n"] > 0, 2).otherwise(0)
        fits = (n < all_) & (fixed + used + F.char_length(counts(n)) <= budget)
        return F.struct(n.alias("n"), used.alias("used"), F.when(fits, n).otherwise(state["best"]).alias("best"))

    zero = lambda name: F.lit(0).alias(name)
    own = own.withColumn("_n", F.aggregate(first, F.struct(zero("n"), zero("used"), zero("best")), take)["best"])
    with_first = lambda n: F.concat("_before", F.array_join(F.slice("_list.items", F.lit(1), n), ", "), counts(n), "_after")
    own = own.withColumn("_fewer", F.when(F.col("_n") > 0, with_first(F.col("_n"))))
    hard = over & F.col("_fewer").isNull()
    own = own.withColumns({"_parts": F.when(hard, _strings(F.col("_whole"))), "_one": F.when(hard & (all_ > 0), _strings(with_first(F.lit(1)))), "_text": F.when(hard, F.array(F.struct(json_string(F.col("_whole")).alias("piece"), F.col("_whole").alias("value"))))})
    own = written(own, "outputs")
    told = F.when(~over, F.col("_whole")).otherwise(F.coalesce("_fewer", _shortened(F.col("_parts"), budget), _shortened(F.col("_one"), budget), _shortened(F.col("_text"), budget)))
    return written(own.select(*[F.col(c) for c in rows.columns if c != to], told.alias(to)), "outputs")


def _digits(number: Column) -> Column:
    return F.char_length(number.cast("string"))


def _leading(rows: DataFrame, order: str, width: Column, least: int, budget: int) -> DataFrame:
    """The first rows by ``order`` with place and used, the characters of all up to there: as many as a budget can hold."""
    first = rows.orderBy(order, "chunks").limit(budget // least + 1)  # a top-k; the window runs over these few rows
    place = Window.orderBy(order, "chunks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("place", F.count(F.lit(1)).over(place)).withColumn("used", F.sum(width + 2).over(place) - 2)


def fitted_sources(sources: DataFrame, budget: int = SOURCES_CHARS) -> DataFrame:
    """One row (sources, shown, of, total_chunks, directories) of ``sources`` (source_file, chunks).

    All sources by path if their JSON fits the budget; shown and directories are NULL then. Else first as many
    directories, by path with their numbers of documents and chunks, then as many sources as fit. NULL paths
    count as empty, NULL chunks as 0; an empty table gives empty sources. What is gathered is bounded by the
    budget, as each entry takes some characters of it.
    """
    own = sources.select(F.coalesce(F.col("source_file").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("chunks").cast("long"), F.lit(0)).alias("chunks"))
    source = '{"source_file": "", "chunks": }'
    width = len(source) + json_width(F.col("name")) + _digits(F.col("chunks"))
    folders = own.groupBy(F.regexp_extract("name", r"(?s)^.+/", 0).alias("name")).agg(F.count(F.lit(1)).alias("documents"), F.sum("chunks").alias("chunks"))
    folder = '{"directory": "", "documents": , "chunks": }'
    folder_width = len(folder) + json_width(F.col("name")) + _digits(F.col("documents")) + _digits(F.col("chunks"))

    columns = ["kind", "place", "name", "documents", "chunks", "used"]
    a = _leading(own.withColumn("documents", F.lit(1).cast("long")), "name", width, len(source) + 1, budget).withColumn("kind", F.lit("source"))
    b = _leading(folders, "name", folder_width, len(folder) + 2, budget).withColumn("kind", F.lit("directory"))
    c = own.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(width + 2) - 2, F.lit(0)).alias("used"))
    c = c.withColumn("kind", F.lit("all")).withColumn("place", F.lit(0).cast("long")).withColumn("name", F.lit(""))

    def gathered(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "name", "documents", "chunks", "used"))))

    rows = a.select(columns).union(b.select(columns)).union(c.select(columns))
    one = rows.agg(gathered("source").alias("s"), gathered("directory").alias("d"), F.first(F.when(F.col("kind") == "all", F.struct("documents", "chunks", "used")), True).alias("all"))
    n, chunks = F.col("all.documents"), F.col("all.chunks")
    whole = len('{"sources": [], "truncated": null, "total_chunks": , "directories": null}') + _digits(chunks) + F.col("all.used") <= budget
    frame = len('{"sources": [], "truncated": {"shown": , "of": }, "total_chunks": , "directories": []}') + _digits(n) + _digits(chunks)
    one = one.withColumn("_d", F.filter("d", lambda x: frame + 1 + x["used"] <= budget))
    listed = F.coalesce(F.array_max(F.transform("_d", lambda x: x["used"])), F.lit(0))
    one = one.withColumn("_s", F.when(whole, F.col("s")).otherwise(F.filter("s", lambda x: (x["place"] < n) & (frame + listed + _digits(x["place"]) + x["used"] <= budget))))
    return one.select(
        F.transform("_s", lambda x: F.struct(x["name"].alias("source_file"), x["chunks"].alias("chunks"))).alias("sources"),
        F.when(~whole, F.size("_s")).alias("shown"), n.alias("of"), chunks.alias("total_chunks"),
        F.when(~whole, F.transform("_d", lambda x: F.struct(x["name"].alias("directory"), x["documents"].alias("documents"), x["chunks"].alias("chunks")))).alias("directories"),
    )
