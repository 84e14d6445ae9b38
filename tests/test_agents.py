"""Agent and golden-set operators on hand-made cases."""

import random

from pyspark.sql import functions as F

from siftmill.operators import agents, golden, replay, reviews
from siftmill.operators.logs import importance


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_prices_and_tokens(spark):
    rows = [("anthropic:mock-gpt-4o", 1000, 10), ("replay:gpt-4o", 5, 5), (None, 1, 1), ("gpt-4o-mini", None, 1_000_000)]
    got = agents.with_cost(spark.createDataFrame(rows, "model string, tokens_in long, tokens_out long"))
    assert [r.usd for r in got.collect()] == [0.0026, 0.0, 0.0, 0.6]
    assert one(spark, agents.estimated_tokens(F.lit("abcd"))) == 22


def test_typed_arguments(spark):
    cases = [('{"a": 3}', '{"a": 3, "b": 1}', True), ('{"a": 3}', '{"a": "3"}', False), ('{"a": 3}', '{"a": 3.5}', False), ('{"a": true}', '{"a": true}', True), ("{}", "{}", True), ('{"a": 1}', "not json", False), ('{"a": 1}', None, False)]
    df = spark.createDataFrame(cases, "w string, g string, want boolean").withColumn("got", agents.typed_subset(F.col("w"), F.col("g"), ["a", "b"]))
    assert all(r.got == r.want for r in df.collect())


def test_all_keys_of_arguments(spark):
    cases = [
        ('{"k": 3, "z": 9}', '{"k": 3}', False), ('{"k": 3}', '{"k": 3, "z": 9}', True), ('{"a": 1.50}', '{"a": 1.5}', True), ('{"a": {"x": 1, "y": [2]}}', '{"a": {"y": [2], "x": 1}}', True),
        ('{"a": null}', '{"a": null}', True), ('{"a": null}', "{}", False), ('{"a.b": 1}', '{"a.b": 1}', True), ('{"a": "1"}', '{"a": 1}', False), ('{"a": true}', '{"a": 1}', False), ("[1]", "{}", True),
    ]
    df = spark.createDataFrame(cases, "w string, g string, want boolean").withColumn("got", agents.typed_subset(F.col("w"), F.col("g")))
    assert [(r.w, r.got) for r in df.collect()] == [(r.w, r.want) for r in df.collect()]


def test_plans(spark):
    plans = spark.createDataFrame([("t", "p1", 1), ("t", "p2", 2)], "task string, plan_id string, version int")
    subtasks = spark.createDataFrame(
        [("p1", "a", "research", ["s"]), ("p2", "a", "research", ["s", "zz"]), ("p2", "b", "writing", ["s"]), ("p2", "c", "writing", []), ("p2", "d", "writing", ["t"]), ("p2", "e", "code", None)],
        "plan_id string, sid string, specialist string, tools array<string>",
    )
    tools = spark.createDataFrame([("s", ["research"]), ("t", None), ("file_write", ["writing", "code"])], "tool string, owners array<string>")
    last = agents.latest_plan(plans, subtasks).collect()
    assert {r.sid for r in last} == set("abcde") and last[0].next_version == 3 and {r.plan_id for r in last} == {"p2"}
    found = lambda *more: {(r.plan_id, r.sid, r.finding) for r in agents.plan_findings(subtasks, tools, 4, *more).collect()}
    lint = {("p2", None, "too many subtasks"), ("p2", "e", "no tools"), ("p2", "a", "unknown tool zz"), ("p2", "b", "not its tool s")}  # c is a writer: it may work from its inputs
    assert found() == lint
    made = spark.createDataFrame([("p2", "a.md", "a"), ("p2", "c.md", "c")], "plan_id string, path string, producer string")
    asked = spark.createDataFrame([("p2", "Save the note as `c.md`. Files such as `x.toml` stay; it is SAVED to `out/d.json` and saved `d.md`")], "plan_id string, request string")
    assert found(made, asked) == lint | {("p2", "a", "may not write a.md"), ("p2", "c", "must list file_write for c.md"), ("p2", None, "not listed: out/d.json"), ("p2", None, "not listed: d.md")}
    assert [one(spark, agents.first_sentence(F.lit(t))) for t in ("Reads  a file. Then more.", "One.", None, "v1.2 of it")] == ["Reads a file", "One", "", "v1.2 of it"]


def test_triggers_and_silence(spark):
    lit = F.lit
    plan = lambda c, r: one(spark, agents.plan_trigger(lit(c), lit(r)))
    assert [plan(0.5, True), plan(0.7, True), plan(0.7, False)] == ["low_plan_confidence", "user_requested", None]
    case = lambda *v: one(spark, agents.subtask_trigger(*[lit(x) for x in v]))  # noqa: E731  status, attempts, allowance, errors, reworks, score, silent
    assert case("failed_attempt", 1, 3, 1, 0, None, False) is None and case("failed_attempt", 2, 3, 2, 0, None, False) == "specialist_double_failure"
    assert case("failed_attempt", 3, 3, 1, 0, None, False) == "specialist_double_failure"  # its last attempt
    assert case("rework", 1, 3, 0, 1, 2, False) is None and case("rework", 2, 3, 0, 2, 2, False) == "low_review_score" and case("rework", 2, 3, 0, 2, None, True) == "low_review_score"
    assert case("rework", 3, 3, 1, 1, 2, False) == "low_review_score" and case("completed", 9, 3, 9, 9, 5, False) is None
    assert one(spark, reviews.level(agents.subtask_trigger(*[lit(x) for x in ("rework", 2, 3, 0, 2, 2, False)]))) == "approve_action" and one(spark, reviews.level(agents.plan_trigger(lit(0.1), lit(False)))) == "approve_plan"
    receipts = lambda *r: F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(s).alias("status")) for t, s in r])
    assert one(spark, agents.tools_silent(F.array(lit("a")), receipts(("a", "failure"), ("b", "success"))))
    assert not one(spark, agents.tools_silent(F.array(lit("a")), receipts(("a", "denied")))) and one(spark, agents.tools_silent(F.array(lit("a")), receipts(("a", "rejected"))))
    assert not one(spark, agents.tools_silent(F.array().cast("array<string>"), receipts(("a", "failure"))))


def test_replay(spark):
    rng, recorded, calls, want = random.Random(2), [], [], {}
    for run in range(12):
        own = [(run, s, rng.choice("ab"), rng.choice("xyz")) for s in range(rng.randrange(0, 14))] + [(run, 50, "memory", "m")]
        asked = [(run, s, rng.choice("ab"), rng.choice("xyz")) for s in range(rng.randrange(0, 14))]
        used = set()
        for _, s, agent, prompt in asked:
            open_ = [r for r in own if r[2] == agent and r not in used]
            exact = [r for r in open_ if r[3] == prompt]
            got = next(iter(exact or open_), None)
            used.add(got)
            want[run, agent, s] = (got and got[1], bool(exact))
        recorded, calls = recorded + own, calls + asked
    make = lambda rows: spark.createDataFrame(rows, "run int, seq int, agent string, prompt string")
    served = replay.replayed(make(recorded), make(calls))
    rows = served.collect()
    assert {(r.run, r.agent, r.seq): (r.served, r.exact) for r in rows} == want and len(rows) == len(want)
    told = {r.run: r for r in replay.divergence(served, make(recorded)).collect()}
    for run in range(12):
        taken = {(k[1], v[0]) for k, v in want.items() if k[0] == run}
        left = [r[1] for r in recorded if r[0] == run and r[2] != "memory" and (r[2], r[1]) not in taken]
        lost = [k[2] for k, v in want.items() if k[0] == run and v[0] is None]
        assert (told[run].unused_at, told[run].diverged_at) == (min(left, default=None), min(lost, default=None))


def test_memories(spark):
    df = spark.createDataFrame([(1, "x", 2, 10, 0.5, "u"), (2, "y", 1, 20, 0.1, "u"), (3, "z", 0, 5, 0.2, "v"), (4, "n", 0, 5, 0.2, None)], "id int, text string, accesses int, last_access int, importance double, user string")
    read = {r.id: r for r in agents.bumped(df, spark.createDataFrame([(1,), (1,), (9,)], "id int"), F.lit(99)).collect()}
    assert (read[1].accesses, read[1].last_access, read[1].importance) == (3, 99, 4.0) and read[2].importance == 0.1 and len(read) == 4
    assert one(spark, importance(F.lit(3), F.lit(14.0))) == 2.0
    merged = agents.merged_memories(df.withColumn("component", F.when(F.col("id") < 3, 1).otherwise(F.col("id")))).where("component = 1").first()
    assert (merged.text, merged.accesses, merged.last_access, merged.ids) == ("x", 3, 20, "1,2")
    left, gone = agents.purged({"a": df, "b": df.where("id = 3")}, "u")
    assert [tuple(r) for r in gone.collect()] == [("a", 2), ("b", 0)] and {r.id for r in left["a"].collect()} == {3, 4}
    meta = lambda d: F.create_map(*[F.lit(x) for p in d.items() for x in p])
    assert one(spark, agents.merged_metadata(meta({"id": "1", "k": "a", "o": "x"}), meta({"id": "2", "k": "b", "n": "c"}), ["id"])) == {"id": "1", "k": "b", "o": "x", "n": "c"}
    writes = spark.createDataFrame([("t", "f", "1", 1), ("t", "f", "2", 2), ("t", "g", "1", 1), ("t", "g", None, 2)], "task string, field string, v string, at int")
    assert [tuple(r) for r in agents.latest_fields(writes, "task", "field", "v", "at").collect()] == [("t", "f", "2")]
    assert agents.live(df, "last_access", F.lit(9)).count() == 2


def test_fixtures_and_criteria(spark):
    calls = spark.createDataFrame([(1, "a", "find the red fox"), (2, "a", "exact"), (3, "a", "zzz"), (4, "b", "x")], "call_id int, agent string, text string")
    key = one(spark, agents.fixture_key(F.lit("a"), F.lit("exact")))
    fixtures = spark.createDataFrame([("d", "a", None, []), ("one", "a", None, ["red"]), ("two", "a", None, ["red", "fox"]), ("no", "a", None, ["red", "cat", "x"]), ("k", "a", key, [])], "fixture_id string, agent string, key string, needles array<string>")
    assert {r.call_id: r.fixture_id for r in agents.matched_fixtures(calls, fixtures).collect()} == {1: "two", 2: "k", 3: "d"}
    rows = spark.createDataFrame([("p", False, True), ("p", True, True), (None, False, True), ("p", False, None)], "path string, file_written boolean, passed boolean")
    assert [r.passed for r in agents.decided(rows, F.lit(2)).collect()] == [False, True, True, False]
    assert [r.passed for r in agents.decided(rows, F.lit(None).cast("int")).collect()] == [True, True, True, None]


def test_drafts(spark):
    chunk = "The cache is kept for ten minutes and then it is read again from the disk by the service."
    rows = [
        (1, "How long is it?", "kept for ten  minutes", chunk), (2, "Is the cache is kept for ten minutes or so?", "kept for ten minutes", chunk),
        (3, "How long is it ?", "not there at all", chunk), (4, "What then?", "ten", chunk), (5, "And?", None, None),
    ]
    got = {r.draft_id: r.flags for r in golden.draft_flags(spark.createDataFrame(rows, "draft_id int, question string, quote string, chunk_text string")).collect()}
    assert got == {1: [], 2: ["leak"], 3: ["quote_not_in_chunk", "duplicate"], 4: ["quote_length"], 5: ["quote_not_in_chunk", "quote_length"]}
    ids = spark.createDataFrame([("s3",), ("s12",), ("t99",), ("sx",), (None,)], "id string")
    assert golden.next_number(ids, "id", "s").first().next == 13 and golden.next_number(ids.limit(0), "id", "s").first().next == 1
    text = "one\ntwo  three\nfour\ntwo three four"
    assert one(spark, golden.quote_lines(F.lit(text), F.lit("two three"))) == (2, 2) and one(spark, golden.quote_lines(F.lit(text), F.lit("three four two"))) == (2, 4)
    assert one(spark, golden.quote_lines(F.lit(text), F.lit("five"))) is None
    long = "\n".join(["a", "b", *[f"w{i}\n" for i in range(40)], "a", "b"])
    assert one(spark, golden.quote_lines(F.lit(long), F.lit(" ".join(f"w{i}" for i in range(30))))) == (3, 61) and one(spark, golden.quote_lines(F.lit(long), F.lit("a  b"))) == (1, 2)
    assert one(spark, golden.quote_lines(F.lit(long), F.lit(" "))) is None
    assert [one(spark, golden.no_answer_kind(F.lit(n))) for n in ("near-miss: soon", "odd", None)] == ["near-miss", "unlabelled", "unlabelled"]
    assert one(spark, golden.no_answer_kind(F.lit("near-miss: x"), F.lit("lookup"))) is None
    chunks = spark.createDataFrame([("a/x.md", 1, "c2"), ("a/x.md", 0, "c1"), ("a/y.md", 0, "c3"), ("z.md", 2, "c4")], "source_file string, ordinal int, chunk_id string")
    firsts = {r.chunk_id: (r.folder, r.place) for r in golden.first_of_files(chunks, "s").collect()}
    assert set(firsts) == {"c1", "c3", "c4"} and firsts["c4"] == ("", 1) and {firsts["c1"], firsts["c3"]} == {("a", 1), ("a", 2)}
