"""Budgets, people's reviews and reports on hand-made cases, and against plain versions."""

import json
import random

from pyspark.sql import functions as F

from siftmill.operators import budgets, reports, reviews
from siftmill.operators.evaluation import paired_bootstrap


def test_json_width(spark):
    texts = ["", "plain", 'q"\\', "a\nb\tc\r\x08\x0c", "\x01\x7f", "é…", "😀", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", budgets.json_width(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [len(json.dumps(r.t)) - 2 for r in rows]


def test_cut_values(spark):
    long = "ü" * 201
    given = [json.dumps({"a": long, "b": [{"c": long}, 3, None, True], long: "x", "q": '":'}), "not json", None, "[]", json.dumps("é" * 200)]
    got = [r.x for r in spark.createDataFrame([(t,) for t in given], "t string").select(budgets.cut_values(F.col("t")).alias("x")).collect()]
    cut = "ü" * 200 + "… (201 chars)"
    assert json.loads(got[0]) == {"a": cut, "b": [{"c": cut}, 3, None, True], long: "x", "q": '":'}
    assert got[1] is None and got[2] is None and got[3] == "[]" and got[4] == given[4]


def fitted(spark, values, budget):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    return [r.fitted for r in budgets.fitted_outputs(rows, "t", budget=budget).orderBy("i").collect()]


def test_fitted_outputs(spark):
    items = {"content": {"rows": list(range(500)), "truncated": 1, "end": "e"}, "ok": True}
    strings, both, keys = {"a": "x" * 900, "b": "y" * 10}, {"rows": ["z" * 900] * 40}, {str(i): i for i in range(900)}
    letters = {"t": "ü" * 300 + '"' * 90, "n": 1.5, "s": [None, "😀" * 40]}
    text, whole, one, start, none, no_object, empty, odd = fitted(spark, [items, strings, both, keys, None, "[1]", "{}", letters], 300)
    shown = json.loads(text)["content"]
    n = shown["truncated"]["shown"]
    assert list(shown) == ["rows", "truncated", "end"] and shown["rows"] == list(range(n)) and shown["truncated"]["of"] == 500 and json.loads(text)["ok"] is True
    more = {"content": {"rows": list(range(n + 1)), "truncated": {"shown": n + 1, "of": 500}, "end": "e"}, "ok": True}
    assert len(text) <= 300 < len(json.dumps(more)) and text == json.dumps(json.loads(text))
    assert json.loads(whole)["b"] == "y" * 10 and 297 <= len(whole) <= 300 and json.loads(whole)["a"].endswith("chars]")
    assert json.loads(one)["truncated"] == {"shown": 1, "of": 40} and json.loads(one)["rows"][0].startswith("zzz") and len(one) <= 300
    assert len(start) <= 300 and json.loads(start).startswith('{"0": 0') and (none, no_object, empty) == (None, None, "{}")
    assert len(odd) <= 300 and odd.isascii() and json.loads(odd)["n"] == 1.5


def test_fits_like_trying_every_number(spark):
    """Budgets against every number of items and every length of strings, each rendered."""
    rng, values = random.Random(4), []
    for _ in range(40):
        long = [rng.choice(["a", "é", "b c", '"']) * rng.randrange(1, 60) for _ in range(rng.randrange(0, 30))]
        value = {"k": "v" * rng.randrange(0, 400), "rows": long, "more": [rng.randrange(10**6) for _ in range(rng.randrange(0, 60))], "truncated": 3, "z": {"b": 1}}
        values.append({"status": 1, "content": value, "last": "end"} if rng.random() < 0.5 else value)

    def plain(value, budget):
        shown = json.dumps(value)
        if len(shown) <= budget:
            return shown
        inner = value.get("content")
        pools = [(value, None), (inner, "content")] if isinstance(inner, dict) else [(value, None)]
        lists = [(len(json.dumps(v)), pool, name, key) for pool, name in pools for key, v in pool.items() if isinstance(v, list) and v and key != "truncated"]
        best = max(lists, key=lambda x: x[0], default=None)
        if best:
            _, pool, name, key = best
            for n in range(len(pool[key]) - 1, 0, -1):
                new = {}
                for k, v in pool.items():
                    if k == key:
                        new |= {k: v[:n], "truncated": {"shown": n, "of": len(v)}}
                    elif k != "truncated":
                        new[k] = v
                shown = json.dumps(new if name is None else {**value, "content": new})
                if len(shown) <= budget:
                    return shown
        return None  # the other ways are looked at by length below

    for value, got in zip(values, fitted(spark, values, 260)):
        want = plain(value, 260)
        assert len(got) <= 260 and (want is None or got == want), (value, got, want)


def plain_listing(documents, budget):
    """Every number of directories and sources tried, each rendered."""
    documents = sorted(documents, key=lambda d: d["source_file"])
    total = sum(d["chunks"] for d in documents)
    whole = {"sources": documents, "truncated": None, "total_chunks": total, "directories": None}
    if len(json.dumps(whole)) <= budget:
        return whole
    folders = {}
    for d in documents:
        head = d["source_file"][: d["source_file"].rfind("/") + 1]
        folders.setdefault(head, []).append(d["chunks"])
    rows = [{"directory": k, "documents": len(v), "chunks": sum(v)} for k, v in sorted(folders.items())]

    def shaped(n, m):
        return {"sources": documents[:n], "truncated": {"shown": n, "of": len(documents)}, "total_chunks": total, "directories": rows[:m]}

    m = max((m for m in range(len(rows) + 1) if len(json.dumps(shaped(0, m))) <= budget), default=0)
    n = max((n for n in range(len(documents)) if len(json.dumps(shaped(n, m))) <= budget), default=0)
    return shaped(n, m)


def test_source_listing(spark):
    names = [f"d{i % 7}/é{i % 3}/{i}.md" for i in range(90)] + ["top.md", 'q"uote.md']
    for n, budget in [(0, 300), (3, 400), (92, 700), (92, 2500), (92, 9000), (92, 120), (5, 330)]:
        docs = [{"source_file": name, "chunks": i * 7} for i, name in enumerate(names[-n:] if n else [])]
        rows = spark.createDataFrame([(d["source_file"], d["chunks"], 1) for d in docs], "source_file string, chunks int, used int")
        got, want = budgets.fitted_sources(rows, budget).first().asDict(recursive=True), plain_listing(docs, budget)
        assert got["sources"] == want["sources"] and got["directories"] == want["directories"] and got["total_chunks"] == want["total_chunks"]
        assert got["shown"] == (want["truncated"] or {}).get("shown") and got["of"] == len(docs)


def test_requests_and_answers(spark):
    t = "timestamp '2024-01-01 00:00:0{}'"
    requests = spark.sql(f"""SELECT * FROM VALUES ('b', 't', 'plan', 'user_requested', 'approve_plan', {t.format(2)}), ('a', 't', 'plan', 'user_requested', 'approve_plan', {t.format(1)}),
        ('n', 't', 'final', 'x', 'notify', {t.format(3)}), ('o', 't', 'old', 'x', NULL, {t.format(3)}), ('z', NULL, 'plan', 'x', NULL, {t.format(3)}) AS (approval_id, task, gate, trigger, level, created_at)""")
    old = spark.sql(f"SELECT 'h' AS approval_id, 't' AS task, 'old' AS gate, 'x' AS trigger, 'x' AS level, {t.format(0)} AS created_at, 'resolved' AS status, 'approve' AS action, {t.format(1)} AS resolved_at, 1D AS review_seconds")
    rows = reviews.opened(old, requests)
    assert {(r.approval_id, r.status) for r in rows.collect()} == {("h", "resolved"), ("a", "pending"), ("n", "notified")}
    answers = spark.sql(f"SELECT * FROM VALUES ('a', 'reject', {t.format(5)}), ('a', 'approve', {t.format(4)}), ('h', 'reject', {t.format(4)}), ('n', 'reject', {t.format(4)}) AS (approval_id, action, at)")
    done = {r.approval_id: (r.status, r.action, r.review_seconds) for r in reviews.resolved(rows, answers).collect()}
    assert done == {"h": ("resolved", "approve", 1.0), "a": ("resolved", "approve", 3.0), "n": ("notified", None, None)}
    assert [r.approval_id for r in reviews.review_listing(rows, task="t").collect()] == ["n", "a", "h"]


def test_routes(spark):
    cases = [(None, 0.9, False, "failed"), (True, 0.69, None, "escalate_plan"), (True, 0.9, True, "escalate_plan"), (True, None, False, "schedule"), (True, 0.7, None, "schedule")]
    df = spark.createDataFrame(cases, "p boolean, c double, r boolean, want string").select("want", reviews.after_plan(F.col("p"), F.col("c"), F.col("r")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    cases = [("plan", None, "schedule"), ("plan", "take_over", "deliver"), ("plan", "fail", "end"), ("subtask:a", "fail", "end"), ("subtask:a", "take_over", "schedule"), ("final", "reject", "end"), ("final", "fail", "deliver"), ("final", None, "deliver")]
    df = spark.createDataFrame(cases, "g string, a string, want string").select("want", reviews.after_answer(F.col("g"), F.col("a")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_waves_and_attributes(spark):
    spans = spark.sql("""SELECT * FROM VALUES ('t', 'schedule', 's2', timestamp '2024-01-01', map('wave', '["c"]')), ('t', 'schedule', 's1', timestamp '2024-01-01', map('wave', '["a", "b"]')),
        ('t', 'schedule', 's3', timestamp '2024-01-01', map('wave', '[]')), ('t', 'schedule', 's4', timestamp '2024-01-01', map('wave', 'no')), ('t', 'x', 's5', timestamp '2024-01-01', map()) AS (task_id, name, span_id, start_time, attributes)""")
    assert [(r.task_id, r.waves) for r in reviews.scheduled_waves(spans).collect()] == [("t", [["a", "b"], ["c"]])]
    one = spark.range(1).select(reviews.request_attributes(F.create_map(F.lit("n"), F.lit("1"), F.lit("gone"), F.lit(None).cast("string")), F.create_map(F.lit("rerank"), F.lit(2))).alias("x")).first().x
    assert one == {"rag.n": "1", "rag.timings_ms.rerank": "2"}


def test_intervals_follow_the_differences(spark):
    rows = [(i, "dev", arm, "de" if i % 2 else None, float((i * 7 + k) % 3), None if i == 5 else float(i)) for i in range(20) for k, arm in enumerate("ab")]
    records = spark.createDataFrame(rows, "id int, split string, arm string, lang string, m double, t double")
    got = {(r.stratum): r for r in reports.ablation_intervals(records, "a", ["m"], "lang", resamples=200).collect()}
    assert set(got) == {"all", "de"} and got["all"].n == 20 and got["de"].n == 10
    plain = spark.createDataFrame([("x", float((i * 7 + 1) % 3 - (i * 7) % 3)) for i in range(20)], "g string, d double")
    want = paired_bootstrap(plain, ["g"], "d", 200).first()
    assert (got["all"].mean, got["all"].low, got["all"].high) == (want["mean"], want.low, want.high)
    arms = reports.ablation_arms(records, ["m"], ["t"]).where("arm = 'a'").first()
    assert (arms.n, arms.t_p50, arms.t_p95) == (20, 10.0, 19.0)


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", 0.12345678)], "k string, threshold double").withColumn("v", F.col("threshold"))
    table = reports.markdown_table(rows, {"k": F.col("k"), "v": reports.interval_cell(F.col("v"), F.lit(0.1), F.lit(0.2))}, ["k"])
    assert table.first().text == "| k | v |\n|---|---|\n| a | 0.123 [0.10, 0.20] |\n| b | n/a |"
    assert reports.markdown_table(rows.where("false"), {"k": F.col("k")}, ["k"]).first().text == "| k |\n|---|"
    reports.write_report([reports.section("One", table), reports.section("Two", table)], str(tmp_path / "r"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert text.startswith("## One\n\n| k | v |") and text.count("| b | n/a |") == 2 and text.index("## One") < text.index("## Two")
    reports.write_records(rows, str(tmp_path / "j"))
    assert {(r.threshold, r.v) for r in spark.read.json(str(tmp_path / "j")).where("k = 'a'").collect()} == {(0.12345678, 0.123457)}
