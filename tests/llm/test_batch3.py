import re

import numpy as np

from siftmill.llm import license_zstd, pii_crf

from test_batch1 import ODD, SCHEMA


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(0)
    for alphabet in ("a@.b-1_", "0123.5 ", "0 1-4", "+1 (2).-3x", "ab@c.d@e.f 1.2.3.4+", "é@a.b1 ü٣4"):
        for _ in range(1500):
            text = "".join(rng.choice(list(alphabet), 40))
            assert pii_crf.base_spans(text) == brute_base(text), text
    assert pii_crf.base_spans("4111 1111 1111 1111")[0][1] == 2
    long = "a" * 200_000 + " " + "1" * 200_000 + "@" + "." * 100_000
    assert pii_crf.base_spans(long) == []


def test_field_learns_and_decodes():
    field = pii_crf.train(pii_crf.labelled_sentences())
    right = total = 0
    for words, tags in pii_crf.labelled_sentences(4, seed=99):
        got = field.decode([words])[0]
        right += sum(a == b for a, b in zip(got, tags))
        total += len(tags)
    print("tag accuracy", right / total)
    assert right / total > 0.97
    from itertools import product

    rng = np.random.default_rng(1)
    segments = [s[0][: rng.integers(1, 5)] for s in pii_crf.labelled_sentences(1, seed=4)]
    emitted = field.emissions(segments)
    for s, (words, got) in enumerate(zip(segments, field.decode(segments))):
        def score(tags):
            path = [0, *tags, 0]
            return sum(field.moves[a, b] for a, b in zip(path, path[1:])) + sum(emitted[s, i, t] for i, t in enumerate(tags))
        assert abs(score(got) - max(score(t) for t in product(range(5), repeat=len(words)))) < 1e-9


def test_personal_data(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = pii_crf.op3_pii_crf(spark, "/root/testdata/sf0.01").collect()
    added = 0
    for r in got:
        base = brute_base(rows[r.doc_id])
        assert r.base_sha256 == __import__("hashlib").sha256(pii_crf.told(base).encode()).hexdigest()
        assert set(pii_crf.told(base).split(",")) - {""} <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        if r.n_added:
            added += r.n_added
            print([(s, rows[r.doc_id][int(s.split(":")[1]) - 20 : int(s.split(":")[2]) + 10]) for s in r.spans.split(",") if s not in pii_crf.told(base).split(",")][:3])
    print("added", added, "rows", len(got), "with base", sum(bool(r.spans) for r in got))
    df = spark.createDataFrame([(1, "please call me at (415) 555-0132 after lunch, or jane [at] example [dot] org"), (2, None), (3, ""), (None, "ip 10.0.0.1")], "doc_id long, text string")
    odd = {r.doc_id: r for r in pii_crf.find_personal_data(df).collect()}
    assert "phone:18:32" in odd[1].spans and odd[2].spans == odd[3].spans == "" and odd[None].n_ip == 1
    print(odd[1].spans)
    assert pii_crf.find_personal_data(spark.createDataFrame(ODD, SCHEMA)).count() == len(ODD)
    assert pii_crf.find_personal_data(df.limit(0)).count() == 0


def test_licenses(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    }
    n = 0
    for r in license_zstd.op8_license_zstd(spark, d).collect():
        want = sorted(k for k, line in lines.items() if line in rows[r.doc_id])
        assert r.licenses == ",".join(want), (r, want)
        n += bool(want)
    print("documents with a license", n)
    df = spark.createDataFrame(
        [(1, "x licensed  under the APACHE License, version\n2.0 y"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 1.1."), (5, "a licensed plumber released the permission"), (6, "Licensed under CC BY-NC 4.0. " * 3000), (None, "Released under the MIT License.")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in license_zstd.scan_licenses(df).collect()}
    assert got[1].licenses == "Apache-2.0" and got[1].found.startswith("Apache-2.0:2:") and got[None].licenses == "MIT"
    assert got[2].licenses == got[3].licenses == got[4].licenses == got[5].licenses == "" and got[6].n_found == 3000
    assert license_zstd.scan_licenses(df.limit(0)).count() == 0
