import random
import sys
from collections import Counter, defaultdict

sys.path.insert(0, "tests")

from pyspark.sql import functions as F

import corpus_pipeline
from siftmill.llm import ball_simhash, license_zstd, systematic_mix
from siftmill.llm.storage import word_count


def test_short_texts_keep_their_language(spark):
    """Texts of one to five words stay in the pipeline's first stage; a long text of no learned language goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng, short = random.Random(0), ["Edrere.", "Edstou reinan ed for.", "A.", "Re.", "Reouti anatha. 19.37.233.111", "Die tz.", "Avec."]
    for r in docs.where("lang IS NOT NULL AND n_chars > 100").orderBy("doc_id").limit(400).collect():
        words = [w for w in r.text.split() if any(c.isalpha() for c in w)]
        n = rng.randint(1, 5)
        at = rng.randrange(max(1, len(words) - n))
        if words and sum(map(len, words[at : at + n])) < 50:
            short.append(" ".join(words[at : at + n]))
    foreign = [" ".join("".join(rng.choice("бвгджзклмнпрст") for _ in range(7)) for _ in range(60)) for _ in range(5)]
    rows = [(10**9 + i, t, None) for i, t in enumerate(short)] + [(2 * 10**9 + i, t, None) for i, t in enumerate(foreign)] + [(3 * 10**9, "12 34", None)]
    more = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, more, "").where("doc_id >= 1000000000").select("doc_id").collect()}
    assert len(short) > 200 and kept == {10**9 + i for i in range(len(short))}


def test_licenses_with_one_difference(spark):
    """One word added, missing or changed in any template is found, also as a document's last and first words."""
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    lost = []
    for name, texts in license_zstd.TEMPLATES.items():
        for text in texts:
            words = text.split()
            own, fixed, cues = next((t[1], t[2], t[4]) for t in scanner.templates if t[0] == name and t[1] == [license_zstd.plain(w) for w in words])
            free = [i for i, f in enumerate(fixed) if not f and cues != [i]]
            edits = [words[:i] + words[i + 1 :] for i in free] + [[*words[:i], "hereby", *words[i + 1 :]] for i in free]
            edits += [[*words[:i], "hereby", *words[i:]] for i in range(1, len(words))]
            for edit in edits:
                line = " ".join(edit)
                for whole in (line, f"Some code of ours.\n{line}", f"{line}\nAnd more text follows here."):
                    found = scanner.scan(whole)[1]
                    if [f[0] for f in found] != [name] or found[0][3] > 1:
                        lost.append((name, whole, found))
    assert not lost, (len(lost), lost[:5])
    other = [
        "Released under the Artistic License.", "Released under the License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY 3.0.",
        "This work is licensed under the GNU Lesser General Public License, version 2.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This Source Code Form is subject to the terms of the Eclipse Public License, v. 2.0.",
    ]
    assert [scanner.scan(t)[1] for t in other] == [[]] * len(other)
    text = "This work is hereby licensed under the GNU General Public License, version 3."
    assert [(f[0], text[f[1] : f[2]], f[3]) for f in scanner.scan(text)[1]] == [("GPL-3.0", text, 1)]


def test_mix_keeps_rows_without_identifier(spark):
    """Sources meet their targets with NULL and repeated identifiers, and rows keep their columns."""
    rng = random.Random(3)
    rows = [(None if i % 2 else i // 4, " ".join(["w"] * rng.randint(1, 40)) + f" t{i}", rng.choice(["a", "b", "c", "d", None]), i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(5)
    want = {r.source: r.target for r in systematic_mix.source_targets(docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))).collect()}
    got, given = systematic_mix.mix_documents(docs).collect(), {r[3]: r for r in rows}
    taken, times = defaultdict(int), Counter(r.n_chars for r in got)
    for r in got:
        assert tuple(r) == given[r.n_chars]
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 2 * 41 for s in want) and max(times.values()) <= 3
    copies = systematic_mix.systematic_copies(docs, carry=True).select("row.n_chars", "copies").collect()
    assert len(copies) == len(rows) and {k: n for k, n in copies if n} == times
    assert Counter(map(tuple, systematic_mix.mix_documents(docs.repartition(3)).collect())) == Counter(map(tuple, got))


def test_near_copies_of_a_repeated_identifier(spark):
    """Rows of one identifier with different texts are judged by their own groups; every group keeps a row."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (3, texts[3]), (4, texts[3]), (5, texts[3].upper()), (6, None), (6, ""), (7, texts[4]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ball_simhash.drop_near_copies(df).collect()), key=str)
    want = [(1, texts[0]), (1, texts[1]), (3, texts[2]), (3, texts[3]), (6, None), (7, texts[4]), (None, texts[5])]
    assert [g for g in got if g[0] != 6] == sorted((w for w in want if w[0] != 6), key=str) and sum(g[0] == 6 for g in got) == 1
