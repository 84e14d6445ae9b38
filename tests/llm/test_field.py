"""The field on sentences that it isn't trained on, its certain words, and items that stand together."""

import random

import pytest

from siftmill.llm import pii_crf as P


@pytest.fixture(scope="module")
def field():
    return P.train(P.labelled_sentences())


def test_held_out(field):
    precision, recall = P.measured(field, P.labelled_sentences(10, seed=5, table=P.HELD_OUT))
    print("held out: precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.75


def test_certain_words_are_exact(field):
    """Cutting texts at words that are O for certain changes no tag of the whole text's best path."""
    rng = random.Random(2)
    words = [w for s, _ in P.labelled_sentences(3) for w in s] + ["plain", "words", "of", "no", "kind", "at", "dot"] * 40
    texts = [[rng.choice(words) for _ in range(rng.randrange(0, 60))] for _ in range(300)]
    for text, found in zip(texts, field.tagged(texts)):
        whole = field.decode([text])[0] if text else []
        tags = dict(found)
        assert [tags.get(i, 0) for i in range(len(text))] == whole
    assert field.tagged([[], []]) == [[], []]


def test_neighbouring_items(spark):
    rows = [
        (1, "call (415) 555-0132 (415) 555-0199 (212) 555-0100 today"), (2, "call (415) 555-0132 +1 (415) 555-0199 today"),
        (3, "write to jane [at] example [dot] org bob [at] example [dot] com please"), (4, "his mail is jane(at)example.com now"), (5, "call me at (415)555-0132 ok"),
    ]
    texts = dict(rows)
    got = {r.doc_id: [(s.split(":")[0], texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in r.spans.split(",") if s] for r in
           P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("phone", "(415) 555-0132"), ("phone", "(415) 555-0199"), ("phone", "(212) 555-0100")]
    assert got[2] == [("phone", "(415) 555-0132"), ("phone", "+1 (415) 555-0199")]
    assert got[3] == [("email", "jane [at] example [dot] org"), ("email", "bob [at] example [dot] com")]
    assert got[4] == [("email", "jane(at)example.com")] and got[5] == [("phone", "(415)555-0132")]
