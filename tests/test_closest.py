"""Closest lines against Python's own matching blocks."""

import random
import time
from difflib import SequenceMatcher

from siftmill.operators import closest


def blocks(line, quote):
    return sum(b.size for b in SequenceMatcher(None, line, quote, autojunk=False).get_matching_blocks())


def test_matching_blocks():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        assert closest.held(closest._codes(a), closest._codes(b)) == blocks(a, b), (a, b)


def test_closest_lines(spark):
    rng, pairs, want = random.Random(2), [], {}
    for i in range(30):
        words = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 7))) for _ in range(n))
        lines = [rng.choice(["", "   ", words(rng.randrange(1, 14)) + "  x"]) for _ in range(rng.randrange(0, 25))]
        quote = list(rng.choice(lines) if lines and rng.random() < 0.8 else words(5))
        for _ in range(3):  # edited
            if quote:
                quote[rng.randrange(len(quote))] = rng.choice(["", "q", " "])
        quote = "".join(quote)
        pairs.append((i, None if i % 2 else "k", quote, "\n".join(lines)))
        asked, best = " ".join(quote.split()), None
        for n, line in enumerate(lines, 1):
            line = " ".join(line.split())
            if asked and line and (best is None or blocks(line, asked) > best[0]):
                best = (blocks(line, asked), n, line)
        if best:
            want[i] = (best[1], best[2], round(best[0] / len(asked), 9))
    df = spark.createDataFrame([*pairs, (98, "k", None, "x"), (99, "k", "x", None)], "i int, k string, quote string, body string")
    got = {r.i: (r.line, r.text, round(r.score, 9)) for r in closest.closest_lines(df, ["i", "k"], "quote", "body").collect()}
    assert got == want and len(want) > 10


def test_long_lines():
    """A line of 200,000 characters: no step of an interpreter for each of them and each part of the quote."""
    rng = random.Random(3)
    line = "".join(rng.choice("etaoin shrdlu") for _ in range(200_000))
    quote = line[150_000:150_100] + "#" + line[150_101:150_300]
    start = time.process_time()
    assert closest.held(closest._codes(line), closest._codes(quote)) == 299
    assert time.process_time() - start < 2
