"""Licenses against a scan that aligns and compresses every block of a text with every template."""

import random

from siftmill.llm import license_zstd as L


def every_block(scanner, text):
    """Each template aligned at each word, without any lookup of runs, then the same choice."""
    words = text.split()
    wording = [L.plain(w) for w in words]
    found = set()
    for number, (_, own, _, most, _, _) in enumerate(scanner.templates):
        for guess in range(-len(own), len(words) + 1):
            hit = scanner.confirmed(wording, words, number, guess)
            if hit:
                found.add((number, hit[1], hit[3], hit[4], -hit[0], hit[2]))
    return [(name, different, " ".join(words[a:b])) for a, b, name, different in L.chosen(found)]


def edited(rng, words, fixed, edits):
    words = list(words)
    free = [i for i, f in enumerate(fixed) if not f]
    for i in sorted(rng.sample(free, min(edits, len(free))), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            del words[i]
        elif kind == 1:
            words[i] = "otherwise"
        else:
            words.insert(i, "extra")
    return words


def test_against_every_block():
    """Short templates with none to three edits, whole, cut at either end, and among other words."""
    short = {n: [t for t in ts if len(t.split()) <= 25] for n, ts in L.TEMPLATES.items()}
    scanner = L.Scanner({n: ts for n, ts in short.items() if ts})
    rng, hits = random.Random(11), 0
    filler = "the work of this is under version and license released for code we made in permission notice software use".split()
    for _ in range(150):
        _, own, fixed, _, _, _ = rng.choice(scanner.templates)
        line = edited(rng, own, fixed, rng.randrange(4))
        line = line[rng.randrange(3) if rng.random() < 0.3 else 0 : len(line) - (rng.randrange(3) if rng.random() < 0.3 else 0)]
        text = " ".join(rng.choices(filler, k=rng.randrange(6)) + line + rng.choices(filler, k=rng.randrange(6)))
        got = [(name, different) for name, a, b, different in scanner.scan(text)[1]]
        assert got == [block[:2] for block in every_block(scanner, text)], text
        hits += bool(got)
    assert hits > 60


def test_whole_texts():
    """The full texts are told apart, with a tenth of their words changed and broken into lines."""
    scanner, rng = L.Scanner(L.TEMPLATES), random.Random(12)
    for name, own, fixed, most, _, _ in scanner.templates:
        if len(own) < 60:
            continue
        words = edited(rng, own, fixed, most // 2)
        text = "Ours.\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n\nAnd more."
        found = scanner.scan(text)[1]
        assert [f[0] for f in found] == [name] and found[0][2] - found[0][1] > 0.8 * len(" ".join(words)), (name, found)
