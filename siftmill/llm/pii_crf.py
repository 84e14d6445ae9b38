"""Personal data by patterns and a linear-chain conditional random field.

The patterns give the base spans. The field tags the words of a text as O, email, ip, card or phone from
features of their shapes and neighbours; it is trained from a small labelled table of sentences and decoded
by Viterbi in numpy batches. Every word of every text is scored by table lookups of its class. Where
no run of words around a word can win over O by their scores and moves together, the best path has O there;
texts are cut at such words, and only what lies between them is decoded. Tagged
words that no base span covers are added as spans; neighbouring items of one kind are told apart by where
an item of the kind begins.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import documents

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # possessive: a long run of digits is read once
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """From one @ to the next, so that long runs of local-part characters are read once."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _ips(text: str) -> list[tuple[int, int]]:
    """A chain of dotted numbers matches four at a time."""
    out = []
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; a pattern's failing match is dropped and not retried."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        found += [(a, 1, b) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_HAS_DIGIT = re.compile("[0-9]")


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# The labelled table: a sentence a line, personal data in braces with its kind; # stands for a digit.
LABELLED = """
call me at {phone|(###) ###-####} after lunch
phone {phone|###-###-####} or write
her number is {phone|###.###.####} at home
tel {phone|(###) ###-####}
mobile: {phone|### ### ####} , thanks
fax {phone|###-###-####} and phone {phone|(###) ###-####}
ring {phone|+# (###) ###-####} today
reach us on {phone|+## ## #### ####} any day
his desk {phone|(###)###-####} is closed
dial {phone|0###-#######} for the office
the number {phone|0## ########} was busy
telephone {phone|0###/######} in the morning
whatsapp {phone|00## ### #######} or signal
text her under {phone|(0##) #### ####} please
mobil {phone|01##-#######} oder abends
appelez {phone|0# ## ## ## ##} demain
llame al {phone|### ## ## ##} hoy
numbers: {phone|(###) ###-####} {phone|(###) ###-####}
we have {phone|###-###-####} {phone|###-###-####} as lines
{phone|(###) ###-####} is his number
write to {email|jane@example.org} now
mail {email|j.doe [at] example [dot] org} please
contact {email|info (at) example.com} for more
email {email|first.last@mail.example.net} or call {phone|(###) ###-####}
send it to {email|sales [at] example.com}
his mail is {email|bob(at)example.com} these days
ask {email|mary(at)mail.example.org} about it
address {email|kim[at]example.net} still works
reach {email|tom_##[at]host.example.com} there
{email|anna at example dot com} wrote this
answer to {email|paul AT example DOT org} soon
forward to {email|lee at mail dot example dot net} please
her box {email|ines {at} example {dot} es} is full
{email|support (at) example (dot) com} helps
escribe a {email|luis (arroba) example (punto) es} ya
mail {email|jean [at] exemple [point] fr} merci
{email|info [at] example [dot] org} {email|help [at] example [dot] org} answer both
name {email|sam @ example.com} in the list
address {email|tom (at) mail.example.org} for bills
{email|eva at example dot net} will know
mail {email|olga (at) host.example.com} or call
the host {ip|##.##.#.##} is down
server {ip|###.###.#.#} answered
address {ip|##.#.##.###} port ####
login from {ip|###.##.##.#} failed
ping {ip|##[.]##[.]#[.]##} first
node {ip|###[.]###[.]#[.]##} was blocked
block {ip|##(.)##(.)#(.)##} at once
traffic from {ip|fe80::#a##:#bff:fe##:##cd} rises
peer {ip|2001:db8::#a##} joined
route {ip|2001:db8:#:##::#} is new
card {card|#### #### #### ####} expires ##/##
visa {card|####-####-####-####} was charged
credit card number {card|################}
pay with {card|#### ###### #####} now
card {card|####.####.####.####} on file
mastercard {card|####/####/####/####} declined
charged to {card|####_####_####_####} again
his visa {card|#### - #### - #### - ####} is lost
in #### there were ### people
the price is ##.## or ###.##
version #.# of the text
version #.#.# came in ####
version #.##.#.# of the driver
chapter ## page ###
on ####-##-## at ##:##
on ##.##.#### at noon
on ##/##/#### he left
about ## percent of ### cases
item ### costs #,### euros
token = "#a##f#b###e#d#c#"
see section #.#.# and table ##
room ### on floor #
####-#### was a good time
the years #### - #### were hard
it is ## (##) and ### (###)
order ######## has ## lines
a ratio of #:## or ##-##
score ###-### at half time
numbers ### #### ## ##### follow
id ##-####### of the list
isbn ###-#-##-######-# in stock
invoice ####-###### is due
follow @ the door of the house
look at the house of the day
we met at noon and ate at home
a dot on the map is the town
put the dot at the end of the line
he looked at a dot and at a line
At at noon they sat At the end
reference ################ was booked
tracking code ################ arrived
the value ################ is large
row ############### of the table
the meeting is at # on ##.##.####
see @handle and @other### there
file a.b.c and x.y are old
from ##:## to ##:## daily
lat ##.#### lon -#.####
sums of ##.###,## and #.###.###,##
matrix ### ### ### of numbers
a #/## share (## of ###) fell
version ####.##.## is out
the time is ##:##:##
"""

#: Sentences that the field isn't trained on, to measure it.
HELD_OUT = """
please ring {phone|(###) ###-####} before noon
my cell is {phone|###-###-####} and hers {phone|###.###.####}
unser telefon {phone|0###-#######} ist neu
you can phone {phone|(###)###-####} all week
sous le {phone|0# ## ## ## ##} le soir
the lines {phone|(###) ###-####} {phone|(###) ###-####} are free
fax to {phone|0###/######} only
mobile {phone|### ### ####} works
contact {email|jane(at)example.com} today
or {email|maria [at] example [dot] net} instead
please mail {email|jane AT example DOT org} again
{email|john at example dot com} can help
she is {email|rosa (at) mail.example.es} now
use {email|desk[at]example.org} for this
the machine {ip|##[.]###[.]#[.]##} is slow
gateway {ip|2001:db8::#b##} changed
firewall drops {ip|###[.]##[.]##[.]#} today
credit {card|####.####.####.####} is old
my card {card|####/####/####/####} broke
pay by {card|####_####_####_####} please
since #### we sold ### of them
at ##:## on ##.##.#### it rained
section ##.# says ## percent
a long list of ## names and ### dates
release #.#.## is stable
order ##-#### was sent on ####-##-##
look at the dot in the picture
they met at the station at #
between #### and #### it grew by #.#
the ratio ##:## is odd
"""

_CUES = {
    "phone": "call phone number tel mobile fax ring reach telephone telefon cell dial whatsapp text mobil appelez llame lines", "email": "write mail contact email send to e-mail answer escribe ask forward",
    "ip": "host server address from ip login ping node block peer route gateway machine", "card": "card visa credit mastercard amex pay charged",
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}
CUES = ("", *KINDS)
#: How the marks of an address are spelled out, alone as a word.
LINKS = ("", "at", "dot", "[at]", "[dot]")
_LINK = {"at": 1, "dot": 2} | {f"{o}{w}{c}": k for o, c in ("[]", "()", "{}") for k, ws in ((3, "at arroba"), (4, "dot punto point")) for w in ws.split()}
#: Places whose spelled-out marks a word sees, and how far back it sees cue words.
AROUND, BACK = (-3, -2, -1, 1, 2, 3), 3
OUTSIDE = ("-", 0, 0, 0)


def _shape(word: str) -> str:
    out = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: "0" * min(len(m[0]), 7), out)[:24]


def word_class(word: str) -> tuple[str, int, int, int]:
    """(shape, digits up to 16, link, cue): all that the field sees of a word itself."""
    core = word.strip(".,;:!?\"'")
    low = core.lower()
    return _shape(core), min(sum(c in "0123456789" for c in word), 16), _LINK.get(low, 0), CUES.index(_CUE.get(low, ""))


def _features(words: list[str], i: int) -> list[str]:
    """What the field sees at a word: its class, the shapes beside it, spelled-out marks near it, the cue before it."""
    seen = lambda k: word_class(words[i + k]) if 0 <= i + k < len(words) else OUTSIDE
    (shape, digits, link, _), before, after = seen(0), seen(-1)[0], seen(1)[0]
    out = ["bias", f"s={shape}", f"d={digits}", f"k={link}", f"p={before}", f"n={after}", f"ps={before}|{shape}", f"sn={shape}|{after}"]
    out += [f"l{k}={seen(k)[2]}" for k in AROUND]
    cue = next((c for k in range(1, BACK + 1) if (c := seen(-k)[3])), 0)
    return [*out, f"cue={cue}"]


def labelled_sentences(copies: int = 6, seed: int = 3, table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Words and tags of the table's sentences, with digits drawn anew in each copy."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(copies):
        for line in table.strip().split("\n"):
            line = re.sub("#", lambda _: str(rng.integers(0, 10)), line)
            words, tags = [], []
            for kind, value, plain in re.findall(r"\{(\w+)\|((?:\{\w+\}|[^{}])+)\}|([^{]+)", line):
                for word in (plain or value).split():
                    words.append(word)
                    tags.append(TAGS.index(kind) if kind else 0)
            out.append((words, tags))
    return out


class Field:
    """Weights of a trained field: a row of tag weights a feature (row 0: unknown), and tag transitions.

    The weights are laid out as tables by word class, shape, pairs of shapes, link and cue. Words are
    looked up in a bounded cache of their classes.
    """

    KEPT = 1 << 17

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        shapes = sorted({n[2:] for n in names if n.startswith("s=")} | {n[2:] for n in names if n[:2] in ("p=", "n=")})
        self.shapes = {shape: i + 1 for i, shape in enumerate(shapes)}  # 0: a shape never seen
        of = lambda name: weights[names.get(name, 0)]
        listed = ["\0", *shapes]
        self.before, self.after = (np.array([of(f"{k}={s}") for s in listed]) for k in "pn")
        self.pair_before = np.array([[of(f"ps={a}|{b}") for b in listed] for a in listed])
        self.pair_after = np.array([[of(f"sn={a}|{b}") for b in listed] for a in listed])
        self.links = {k: np.array([of(f"l{k}={n}") for n in range(len(LINKS))]) for k in AROUND}
        self.cues = np.array([of(f"cue={c}") for c in range(len(CUES))])
        # moves against O to O, shifted by a price of each tag that any way from O back to O pays and gets back
        price = (moves[0] - moves[:, 0]) / 2
        net = moves - moves[0, 0] + price[:, None] - price[None, :]
        self.most = (net[:, 1:].max(0) + net[1:].max(1)) / 2  # half of the best move to and of that from a tag
        self.ends = float((net[0, 1:].max() + net[1:, 0].max()) / 2)
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.own, self.parts = [], []
        self._row(OUTSIDE)

    def _row(self, kind: tuple) -> int:
        if kind not in self.rows:
            shape, digits, link, cue = kind
            self.rows[kind] = len(self.own)
            self.own.append(sum(self.weights[self.names.get(f, 0)] for f in ("bias", f"s={shape}", f"d={digits}", f"k={link}")))
            self.parts.append((self.shapes.get(shape, 0), link, cue))
        return self.rows[kind]

    def _word(self, word: str) -> int:
        if len(self.known) >= self.KEPT:
            self.known.clear()
        row = self.known[word] = self._row(word_class(word))
        return row

    def emitted(self, texts: list[list[str]]) -> tuple[np.ndarray, list[int]]:
        """Tag scores of all words of the texts, one text after the other with BACK rows between, and their starts."""
        if len(self.rows) > self.KEPT:
            self._reset()
        get, word, gap = self.known.get, self._word, [0] * BACK
        rows, starts = list(gap), []
        for words in texts:
            starts.append(len(rows))
            rows += [r if (r := get(w)) is not None else word(w) for w in words]
            rows += gap
        at = np.array(rows)
        parts = np.array(self.parts)[at]
        shape, link, cue = parts.T
        back = lambda x, k: np.concatenate((np.zeros(k, x.dtype), x[:-k]))
        ahead = lambda x, k: np.concatenate((x[k:], np.zeros(k, x.dtype)))
        outside = self.shapes.get(OUTSIDE[0], 0)
        previous, following = back(shape, 1), ahead(shape, 1)
        previous[0] = following[-1] = outside
        out = np.array(self.own)[at] + self.before[previous] + self.after[following] + self.pair_before[previous, shape] + self.pair_after[shape, following]
        for k, table in self.links.items():
            out += table[back(link, -k) if k < 0 else ahead(link, k)]
        nearest = back(cue, BACK)
        for k in range(BACK - 1, 0, -1):
            near = back(cue, k)
            nearest = np.where(near > 0, near, nearest)
        return out + self.cues[nearest], starts

    def emissions(self, segments: list[list[str]]) -> np.ndarray:
        """(segment, place, tag), zeros past a segment's end."""
        scores, starts = self.emitted(segments)
        return _padded([scores[a : a + len(words)] for a, words in zip(starts, segments)])

    def decode(self, segments: list[list[str]]) -> list[list[int]]:
        """The best tags of each segment between words held at O."""
        return self.best(self.emissions(segments), np.array([len(s) for s in segments]))

    def best(self, emitted: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Viterbi over all segments in step."""
        best = self.moves[0][None, :] + emitted[:, 0]
        back = []
        for t in range(1, emitted.shape[1]):
            arrive = best[:, :, None] + self.moves[None]
            came = arrive.argmax(1)
            now = arrive.max(1) + emitted[:, t]
            live = (t < lengths)[:, None]
            best = np.where(live, now, best)
            back.append(np.where(live, came, np.arange(len(TAGS))[None]))
        tag = (best + self.moves[:, 0][None]).argmax(1)
        out = [tag]
        for came in reversed(back):
            tag = came[np.arange(len(tag)), tag]
            out.append(tag)
        table = np.stack(out[::-1], 1)
        return [table[s, :n].tolist() for s, n in enumerate(lengths.tolist())]

    def tagged(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        """(place, tag) of each text's words that aren't O on its best path.

        A run of words with other tags wins over O by no more than the sum of each word's best lead and the
        moves at its ends. So a word is O for certain where every run of words around it sums below zero,
        which running sums tell. Such words cut the texts; runs of others are decoded some at a time, those
        of like length together.
        """
        scores, starts = self.emitted(texts)
        lead = (scores[:, 1:] + self.most).max(1) - scores[:, 0]
        inside = np.zeros(len(scores) + 1, np.int8)
        for a, words in zip(starts, texts):
            own = lead[a : a + len(words)]
            if (own > 0).any():
                total = np.cumsum(own)
                least = np.minimum.accumulate(np.concatenate(([0.0], total[:-1])))
                most = np.maximum.accumulate(total[::-1])[::-1]
                inside[a : a + len(words)] = most - least + self.ends >= -1e-6
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside))))
        runs = sorted(zip(edges[::2].tolist(), edges[1::2].tolist()), key=lambda r: r[1] - r[0])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for i in range(0, len(runs), 512):
            some = runs[i : i + 512]
            for (a, _), tags in zip(some, self.best(_padded([scores[a:b] for a, b in some]), np.array([b - a for a, b in some]))):
                text = bisect_right(starts, a) - 1
                out[text] += [(a + k - starts[text], tag) for k, tag in enumerate(tags) if tag]
        return [sorted(found) for found in out]


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), max(map(len, parts), default=0), len(TAGS)))
    for i, part in enumerate(parts):
        out[i, : len(part)] = part
    return out


def train(sentences: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.8, l2: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward over all sentences in step; driver-side, as the table is small."""
    names: dict[str, int] = {}
    for words, _ in sentences:
        for i in range(len(words)):
            for f in _features(words, i):
                names.setdefault(f, len(names) + 1)
    k, n, longest = len(TAGS), len(sentences), max(len(w) for w, _ in sentences)
    width = max(len(_features(w, i)) for w, _ in sentences for i in range(len(w)))
    rows = np.zeros((n, longest, width), np.int64)
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for s, (words, tags) in enumerate(sentences):
        for i, tag in enumerate(tags):
            own = [names[f] for f in _features(words, i)]
            rows[s, i, : len(own)] = own
            gold[s, i], live[s, i] = tag, True
    weights, moves = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    lengths = live.sum(1)
    speed_w, speed_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(rounds):
        emitted = weights[rows].sum(2)
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = moves[0] + emitted[:, 0]
        for t in range(1, longest):
            step = logsum(ahead[:, t - 1, :, None] + moves[None], 1) + emitted[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        behind = np.zeros((n, longest, k))
        behind[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            step = logsum(moves[None] + (emitted[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], step, moves[:, 0])
        total = logsum(ahead[:, -1] + moves[:, 0], 1)
        share = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        error = np.eye(k)[gold] * live[..., None] - share
        slope = np.zeros_like(weights)
        for f in range(width):
            np.add.at(slope, rows[:, :, f].ravel(), error.reshape(-1, k))
        slope[0] = 0
        turn = np.zeros_like(moves)
        for t in range(1, longest):
            pair = ahead[:, t - 1, :, None] + moves[None] + (emitted[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            turn -= (np.exp(pair) * live[:, t, None, None]).sum(0)
            np.add.at(turn, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
        turn[0] += error[:, 0].sum(0)
        last = lengths - 1
        turn[:, 0] += error[np.arange(n), last].sum(0)
        slope, turn = slope / n - l2 * weights, turn / n - l2 * moves
        speed_w, speed_m = speed_w + slope**2, speed_m + turn**2
        weights = weights + rate * slope / np.sqrt(speed_w)
        moves = moves + rate * turn / np.sqrt(speed_m)
    return Field(names, weights, moves)


def _begins(kind: int, words: list[str], item: list[str]) -> bool:
    """Whether the last of ``words`` begins an item of its own after the words of ``item``."""
    word = words[-1].strip(".,;:!?\"'")
    digits = lambda w: sum(c in "0123456789" for c in w)
    had, own = sum(map(digits, item)), digits(word)
    if kind == 0:
        linked = lambda w: _LINK.get(w.strip(".,;:!?\"'").lower(), 0) or w in ("@", ".")
        return not linked(word) and not linked(item[-1])
    if kind == 1:
        return True
    if kind == 2:
        return had >= 14 and had + own > 16
    return had >= 7 and (word[:1] in "+(" or had + own > 13)


def items(words: list[str], found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, kind, end) in words of the tagged items of a text, of sorted (place, tag)."""
    out: list[list[int]] = []
    for place, tag in found:
        last = out[-1] if out else None
        if last and last[2] == place and last[1] == tag - 1 and not _begins(tag - 1, words[: place + 1], words[last[0] : place]):
            last[2] = place + 1
        else:
            out.append([place, tag - 1, place + 1])
    return [tuple(item) for item in out]


def _added(text: str, words: list[str], found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the tagged items outside the base spans, without marks around them.

    What a base span covers is cut off an item; what is left is a span of its own if it has a letter or a
    digit and, as any item must, a digit or a spelled-out mark.
    """
    places = [m.span() for m in _WORD.finditer(text)]
    covered = sorted((a, b) for a, _, b in base)
    out = []
    for first, kind, end in items(words, found):
        a, stop = places[first][0], places[end - 1][1]
        parts = []
        for low, high in covered:
            if high > a and low < stop:
                parts.append((a, min(low, stop)))
                a = max(a, high)
        parts.append((a, stop))
        for a, b in parts:
            while b > a and text[b - 1] in " \t\n\v\f\r.,;:!?\"'":
                b -= 1
            while a < b and text[a] in " \t\n\v\f\r.,;:!?\"'":
                a += 1
            own = text[a:b].split()
            if own and (_HAS_DIGIT.search(text, a, b) or "@" in text[a:b] or any(_LINK.get(w.lower()) for w in own) or _SPELLED.search(text, a, b)):
                out.append((a, kind, b))
    return out


_SPELLED = re.compile(r"[\[({](?:at|dot)[\])}]", re.I)


def measured(field: Field, sentences: list[tuple[list[str], list[int]]]) -> tuple[float, float]:
    """Precision and recall of whole items on labelled sentences."""
    found = right = true = 0
    for words, tags in sentences:
        got = set(items(words, field.tagged([words])[0]))
        want = set(items(words, [(i, t) for i, t in enumerate(tags) if t]))
        found, right, true = found + len(got), right + len(got & want), true + len(want)
    return right / max(found, 1), right / max(true, 1)


def _parts(words: list[list[str]], most: int = 200_000) -> Iterator[list[list[str]]]:
    """Texts of ``most`` words together, or one text of more: what is scored at once."""
    part, size = [], 0
    for own in words:
        if part and size + len(own) > most:
            yield part
            part, size = [], 0
        part.append(own)
        size += len(own)
    if part:
        yield part


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; no shuffle.

    The counts and the digest are of the base spans, ``spans`` is of all; offsets are code points of the
    whole text, ends exclusive. NULL and empty texts have no spans. Repeated rows are alike; NULL
    identifiers stay; an empty table gives an empty result; other columns are not read.
    """
    field = field or train(labelled_sentences())
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            texts = [text or "" for text in batch["text"]]
            words = [_WORD.findall(text) for text in texts]
            tagged = [t for part in _parts(words) for t in field.tagged(part)]
            for text, own, found in zip(texts, words, tagged):
                base = base_spans(text)
                more = _added(text, own, found, base) if found else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + more)), len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]).assign(id=batch["id"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInPandas(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("id", id_col)


def op3_pii_crf(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir, "doc_id", "text"))
