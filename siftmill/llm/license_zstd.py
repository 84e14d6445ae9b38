"""License scans by conditional compression.

A block that differs from a template of n words in at most d of them has a run of (n - d) // (d + 1) of its
words unchanged, wherever the differences lie. So each template's runs of that many words are looked up at
every word of a text, and the words that align best with the template around a run that is there are a
candidate: nothing that could be confirmed is passed over, and no list of cue words is needed. A candidate
has few words added, missing or changed, and none with a digit or a license's name; at the text's ends the
block is what is there. A template is a raw zstandard dictionary: what it saves on a block's compressed
size says how much of the block's wording it has. The candidate with the largest saving wins; the alignment
alone decides what is a candidate, as a few words are too short for compression to tell.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.storage import documents

# The texts and customary wordings of public licenses.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{}"""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "Apache-2.0": [
        _APACHE,
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        _MIT,
        "Released under the MIT License.", "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "GPL-2.0": [
        _GPL.format("2"),
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        _GPL.format("3"),
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": [
        _BSD.format(_BSD_THIRD) + " " + _BSD_END,
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-2-Clause": [_BSD.format("") + " " + _BSD_END],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "ISC": [_ISC, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
}

#: Largest share of a template's words that may differ (one word may in any template).
MAX_DIFFERENT = 0.1

#: Words that tell licenses apart: another one of these is another license, not a difference in wording.
NAMES = frozenset(
    "apache mit gnu general public lesser library affero mozilla bsd cc by-sa by-nc by-nd by-nc-sa by-nc-nd creative commons attribution-noncommercial".split()
)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(word: str) -> str:
    """A word's wording: lower case, without the marks around it."""
    return word.lower().strip("().,;:!?\"'")


@lru_cache(maxsize=1 << 14)
def misspelt(own: str, word: str) -> bool:
    """Whether a word is a license's name with a slip, not another name."""
    return word not in NAMES and abs(len(own) - len(word)) <= 2 and difflib.SequenceMatcher(None, own, word).ratio() >= 0.8


def chosen(found: Iterable[tuple[int, int, int, int, int, str]]) -> list[tuple[int, int, str, int]]:
    """(start, end, license, differences), not overlapping, of (template, differences, start, end, -saving, license).

    Of a template's blocks that overlap the one with the fewest differences stands, the first of equals; of
    the templates' blocks the one with the largest saving, so the fullest wording of a place wins.
    """

    def apart(blocks: list[tuple]) -> list[tuple]:
        kept, starts, ends = [], [], []
        for block in blocks:
            a, b = block[2:4]
            i = bisect_left(starts, b)
            if not i or ends[i - 1] <= a:
                kept.append(block)
                starts.insert(i, a)
                ends.insert(i, b)
        return kept

    own = [block for _, blocks in groupby(sorted(found), key=itemgetter(0)) for block in apart(list(blocks))]
    best = apart(sorted(own, key=lambda block: (block[4], block[1], block[5], block[2])))
    return sorted((a, b, name, different) for _, different, a, b, _, name in best)


class Scanner:
    """Templates with their compressors and the runs of words that lead to them; one a worker."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates = []
        self.bare = zstandard.ZstdCompressor(level=3, write_content_size=False)
        #: the first word of a run to (words of the run, template, place of the run in it)
        self.runs: dict[str, dict[int, dict[tuple[str, ...], list[tuple[int, int]]]]] = {}
        for name in sorted(templates):
            for text in templates[name]:
                words = text.split()
                dictionary = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(level=3)
                packer = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False)
                own = [plain(w) for w in words]
                most = max(1, int(MAX_DIFFERENT * len(own)))
                fixed = [any(map(str.isdigit, w)) or w in NAMES or (w == "by" and "cc" in own) for w in own]
                size = max(1, (len(own) - most) // (most + 1))
                for at in range(len(own) - size + 1):
                    run = tuple(own[at : at + size])
                    self.runs.setdefault(run[0], {}).setdefault(size, {}).setdefault(run, []).append((len(self.templates), at))
                self.templates.append((name, own, fixed, most, size, packer))

    @staticmethod
    def align(own: list[str], fixed: list[bool], most: int, block: list[str]) -> tuple[int, int, int] | None:
        """(differences, start, end) of the part of ``block`` nearest to a template's words; None beyond ``most``.

        A difference is a word added, missing or changed; words of the block before and after the part are
        free. Neither side of a difference may hold a digit or a license's name, misspellings of a name aside.
        Of equally near parts the one nearest to the template's length, then the first, is taken.
        """
        far, unit = most + 1, len(block) + 1  # a cell is cost * unit + start, so the least cell has the first start
        plain_word = np.array([w not in NAMES and not any(map(str.isdigit, w)) for w in block], bool)
        added = np.where(plain_word, 1, far) * unit
        before = np.concatenate(([0], np.cumsum(added)))
        row = np.arange(len(block) + 1)
        places: dict[str, list[int]] = {}
        for j, other in enumerate(block):
            places.setdefault(other, []).append(j)
        for word, kept in zip(own, fixed):
            change = np.full(len(block), far * unit) if kept else added.copy()
            if kept and word in NAMES:
                change[[j for j in np.flatnonzero(plain_word) if misspelt(word, block[j])]] = unit
            change[places.get(word, [])] = 0
            new = row + (far if kept else 1) * unit
            np.minimum(new[1:], row[:-1] + change, out=new[1:])
            row = np.minimum.accumulate(new - before) + before  # words added one after the other
            if row.min() // unit > most:
                return None
        cost, _, start, end = min((cell // unit, abs(end - cell % unit - len(own)), cell % unit, end) for end, cell in enumerate(row.tolist()))
        return (cost, start, end) if cost <= most else None

    def confirmed(self, wording: list[str], words: list[str], number: int, guess: int) -> tuple | None:
        """(saving, differences, license, start, end) of the block near the place where a template would start."""
        name, own, fixed, most, _, packer = self.templates[number]
        start = guess
        for _ in range(2):  # the second time around what was found, so that a block hardly depends on the guess
            low = max(0, start - most)
            near = wording[low : max(0, start + len(own) + most)]
            hit = self.align(own, fixed, most, near) if len(near) + most >= len(own) else None
            if hit is None:
                return None
            different, guess, start, end = hit[0], start, low + hit[1], low + hit[2]
            if start == guess:
                break
        block = " ".join(words[start:end]).lower().encode()
        return len(self.bare.compress(block)) - len(packer.compress(block)), different, name, start, end

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, int]]]:
        """Number of candidates, and (license, start, end, differences) in code points, not overlapping."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        wording = [plain(w) for w in words]
        guesses: dict[tuple[int, int], None] = {}
        runs = self.runs
        for i, word in enumerate(wording):
            if word in runs:
                for size, known in runs[word].items():
                    for number, at in known.get(tuple(wording[i : i + size]), ()):
                        guesses[number, i - at] = None
        found, done, last = {}, {}, (-1, 0)
        for number, guess in sorted(guesses):
            # the best block around the last one's start is found already
            if last[0] == number and abs(guess - last[1]) <= self.templates[number][3]:
                continue
            # equal surroundings give equal blocks: a line repeated a thousand times is aligned once
            own = self.templates[number]
            low = max(0, guess - own[3])
            key = (number, guess - low, tuple(words[low : max(0, guess + len(own[1]) + own[3])]))
            if key not in done:
                hit = self.confirmed(wording, words, number, guess)
                done[key] = hit and (*hit[:3], hit[3] - low, hit[4] - low)
            if done[key]:
                saving, different, name, start, end = done[key]
                last = number, low + start
                found[number, different, low + start, low + end, -saving, name] = None
        return len(guesses), [(name, spans[a][0], spans[b - 1][1], different) for a, b, name, different in chosen(found)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, n_candidates, n_found, licenses, found) of every row; no shuffle.

    ``licenses`` has the different licenses, sorted; ``found`` has license:start:end:differences in text
    order, in code points of the whole text; both are comma-joined and empty where there is none, as for
    NULL and empty texts. Repeated rows are alike; NULL identifiers stay; an empty table gives an empty
    result; other columns are not read.
    """
    wordings = templates or TEMPLATES
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(wordings)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                candidates, found = scanner.scan(text or "")
                rows.append((candidates, len(found), ",".join(sorted({f[0] for f in found})), ",".join(":".join(map(str, f)) for f in found)))
            yield pd.DataFrame(rows, columns=["n_candidates", "n_found", "licenses", "found"]).assign(id=batch["id"])

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInPandas(run, f"id {kind}, n_candidates long, n_found long, licenses string, found string").withColumnRenamed("id", id_col)


def op8_license_zstd(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
