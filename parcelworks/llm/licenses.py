"""License scans with a positional rare-token index over license templates.

The index holds the postings (template, position) of every template's rarest words, more than any occurrence can
lack, and of each base phrase's rarest word.  Rarity is the inverse document frequency over the whole corpus, counted for
the templates' words only, so the table of frequencies is as small as the templates.  A posting's relative position (place
in the document less place in the template) is a candidate place.  An occurrence counts if enough of the template's words
stand at their places and the template's mandatory key phrases stand nearby; no other word or notice of the document matters.
A long template that isn't found so may have been altered: relative positions that drift by a few words are taken together, and the
words that stand in the template's order in the stretch are weighed, whatever was put in or left out between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, small_batches, tidy

#: The contract's base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice: its label, its text, and phrases of which each must stand in the matched stretch."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Texts of public licences: bodies, the notices that they ask for, and their titles (fixed values).
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
_APACHE_GRANT = """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby
grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce,
prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative
Works in Source or Object form. Grant of Patent License. Subject to the terms and conditions of this License, each
Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as
stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the
Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed
by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was
submitted."""
_GNU_NOTICE = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later
version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have
received a copy of the GNU {name} along with this {what}."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the
benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in
whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work."""


def _gnu(name: str, version: str, what: str = "program", old: bool = False) -> str:
    return _GNU_NOTICE.format(name=name, version=version, what=what, colon=";" if old else ":", comma=";" if old else ",")


def _creative_commons(label: str, title: str, short: str) -> tuple[Template, ...]:
    """The sentence that the licence's own deed offers, and its short name."""
    sentence = f"This work is licensed under a Creative Commons {title} 4.0 International License."
    return Template(label, sentence, (f"creative commons {title.lower().replace('-', ' ')} 4 0",)), Template(label, f"{short} 4.0", (f"{short.lower().replace('-', ' ')} 4 0",))


def _identifiers() -> tuple[Template, ...]:
    """The tag that source files carry in place of a notice, and some licences' short names."""
    ids = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Unlicense Zlib BSL-1.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
    phrase = lambda text: text.lower().replace("-", " ").replace(".", " ").replace(":", "")
    tags = [Template(i.lower(), f"SPDX-License-Identifier: {i}", (phrase(f"SPDX-License-Identifier: {i}"),)) for i in ids]
    names = [("gpl-2.0", "GPLv2"), ("gpl-3.0", "GPLv3"), ("lgpl-2.1", "LGPLv2.1"), ("lgpl-3.0", "LGPLv3"), ("agpl-3.0", "AGPLv3"), ("apache-2.0", "Apache-2.0"), ("mpl-2.0", "MPL-2.0")]
    return *tags, *(Template(label, name, (phrase(name),)) for label, name in names)


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = (
    Template("mit", _MIT, ("permission is hereby granted free of charge to any person obtaining a copy of this software", "without restriction")),
    Template("mit", "The MIT License (MIT)", ("mit license",)),
    Template("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("bsd-3-clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    Template("isc", _ISC, ("with or without fee is hereby granted",)),
    Template("apache-2.0", _APACHE_NOTICE, ("apache license version 2 0",)),
    Template("apache-2.0", _APACHE_GRANT, ("grant of copyright license", "grant of patent license")),
    Template("apache-2.0", "Apache License Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0", _gnu(_GPL, "3"), ("gnu general public license", "version 3 of the license")),
    Template("gpl-3.0", "GNU General Public License version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", _gnu(_GPL, "2", old=True), ("gnu general public license", "version 2 of the license")),
    Template("gpl-2.0", "GNU General Public License version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3.0", _gnu(_LGPL, "3", "library"), ("gnu lesser general public license", "version 3 of the license")),
    Template("lgpl-2.1", _gnu(_LGPL, "2.1", "library", old=True), ("gnu lesser general public license", "version 2 1 of the license")),
    Template("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl-3.0", _gnu(_AGPL, "3"), ("gnu affero general public license", "version 3 of the license")),
    Template("agpl", "GNU Affero General Public License", ("gnu affero general public license",)),
    Template("mpl-2.0", _MPL, ("mozilla public license v 2 0",)),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software released into the public domain",)),
    Template("zlib", _ZLIB, ("the origin of this software must not be misrepresented",)),
    Template("bsl-1.0", _BOOST, ("to any person or organization obtaining a copy of the software",)),
    Template("epl-2.0", _EPL, ("eclipse public license 2 0",)),
    Template("cc0-1.0", _CC0, ("waived all copyright and related or neighboring rights",)),
    *_creative_commons("cc-by-4.0", "Attribution", "CC BY"),
    *_creative_commons("cc-by-sa-4.0", "Attribution-ShareAlike", "CC BY-SA"),
    *_creative_commons("cc-by-nc-4.0", "Attribution-NonCommercial", "CC BY-NC"),
    *_creative_commons("cc-by-nd-4.0", "Attribution-NoDerivatives", "CC BY-ND"),
    *_creative_commons("cc-by-nc-sa-4.0", "Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    *_creative_commons("cc-by-nc-nd-4.0", "Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
    *_identifiers(),
)

#: Share of a template's words (weighted by rarity) that must stand in place, words of play.
COVERAGE = 0.6
SLACK = 2
#: Weight that looked-up words have beyond what an occurrence may lack: a start must get so much of them.
VOTES = 0.15
#: A template of so many words or more may also stand in pieces: words put in or left out move what follows, by so many places in all.
LONG, DRIFT = 15, 48


def template_words(templates=TEMPLATES) -> list[bytes]:
    """All words of the templates and of their key phrases, in order."""
    return sorted({w for t in templates for part in (t.text, *t.keys) for w in alnum_words(part)})


def word_frequencies(docs: DataFrame, templates=TEMPLATES) -> tuple[int, dict[bytes, int]]:
    """How many documents there are and how many contain each word of the templates, over all of docs."""
    small_batches(docs.sparkSession)
    vocab = template_words(templates)
    number = {w: i for i, w in enumerate(vocab)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[-1] += 1
                for w in number.keys() & set(alnum_words(text)):
                    n[number[w]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["word", "n"])

    sums = docs.select(F.col("text").cast("string")).mapInArrow(counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in sums.collect()}  # one row a template word
    return found.get(len(vocab), 0), {w: found.get(i, 0) for w, i in number.items()}


def _places(words: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
    """Where the phrase's words stand consecutively, starting in [low, high)."""
    found, n, at = [], len(phrase), low
    high = len(words) if high is None else high
    while True:
        try:
            at = words.index(phrase[0], at, high)
        except ValueError:
            return found
        if words[at : at + n] == phrase:
            found.append(at)
        at += 1


class Scanner:
    """The templates' positional index with the words' rarities; scan() works on one document."""

    def __init__(self, n_docs: int, frequencies: dict[bytes, int], templates=TEMPLATES, coverage: float = COVERAGE, slack: int = SLACK):
        self.idf = {w: math.log((n_docs + 1) / (f + 1)) + 1e-6 for w, f in frequencies.items()}
        self.coverage, self.slack = coverage, slack
        self.templates = [(t.label, alnum_words(t.text), [alnum_words(k) for k in t.keys]) for t in templates]
        self.whole = [sum(self.idf[w] for w in words) for _, words, _ in self.templates]
        self.rare = [self._rare(words) if len(words) >= LONG else set() for _, words, _ in self.templates]
        self.needed = [frozenset(w for key in keys for w in key) for _, _, keys in self.templates]
        self.base = [(alnum_words(p), label) for p, label in BASE.items()]
        #: word -> (template, position) of the templates' looked-up words; (-1 - phrase, position) of the base phrases' rarest
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        #: weight of looked-up words that a template's start must have in place
        self.votes = []
        for t, (_, words, _) in enumerate(self.templates):
            rare = self._rare(words)
            self.votes.append(sum(self.idf[w] for w in words if w in rare) - (1 - coverage) * self.whole[t] - 1e-9)
            for i, w in enumerate(words):
                if w in rare:
                    self.postings.setdefault(w, []).append((t, i))
        for p, (words, _) in enumerate(self.base):
            i = self._rarest(words)
            self.postings.setdefault(words[i], []).append((-1 - p, i))
        self.vocab = frozenset(self.postings).union(*self.needed)
        #: a text without any of these strings has no template's key phrase and no base phrase
        self.anchors = tuple({words[self._rarest(words)] for words in [*(keys[0] for _, _, keys in self.templates), *(p for p, _ in self.base)]})

    def _rarest(self, words: list[bytes]) -> int:
        return max(range(len(words)), key=lambda i: (self.idf.get(words[i], 0.0), words[i]))

    def _rare(self, words: list[bytes]) -> set[bytes]:
        """The template's rarest words that together weigh more, by VOTES, than an occurrence may lack."""
        whole = sum(self.idf[w] for w in words)
        rare, left = set(), (1 - self.coverage + VOTES) * whole
        for w in sorted(set(words), key=lambda w: (-self.idf[w], w)):
            if left < -1e-9:
                break
            rare.add(w)
            left -= self.idf[w] * words.count(w)
        return rare

    def looked_up(self, words: list[bytes]) -> tuple[set[tuple[int, int]], list[set[int]]]:
        """Candidate (template, start), and the places of each base phrase.

        A template is looked up if all words of its key phrases are there.  A start is a candidate if the looked-up words
        that stand within the slack of their places from it weigh as much as those of any occurrence.
        """
        present = self.vocab.intersection(words)
        possible = {t for t, needed in enumerate(self.needed) if needed <= present}
        possible |= {-1 - p for p, (phrase, _) in enumerate(self.base) if present.issuperset(self.vocab.intersection(phrase))}
        wanted = {w: own for w in present if (own := [x for x in self.postings.get(w, ()) if x[0] in possible])}
        base: list[set[int]] = [set() for _ in self.base]
        found: dict[tuple[int, int], set[int]] = {}
        if wanted:
            reach = range(-self.slack, self.slack + 1)
            for at, w in enumerate(words):
                for t, i in wanted.get(w, ()):
                    if t >= 0:
                        for d in reach:
                            found.setdefault((t, at - i + d), set()).add(i)
                    elif at >= i and words[at - i : at - i + len(self.base[-1 - t][0])] == self.base[-1 - t][0]:
                        base[-1 - t].add(at - i)
        weigh = lambda t, own: sum(self.idf[self.templates[t][1][i]] for i in own)
        return {(t, start) for (t, start), own in found.items() if weigh(t, own) >= self.votes[t]}, base

    def occurrences(self, words: list[bytes], candidates: set[tuple[int, int]]):
        """Verified template occurrences among the candidates: (label, first place, coverage weighted by rarity)."""
        found, slack = [], self.slack
        for t, start in candidates:
            label, own, keys = self.templates[t]
            low, high = max(0, start - slack), min(len(words), start + len(own) + slack)
            near = set(words[low:high])
            if not self.needed[t] <= near:
                continue
            stand = sum(self.idf[w] for i, w in enumerate(own) if w in near and w in words[max(0, start + i - slack) : max(0, start + i + slack + 1)])
            if stand >= self.coverage * self.whole[t] and all(_places(words, key, low, high) for key in keys):
                found.append((label, max(0, start), min(1.0, stand / self.whole[t])))
        return found

    def altered(self, words: list[bytes], known: set[str], candidates: set[tuple[int, int]] = frozenset()):
        """Long templates that stand in pieces: (label, first place, coverage weighted by rarity).

        known: labels already found.  Of matches that share over half of the shorter stretch the one with most weight counts, so a
        licence that holds another one's text isn't taken for both; long templates found at one of the candidates come first.
        """
        present = self.vocab.intersection(words)
        open_ = [t for t, (label, own, _) in enumerate(self.templates) if len(own) >= LONG and label not in known and self.needed[t] <= present]
        if not open_:
            return []
        wanted = set().union(*(self.rare[t] for t in open_)) & present
        at: dict[bytes, list[int]] = {}
        for j, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(j)
        found = []
        for t in open_:
            label, own, keys = self.templates[t]
            offsets = sorted((j - i, i) for i, w in enumerate(own) if w in self.rare[t] for j in at.get(w, ()))
            for low, high in self._together(t, offsets):
                low, high = max(0, low - self.slack), min(len(words), high + len(own) + self.slack)
                if not all(_places(words, key, low, high) for key in keys):
                    continue
                stand = self._in_order(own, words[low:high])
                if stand >= self.coverage * self.whole[t]:
                    found.append((stand, low, high, label, min(1.0, stand / self.whole[t])))
        whole = {(t, start) for t, start in candidates if found and len(self.templates[t][1]) >= LONG and self.occurrences(words, {(t, start)})}
        kept = [(start, start + len(self.templates[t][1]), self.templates[t][0]) for t, start in whole]
        out = []
        for _, low, high, label, share in sorted(found, key=lambda f: (-f[0], f[1:4])):
            inside = lambda a, b: 2 * (min(high, b) - max(low, a)) > min(high - low, b - a)
            if not any(other != label and inside(a, b) for a, b, other in kept):
                kept.append((low, high, label))
                out.append((label, low, share))
        return out

    def _together(self, t: int, offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of relative positions within DRIFT whose words weigh as much as any occurrence's; ranges that overlap are one."""
        own, count, weight, first, ranges = self.templates[t][1], {}, 0.0, 0, []
        for o, i in offsets:
            count[i] = count.get(i, 0) + 1
            weight += self.idf[own[i]] if count[i] == 1 else 0.0
            while offsets[first][0] < o - DRIFT:
                k = offsets[first][1]
                count[k] -= 1
                weight -= self.idf[own[k]] if not count[k] else 0.0
                first += 1
            if weight >= self.votes[t]:
                low = offsets[first][0]
                if ranges and low <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], o)
                else:
                    ranges.append((low, o))
        return ranges

    def _in_order(self, own: list[bytes], words: list[bytes]) -> float:
        """Most weight of template words that stand in the words in the template's order."""
        number = {w: k for k, w in enumerate(dict.fromkeys(own))}
        text = np.array([number.get(w, -1) for w in words])
        best = np.zeros(len(words) + 1)
        for w in own:
            with_it = np.maximum(best[1:], np.where(text == number[w], best[:-1] + self.idf[w], 0.0))
            best = np.r_[0.0, np.maximum.accumulate(with_it)]
        return float(best[-1])

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = alnum_words(text)
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        if not any(anchor in raw for anchor in self.anchors):
            return len(words), 0, None, None, "", "", 0.0
        candidates, own = self.looked_up(words)
        places = [at for held in own for at in held]
        base = {label for (_, label), held in zip(self.base, own) if held}
        more = self.occurrences(words, candidates)
        more += self.altered(words, {label for label, _, _ in more}, candidates)
        labels = base | {label for label, _, _ in more}
        # a base phrase without a template around it is weaker evidence than a whole notice
        score = max([c for _, _, c in more], default=0.5 if base else 0.0)
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row each row of docs (doc_id, text): doc_id and the columns of COLUMNS.

    Null, empty and wordless texts have no places, empty label lists and score 0.  Repeated rows are scanned each for itself,
    equal labels of several places count once, texts of any length are scanned as wholes, and other columns, whatever their names, are ignored.  The score is the best verified
    template's share of words in place, weighted by rarity; 0.5 if only a base phrase was found; else 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(Scanner(*word_frequencies(docs, templates), templates))

    @F.pandas_udf("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    def scan(texts: pd.Series) -> pd.DataFrame:
        tidy()
        found = pd.DataFrame([held.value.scan(t) for t in texts], columns=COLUMNS)
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("s")).select("doc_id", *[f"s.{c}" for c in COLUMNS])


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scanned(table(spark, sf_dir, "documents"))
