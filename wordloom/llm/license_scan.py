"""License scan by template markup.

A template is plain words with two kinds of markup: ``<opt> ... </opt>`` may be left out, ``<any:N>`` stands for up to N
words of any kind, such as a holder's name.  It is compiled into a token automaton; a text holds the license if, from
some word on, the mandatory words follow one another exactly, with nothing between them but what the markup allows.
Templates are whole license texts (score 1), notices that files carry (0.9), openings of license texts, whose changed terms
may follow (label ``...-opening``, 0.7), and mentions by name and version (0.6).  Beside the templates, base phrases are
counted wherever their words stand consecutively (0.5).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Defined results: a null or empty text has 0 words, no places (first and last null), empty labels and score 0;
overlapping places all count; texts of any length are scanned whole; the score is that of the best label; rows are independent, so repeated rows
repeat, and a null id stays null; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import map_batches

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of well-known licenses, in words, with what may be left out or replaced.
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
MIT_OPENING = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
MIT = (
    f"{MIT_OPENING} the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <opt>including the next paragraph</opt>"
    f" shall be included in all copies or substantial portions of the software {AS_IS} in no event shall <any:8> be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
    " arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC_OPENING = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
ISC_KEEP = "provided that the above copyright notice and this permission notice appear in all copies"
ISC_END = (
    "the software is provided as is and <any:6> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <any:6> be liable for any special direct"
    " indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or"
    " performance of this software"
)
BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_TWO = (
    f"{BSD_OPENING} <opt>1</opt> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <opt>2</opt> redistributions in binary form must reproduce the above"
    " copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "<opt>3</opt> neither the name of <any:12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_END = (
    "this software is provided by <any:8> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall"
    " <any:8> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption"
    " however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will <any:4> be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any"
    " purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <opt>1</opt> the origin of this software must not be misrepresented you must not claim that you wrote the"
    " original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <opt>2</opt> altered source versions must be plainly marked as such and must not be"
    " misrepresented as being the original software <opt>3</opt> this notice may not be removed or altered from any source distribution"
)
UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"
    " commercial or non commercial and by any means"
)
APACHE_NOTICE = (
    "licensed under the apache license version 2 0 the license you may not use this <any:3> except in compliance with the license you may obtain a copy of the license at <opt>http</opt> <opt>https</opt> www apache org licenses license 2 0"
    " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the"
    " specific language governing permissions and limitations under the license"
)
GPL_NOTICE = (
    "free software you can redistribute it and or modify it under the terms of the gnu {kind} license as published by the free software foundation either version {version} of the license or at your option any later version"
    " <any:4> distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} license for more details"
)
MPL_NOTICE = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <opt>http</opt> <opt>https</opt> mozilla org mpl 2 0"
GPL_KINDS = {"gpl": "general public", "lgpl": "lesser general public", "agpl": "affero general public"}
TEXTS = {
    "0bsd": [f"{ISC_OPENING} {ISC_END}"],
    "bsd-2-clause": [f"{BSD_TWO} {BSD_END}"],
    "bsd-3-clause": [f"{BSD_TWO} {BSD_NAMES} {BSD_END}"],
    "isc": [f"{ISC_OPENING} {ISC_KEEP} {ISC_END}"],
    "mit": [MIT],
    "zlib": [ZLIB],
}
NOTICES = {
    "apache-2.0": [APACHE_NOTICE],
    "mpl-2.0": [MPL_NOTICE],
    "unlicense": [UNLICENSE],
} | {f"{label}-{n}.0": [GPL_NOTICE.format(kind=kind, version=n)] for label, kind in GPL_KINDS.items() for n in ((2, 3) if label == "gpl" else (3,))}
OPENINGS = {"bsd-opening": [BSD_OPENING], "isc-opening": [f"{ISC_OPENING} {ISC_KEEP}"], "mit-opening": [MIT_OPENING]}
MENTIONS = {
    "apache-2.0": ["apache license <opt>version</opt> 2 0", "apache license v2 <opt>0</opt>"],
    "bsd": ["under the <opt>new</opt> <opt>2 clause</opt> <opt>3 clause</opt> <opt>simplified</opt> <opt>modified</opt> bsd license"],
    "cc-by-4.0": ["licensed under <opt>a creative commons attribution license</opt> cc by 4 0", "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nc-nd-4.0": ["licensed under cc by nc nd 4 0"],
    "cc-by-nc-sa-4.0": ["licensed under cc by nc sa 4 0"],
    "cc-by-nd-4.0": ["licensed under cc by nd 4 0"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2"],
    "gpl-3.0": ["gnu general public license version 3", "gnu general public license v3", "general public license v3", "gnu gpl v3"],
    "mit": ["under the <opt>terms of the</opt> mit license"],
    "mpl-2.0": ["mozilla public license <opt>version</opt> <opt>v</opt> 2 0"],
}
#: Scores of the kinds of templates, and of a base phrase alone.
GRADES, BASE_GRADE = ((1.0, TEXTS), (0.9, NOTICES), (0.7, OPENINGS), (0.6, MENTIONS)), 0.5

#: Bytes to words: A-Z become a-z, separators become spaces.
TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)
MARKUP = re.compile(r"<opt>|</opt>|<any:(\d+)>|[^\s<]+")


class TokenAutomaton:
    """States with edges on a word; ``None`` is an edge on any word.  Edges without a word are closed away beforehand."""

    def __init__(self, template: str):
        self.words: list[dict[str | None, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.mandatory: list[str] = []
        opened, at = [], 0
        for m in MARKUP.finditer(template):
            if m[0] == "<opt>":
                opened.append(at)
            elif m[0] == "</opt>":
                self.free[opened.pop()].add(at)
            elif m[1]:
                first = at
                for _ in range(int(m[1])):
                    at = self.edge(at, None)
                    self.free[first].add(at)
            else:
                at = self.edge(at, m[0])
                if not opened:
                    self.mandatory.append(m[0])
        if opened or not self.mandatory:
            raise ValueError("a template has a mandatory word and closes its markup")
        # an optional region may end where the next one starts: close over free edges
        self.closure = [self.reach(s) for s in range(len(self.words))]
        self.end = at

    def edge(self, at: int, word: str | None) -> int:
        self.words.append({})
        self.free.append(set())
        self.words[at].setdefault(word, set()).add(len(self.words) - 1)
        return len(self.words) - 1

    def reach(self, s: int) -> set[int]:
        seen, todo = {s}, [s]
        while todo:
            for t in self.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    def accepts_at(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest match that starts at ``start``."""
        states, best, i = set(self.closure[0]), None, start
        while states:
            if self.end in states:
                best = i
            if i >= len(words):
                break
            word = words[i].decode("utf-8", "replace")
            step = {t for s in states for key in (word, None) for t in self.words[s].get(key, ())}
            states = set().union(*(self.closure[t] for t in step))
            i += 1
        return best


def longest_run(template: str) -> str:
    """The longest stretch of mandatory words with no markup in it."""
    depth, runs = 0, [[]]
    for m in MARKUP.finditer(template):
        depth += (m[0] == "<opt>") - (m[0] == "</opt>")
        if depth or m[0] == "</opt>" or m[1]:
            runs.append([])
        else:
            runs[-1].append(m[0])
    return " ".join(max(runs, key=lambda r: len(" ".join(r))))


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, grades: tuple[tuple[float, dict[str, list[str]]], ...] = GRADES):
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.templates = [(grade, label, f" {longest_run(t)} ".encode(), TokenAutomaton(t)) for grade, held in grades for label, ts in held.items() for t in ts]

    @staticmethod
    def places(line: bytes, phrase: bytes) -> list[int]:
        """Word numbers at which the phrase starts; neighbours share the space between them, so overlaps count."""
        out, at, word, seen = [], line.find(phrase), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            out.append(word)
            at = line.find(phrase, at + 1)
        return out

    def scan(self, text: str | None) -> tuple[int, list[int], list[str], list[str], float]:
        """Number of words, base places, base labels, all labels, score."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split(b" ")
        words = [w for w in words if w]
        line = b" " + b" ".join(words) + b" "
        hits, base, full = [], set(), {}
        for phrase, label in self.base:
            if found := self.places(line, phrase):
                hits += found
                base.add(label)
        for grade, label, run, automaton in self.templates:
            if full.get(label, 0) < grade and run in line and any(automaton.accepts_at(words, i) is not None for i in self.starts(automaton, words)):
                full[label] = grade
        score = max([*full.values(), BASE_GRADE if base else 0.0])
        return len(words), sorted(hits), sorted(base), sorted(base | full.keys()), score

    @staticmethod
    def starts(automaton: TokenAutomaton, words: list[bytes]) -> list[int]:
        first = {w.encode() for s in automaton.closure[0] for w in automaton.words[s] if w is not None}
        return [i for i, w in enumerate(words) if w in first]


def scan(df: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: words, base places, labels and score."""
    held = scanner or Scanner()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [held.scan(t) for t in batch.column(1).to_pylist()]
            return pa.record_batch(
                [
                    batch.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([len(x[1]) for x in out], pa.int64()),
                    pa.array([x[1][0] if x[1] else None for x in out], pa.int64()),
                    pa.array([x[1][-1] if x[1] else None for x in out], pa.int64()),
                    pa.array([",".join(x[2]) for x in out]),
                    pa.array([",".join(x[3]) for x in out]),
                    pa.array([x[4] for x in out], pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

        return run

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, "text", "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
