"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>> ... <<end>>`` regions may be left out and
``<<any N>>`` stands for one to N replaceable words (names, years, numbers). Templates are compiled
into token automata over words; a text matches where an automaton accepts a run of its words, so the
mandatory wording must match exactly. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z, so punctuation and layout never matter.

Cases: null and empty texts have no words, labels '' and score 0; a doc_id may be null or repeated,
each row is judged for itself; extra columns are ignored by ``scan`` and kept by ``annotate``.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm import shared

#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_HELD = "<<optional>>copyright <<optional>>c<<end>> <<any 20>><<end>>"
_AS_IS = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright <<optional>>holder<<end>> <<optional>>owner<<end>> <<optional>>holders<<end>> or contributors be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out "
    "of the use of this software even if advised of the possibility of such damage"
)
_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>><<any 1>><<end>> redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer <<optional>><<any 1>><<end>> redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the gnu {} general public license as published by the free software foundation "
    "either version <<any 2>> of the license or at your option any later version"
)
#: Templates by label: wording of widely used public licenses, whole texts and the notices that stand in files.
TEMPLATES = {
    "mit": [
        "<<optional>>released<<end>> <<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> <<optional>>expat<<end>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "<<optional>>the mit license <<optional>>mit<<end>><<end>> " + _HELD + " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> "
        "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache-2": [
        "<<optional>>licensed under<<end>> <<optional>>the<<end>> apache license version 2 <<optional>>0<<end>>",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "cc-by-nc": ["<<optional>>licensed under<<end>> <<optional>>the<<end>> cc by nc <<optional>>sa<<end>> <<optional>>nd<<end>> <<optional>><<any 2>><<end>>", "creative commons attribution non commercial <<optional>>share alike<<end>> <<optional>>no derivatives<<end>> <<optional>><<any 3>><<end>> license"],
    "cc-by": ["licensed under <<optional>>the<<end>> <<optional>>creative commons attribution<<end>> cc by <<optional>>4 0<<end>> <<optional>>international<<end>> license", "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution <<optional>><<any 3>><<end>> license"],
    "cc-by-sa": ["licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution sharealike <<optional>><<any 3>><<end>> license", "licensed under <<optional>>the<<end>> cc by sa"],
    "cc0": ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "<<optional>>under<<end>> <<optional>>the<<end>> cc0 1 0 universal"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment "
        "in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind",
    ],
    "gpl": [
        "licensed under the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license <<optional>>version <<any 2>><<end>>",
        "under the terms of the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license as published by the free software foundation",
        _GNU.format("") + " <<any 6>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details",
    ],
    "lgpl": ["licensed under the gnu lesser general public license <<optional>>version <<any 2>><<end>>", _GNU.format("lesser")],
    "agpl": ["licensed under the gnu affero general public license <<optional>>version <<any 2>><<end>>", _GNU.format("affero")],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http <<optional>>s<<end>> <<optional>>www<<end>> mozilla org mpl 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2": [_TWO + " " + _AS_IS],
    "bsd-3": [
        _TWO + " <<optional>><<any 1>><<end>> neither the name of <<any 12>> nor the names of <<optional>>its<<end>> <<optional>>any<<end>> contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _AS_IS
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        _HELD + " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<optional>><<any 1>><<end>> the origin of "
        "this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not "
        "required <<optional>><<any 1>><<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>><<any 1>><<end>> this notice may not be removed or "
        "altered from any source distribution",
    ],
    "bsl-1": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "all-rights-reserved": ["copyright <<optional>>c<<end>> <<any 8>> all rights reserved"],
}
#: License identifiers of SPDX, in words, by label.
SPDX = {
    "mit": ["mit"], "apache-2": ["apache 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"], "bsd-2": ["bsd 2 clause"], "bsd-3": ["bsd 3 clause"], "mpl-2": ["mpl 2 0"],
    "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "cc0": ["cc0 1 0"], "cc-by": ["cc by 4 0"], "cc-by-sa": ["cc by sa 4 0"], "cc-by-nc": ["cc by nc 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0"], "bsl-1": ["bsl 1 0"],
}
for _label, _ids in SPDX.items():  # alone, or behind others in an expression
    TEMPLATES[_label] += [f"spdx license identifier {before}{i}" for i in _ids for before in ("", "<<any 9>> or ", "<<any 9>> and ")]
_MARK = re.compile(r"<<optional>>|<<end>>|<<any (\d+)>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY = b""


class Automaton:
    """States 0..n; ``step[s]`` lists (word or ANY, next state), ``skip[s]`` the states reached without a word."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.mandatory = [0]  # mandatory words passed on the way to each state
        open_at: list[int] = []
        for m in _MARK.finditer(template.lower()):
            token = m.group()
            if token == "<<optional>>":
                open_at.append(len(self.step) - 1)
            elif token == "<<end>>":
                begun = open_at.pop()
                self.skip[begun].append(len(self.step) - 1)
                self.mandatory[len(self.step) - 1] = self.mandatory[begun]
            elif m.group(1):
                first = len(self.step) - 1
                ends = [self._word(ANY, 0) for _ in range(int(m.group(1)))]
                for s in ends[:-1]:
                    self.skip[s].append(ends[-1])
                self.mandatory[ends[-1]] = self.mandatory[first]
            else:
                self._word(token.encode(), 0 if open_at else 1)
        self.accept = len(self.step) - 1
        self.total = max(1, self.mandatory[self.accept])
        words = {w for arcs in self.step for w, _ in arcs if w}
        anchored = [w for s, arcs in enumerate(self.step) for w, t in arcs if w and self.mandatory[t] == self.mandatory[s] + 1]
        #: The longest mandatory word: a text without it can't be accepted.
        self.anchor = max(anchored or words, key=lambda w: (len(w), w))
        self.first = {w for s in self._closed({0}) for w, _ in self.step[s]}
        if ANY in self.first:
            raise ValueError("a template begins with a word of its own, not with replaceable ones")

    def _word(self, word: bytes, mandatory: int) -> int:
        self.step[-1].append((word, len(self.step)))
        self.step.append([])
        self.skip.append([])
        self.mandatory.append(self.mandatory[-1] + mandatory)
        return len(self.step) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def match(self, words: list[bytes], start: int) -> tuple[int, float]:
        """End of the longest accepted run from start (or -1), and the share of mandatory words passed."""
        states, at, end, best = self._closed({0}), start, -1, 0
        while states:
            best = max(best, *(self.mandatory[s] for s in states))
            if self.accept in states:
                end = at
            if at == len(words):
                break
            states = self._closed({t for s in states for w, t in self.step[s] if w in (ANY, words[at])})
            at += 1
        return end, best / self.total


@cache
def compiled() -> dict[bytes, list[tuple[str, Automaton]]]:
    """Labels and automata by their anchor."""
    out: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, templates in TEMPLATES.items():
        for a in map(Automaton, templates):
            out.setdefault(a.anchor, []).append((label, a))
    return out


def scan_text(raw: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, accepted spans) of one text."""
    low = raw.lower()  # bytes: A-Z only
    hits = [hit for anchor, of in compiled().items() if anchor in low for hit in of]
    if not hits and not any(p.rsplit(" ", 1)[-1].encode() in low for p in PHRASES):
        return None
    words = _WORD.findall(low)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        wanted = b" " + phrase.encode() + b" "
        at, since, word = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", since, at)
            since = at
            places.append(word)
            base.add(label)
            at = line.find(wanted, at + 1)
    labels, score, spans = set(base), 0.0, []
    where: dict[bytes, list[int]] = {}
    if hits:
        firsts = set().union(*(a.first for _, a in hits))
        for i, w in enumerate(words):
            if w in firsts:
                where.setdefault(w, []).append(i)
    for label, a in hits:
        for i in sorted(i for w in a.first for i in where.get(w, ())):
            end, share = a.match(words, i)
            score = max(score, share)
            if end > i:
                labels.add(label)
                spans.append((label, i, end - i))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if labels else score, spans


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,word:long,n_words:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base phrase counts, labels, score and the accepted spans (narrow, no shuffle)."""

    def run(batches):
        for batch, raw, bounds in shared.chunks(batches):
            starts, _, offsets = shared.word_spans(np.where((raw >= 65) & (raw <= 90), raw | 32, raw), bounds, shared.NOT_ALNUM)
            n_words, data = np.diff(offsets), raw.tobytes()
            found = [scan_text(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = [f or (int(n), 0, None, None, "", "", 0.0, []) for f, n in zip(found, n_words, strict=True)]
            cols = list(zip(*rows, strict=True))
            long = pa.int64()
            spans = pa.array([[{"label": s[0], "word": s[1], "n_words": s[2]} for s in x] for x in cols[7]], pa.list_(pa.struct([("label", pa.string()), ("word", long), ("n_words", long)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, long) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.float64()), spans],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return shared.text_of(docs).mapInArrow(run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
