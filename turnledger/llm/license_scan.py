"""License scans by template markup.

A template is plain wording with <<beginOptional>>...<<endOptional>> regions, which may be left out as a
whole, and <<var;name="...";original="...";words="LOW..HIGH">> regions, where LOW to HIGH words of any kind may
stand. Templates compile to token automata over lower-cased words. A place in a text is accepted when the
mandatory wording stands there word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, words

#: Phrases whose every place counts as a base hit.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": 'Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0<<beginOptional>> (the "License")<<endOptional>>',
    "cc-by-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0",
    "cc-by-nc-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0",
    "cc-by-sa-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-SA 4.0",
    "gpl": '<<var;name="subject";original="This work";words="1..4">> is licensed under the <<beginOptional>>GNU<<endOptional>> General Public License<<beginOptional>>, version <<var;name="version";original="3";words="1..1">><<endOptional>>',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<beginOptional>>and associated documentation files<<endOptional>> <<beginOptional>>(the "Software")<<endOptional>> to deal in the Software without restriction',
    "mit-named": "<<beginOptional>>Released<<endOptional>> under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "reserved": '<<beginOptional>>Copyright <<var;name="holder";original="";words="0..8">><<endOptional>> All rights reserved',
}

#: Whole licence texts. What a licence lets its user fill in is replaceable; headings, numbering and clauses that versions of
#: the text differ in are optional. The wording is the licences'.
TEMPLATES |= {
    "mit-text": """<<beginOptional>>The MIT License<<endOptional>> <<beginOptional>>(MIT)<<endOptional>>
<<beginOptional>>Copyright (c) <<var;name="holder";original="<year> <holders>";words="1..24">><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<beginOptional>>and
associated documentation files<<endOptional>> <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="copyrightHolder";original="THE AUTHORS OR COPYRIGHT HOLDERS";words="1..12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;name="holder";original="(c) <year> <holders>";words="1..24">><<endOptional>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
<<var;name="disclaimer";original="THE AUTHOR";words="1..12">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";words="1..12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of
<<var;name="organization";original="the copyright holder";words="1..12">> nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name="provider";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";words="1..12">>
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;name="file";original="this file";words="1..4">> except in compliance with the
License. You may obtain a copy of the License at <<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";words="1..10">> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": """<<var;name="program";original="This program";words="1..6">> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
<<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>>
version <<var;name="version";original="3 of the License";words="1..5">><<beginOptional>>, or (at your option) any later version<<endOptional>>.""",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at<<endOptional>>",
    "public-domain": "This is free and unencumbered software released into the public domain. <<beginOptional>>Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software<<endOptional>>",
}

_MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"]*";original="[^"]*";words="\d+\.\.\d+")>>')


@dataclass
class Automaton:
    """State s reads a word to the states in step[s]; any[s] holds the states any word leads to; free[s] are
    reached without a word. State 0 starts, the last state accepts."""

    label: str
    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    #: Mandatory words, each with the most words that may stand before it.
    mandatory: list[tuple[bytes, int]] = field(default_factory=list)

    def add(self) -> int:
        for part, empty in ((self.step, {}), (self.any, []), (self.free, [])):
            part.append(empty)
        return len(self.step) - 1

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, text: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from `at`, or -1."""
        final, states, end, i = len(self.step) - 1, self.close({0}), -1, at
        while states:
            if final in states:
                end = i
            if i == len(text):
                break
            word, nxt = text[i], set()
            for s in states:
                if (t := self.step[s].get(word)) is not None:
                    nxt.add(t)
                nxt.update(self.any[s])
            states, i = self.close(nxt), i + 1
        return end


def compile_template(label: str, text: str) -> Automaton:
    """Raises ValueError for markup that does not pair up or has no mandatory word."""
    out, at, opened, reach, end = Automaton(label), 0, [], 0, 0

    def wording(part: str) -> None:
        nonlocal at, reach
        for word in words(part.encode()):
            nxt = out.add()
            out.step[at][word] = nxt
            at = nxt
            if not opened:
                out.mandatory.append((word, reach))
            reach += 1

    for mark in _MARK.finditer(text):
        wording(text[end : mark.start()])
        end = mark.end()
        if mark[1] == "beginOptional":
            entry = out.add()
            out.free[at].append(entry)
            opened.append(entry)
            at = entry
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError(f"{label}: endOptional without beginOptional")
            after = out.add()
            out.free[at].append(after)
            out.free[opened.pop()].append(after)
            at = after
        else:
            low, high = map(int, re.search(r'words="(\d+)\.\.(\d+)"', mark[1]).groups())
            stops = []
            for k in range(high):
                if k >= low:
                    stops.append(at)
                nxt = out.add()
                out.any[at].append(nxt)
                at = nxt
            after = out.add()
            for s in [*stops, at]:
                out.free[s].append(after)
            at, reach = after, reach + high
    wording(text[end:])
    if opened or not out.mandatory:
        raise ValueError(f"{label}: optional region left open" if opened else f"{label}: no mandatory word")
    out.free[at].append(out.add())
    return out


class Scanner:
    """All templates at once. A template is tried only around its longest mandatory word."""

    def __init__(self, templates: dict[str, str], base: dict[str, str]):
        self.base = [(words(phrase.encode()), label) for phrase, label in base.items()]
        self.anchors: dict[bytes, list[tuple[Automaton, int]]] = {}
        for label, text in templates.items():
            automaton = compile_template(label, text)
            word, reach = max(automaton.mandatory, key=lambda x: len(x[0]))
            self.anchors.setdefault(word, []).append((automaton, reach))

    def scan(self, text: list[bytes]) -> dict:
        """n_words, n_base, first_word, last_word, base_labels, spans [(start, end, label)] by the templates."""
        places = [i for i, w in enumerate(text) if w in self.anchors]
        starts, labels = [], set()
        for phrase, label in self.base:
            n, i = len(phrase), -1
            first = phrase[0]
            try:
                while True:
                    i = text.index(first, i + 1)
                    if text[i : i + n] == phrase:
                        starts.append(i)
                        labels.add(label)
            except ValueError:
                pass
        spans = set()
        for i in places:
            for automaton, reach in self.anchors[text[i]]:
                for at in range(max(0, i - reach), i + 1):
                    if (end := automaton.match(text, at)) > i:
                        spans.add((at, end, automaton.label))
                        break
        return {"n_words": len(text), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": labels, "spans": sorted(spans)}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row. score is 1 with an accepted template, 0.5 with base phrases alone, else 0.

    A null text is an empty one: no words, no labels, score 0. Ids are whole numbers. Repeated rows and null ids give rows of their
    own; an empty table gives none; other columns are not read. Of templates that are accepted at one place all count; of the ends
    that one template has at one place the last counts. A text's time grows with its length and with the places of the
    templates' longest words, times the words that may stand before them."""
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    Scanner(templates, base)  # broken markup fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                r = scanner.scan(words(text.as_py()))
                spans = [{"start": a, "end": b, "label": label} for a, b, label in r["spans"]]
                found = r["base_labels"] | {s["label"] for s in spans}
                out.append({"doc_id": doc.as_py(), **r, "base_labels": ",".join(sorted(r["base_labels"])), "labels": ",".join(sorted(found)), "score": 1.0 if spans else 0.5 if r["n_base"] else 0.0, "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])))])


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return scan_licenses(read(spark, sf_dir, "documents"))
