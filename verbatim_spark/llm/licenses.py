"""License scans by template-markup matching.

A template is license wording with regions marked optional or replaceable. It
is compiled into an automaton over words and accepts a stretch of a document
whose mandatory wording is exactly the template's. Beside it, fixed phrases are
found wherever their words stand consecutively.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, text_bytes, words

# The contract's phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wording of public licenses and of the notices that name them.
# <<opt>> ... <<end>> may be missing; <<var N>> stands for 0 to N words.
TEMPLATES = {
    "mit": [
        """<<opt>>mit license<<end>> <<opt>>copyright <<var 12>><<end>> permission is hereby granted free of charge to any
        person obtaining a copy of this software and associated documentation files the software to deal in the
        software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the
        software <<opt>>the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the authors or copyright holders be liable for any claim damages or other liability whether in an action
        of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software<<end>>""",
        "<<opt>>this <<var 2>> is<<end>> <<opt>>released<<end>> <<opt>>licensed<<end>> under the mit license",
    ],
    "apache-2.0": [
        """licensed under the apache license version 2 0 <<opt>>the license<<end>> <<opt>>you may not use this file except in
        compliance with the license you may obtain a copy of the license at <<var 8>> unless required by applicable law
        or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied<<end>>""",
        "<<opt>>released<<end>> under <<opt>>the<<end>> apache 2 0 <<opt>>license<<end>>",
    ],
    "bsd-3-clause": [
        """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce
        the above copyright notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution <<opt>>3<<end>> neither the name of <<var 12>> nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission <<opt>>this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall the copyright <<var 2>> or contributors be liable for any direct
        indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
        any way out of the use of this software even if advised of the possibility of such damage<<end>>""",
        "<<opt>>licensed<<end>> under the <<opt>>new<<end>> bsd <<opt>>3 clause<<end>> license",
    ],
    "bsd-2-clause": [
        """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce
        the above copyright notice this list of conditions and the following disclaimer in the documentation and or
        other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall the copyright <<var 2>> or contributors be liable for any direct
        indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
        any way out of the use of this software even if advised of the possibility of such damage""",
    ],
    "zlib": [
        """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions <<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim
        that you wrote the original software if you use this software in a product an acknowledgment in the product
        documentation would be appreciated but is not required <<opt>>2<<end>> altered source versions must be plainly
        marked as such and must not be misrepresented as being the original software <<opt>>3<<end>> this notice may not
        be removed or altered from any source distribution""",
        "<<opt>>licensed<<end>> under the zlib license",
    ],
    "unlicense": [
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means <<opt>>in jurisdictions that recognize copyright laws the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain<<end>>""",
    ],
    "mpl-2.0": [
        """this source code form is subject to the terms of the mozilla public license v 2 0 <<opt>>if a copy of the mpl was
        not distributed with this file you can obtain one at <<var 8>><<end>>""",
        "<<opt>>licensed<<end>> under the mozilla public license <<opt>>version<<end>> 2 0",
    ],
    "isc": [
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies
        <<opt>>the software is provided as is and the author disclaims all warranties with regard to this software
        including all implied warranties of merchantability and fitness in no event shall the author be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or
        profits whether in an action of contract negligence or other tortious action arising out of or in connection
        with the use or performance of this software<<end>>""",
        "<<opt>>licensed<<end>> under the isc license",
    ],
    "gpl-notice": [
        """<<opt>>this <<var 2>> is<<end>> licensed under the <<opt>>terms of the<<end>> gnu <<opt>>lesser<<end>> <<opt>>affero<<end>>
        general public license <<opt>>gpl<<end>> <<opt>>version <<var 1>> <<opt>>or <<opt>>at your option<<end>> any later version<<end>><<end>>""",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation either version <<var 2>> <<opt>>of the license<<end>>
        or at your option any later version <<opt>>this program is distributed in the hope that it will be useful but
        without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details<<end>> <<opt>>you should have received a copy of the gnu
        general public license along with this program if not see <<var 8>><<end>>""",
    ],
    "cc-by-notice": [
        "licensed under <<opt>>a<<end>> cc by <<opt>>sa<<end>> <<opt>>4 0<<end>> <<opt>>3 0<<end>> <<opt>>license<<end>>",
        "creative commons attribution <<opt>>sharealike<<end>> <<var 2>> international <<opt>>public<<end>> license",
    ],
    "cc-by-nc": [
        "licensed under <<opt>>a<<end>> cc by nc <<opt>>sa<<end>> <<opt>>nd<<end>> <<opt>>4 0<<end>> <<opt>>3 0<<end>> <<opt>>license<<end>>",
        "creative commons attribution noncommercial <<opt>>sharealike<<end>> <<opt>>noderivatives<<end>> <<var 2>> international <<opt>>public<<end>> license",
    ],
    "all-rights-reserved": ["copyright <<var 12>> all rights reserved"],
}


@dataclass
class Automaton:
    """States 0..n-1 and an accepting one, n. ``words[s]`` is what state s reads
    (None: any word) and leads to s + 1; ``skips[s]`` are states reached for free."""

    words: list[bytes | None] = field(default_factory=list)
    skips: dict[int, list[int]] = field(default_factory=dict)
    #: Runs of mandatory words, as they stand in a line of words.
    runs: list[bytes] = field(default_factory=list)

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, line: list[bytes], at: int) -> int | None:
        """The end of the longest stretch accepted from word ``at``."""
        states, end, last = self.closed({0}), None, len(self.words)
        while states:
            if last in states:
                end = at
            if at >= len(line):
                break
            word = line[at]
            states = self.closed({s + 1 for s in states if s < last and self.words[s] in (None, word)})
            at += 1
        return end


def compile_template(markup: str) -> Automaton:
    machine, open_at, run = Automaton(), [], []

    def flush():
        if run:
            machine.runs.append(b" " + b" ".join(run) + b" ")
            run.clear()

    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<opt>>":
            flush()
            open_at.append(len(machine.words))
        elif part == "<<end>>":
            machine.skips.setdefault(open_at.pop(), []).append(len(machine.words))
        elif part.startswith("<<var"):
            flush()
            n = int(part[5:-2])
            for k in range(n):
                machine.skips.setdefault(len(machine.words) + k, []).append(len(machine.words) + n)
            machine.words += [None] * n
        else:
            found = words(part.encode())
            machine.words += found
            if not open_at:
                run += found
    flush()
    if open_at or not machine.runs:
        raise ValueError(f"a template needs mandatory words and closed regions: {markup[:60]}")
    return machine


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.machines = [(label, compile_template(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int]]]:
        """The number of words, the phrases' places (word, label) and the
        templates' stretches (label, start, end) of one text."""
        found = words(text) if text else []
        line = b" " + b" ".join(found) + b" "
        places = []
        for phrase, label in self.phrases:
            at = word = 0
            while (hit := line.find(phrase, at)) >= 0:
                word += line.count(b" ", at, hit)
                places.append((word, label))
                at = hit
                word += 1
                at += 1
        stretches = []
        for label, machine in self.machines:
            if all(run in line for run in machine.runs):
                firsts = {machine.words[s] for s in machine.closed({0})}
                at = 0
                while at < len(found):
                    end = machine.longest(found, at) if None in firsts or found[at] in firsts else None
                    if end is not None and end > at:
                        stretches.append((label, at, end))
                        at = end
                    else:
                        at += 1
        return len(found), sorted(places), _outermost(stretches)


def _outermost(stretches: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without those inside a longer one, such as CC BY in CC BY-NC."""
    kept, reach = [], 0
    for label, start, end in sorted(stretches, key=lambda x: (x[1], -x[2], x[0])):
        if end > reach or kept and (start, end) == kept[-1][1:]:
            kept.append((label, start, end))
            reach = max(reach, end)
    return kept


@shipped
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of docs: (doc_id, n_words, places array<struct<word, label>>,
    stretches array<struct<label, start, end>>); end is exclusive, words count
    from 0. Null and empty texts have no words and nothing found. Of templates that
    overlap the longer stretch counts, of equal stretches all labels. Repeated rows
    each get theirs; long texts are scanned whole, and only from words that a
    template begins with, if it has all the template's mandatory runs."""

    def run(batches):
        scanner = Scanner(templates, phrases)
        places = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        stretches = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            n, p, s = zip(*map(scanner.scan, text_bytes(batch.column(1))), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()),
                    pa.array([[{"word": w, "label": x} for w, x in row] for row in p], places),
                    pa.array([[{"label": x, "start": a, "end": b} for x, a, b in row] for row in s], stretches),
                ],
                ["doc_id", "n_words", "places", "stretches"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        run,
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, "
        "places array<struct<word:bigint,label:string>>, stretches array<struct<label:string,start:bigint,end:bigint>>",
    )


def score(places, stretches):
    """1 where a template's mandatory wording matches, 0.6 for a phrase alone, else 0."""
    return F.when(F.size(stretches) > 0, 1.0).when(F.size(places) > 0, 0.6).otherwise(0.0)
