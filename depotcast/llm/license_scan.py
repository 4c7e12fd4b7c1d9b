r"""License scans (operator 10) by template-markup matching.

A template is a text with markup:

    <<beginOptional>> ... <<endOptional>>   wording that may be missing (may be nested)
    <<var;match=N>>                        up to N words of any wording (a name, a year)

Templates are whole license texts, of which every mandatory word must stand there, and notices, which
only name a license or open its text; a notice scores less, so a license with altered conditions is
never as sure as the real one. A template is compiled into an automaton over words: mandatory words are single steps, optional regions
can be stepped over, replaceable regions take any word. A document has a license where the whole
template is accepted from some word on. Templates begin and end with mandatory words, so a run is
started only where the first of them stands. Words are normalised as in operator 2.

``PHRASES`` are fixed wordings counted at every place; their labels are never taken away.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import held, in_slices
from depotcast.llm.common import fresh, ship_package
from depotcast.llm.decontaminate import char_places, word_places, words_of

#: Wording and label of the phrases. Fixed values.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label and whole license text. The wording is that of the public licenses. Fixed values.
TEXTS = (
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE
    """),
    ("bsd-2", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;match=10>> "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
        PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE
    """),
    ("bsd-3", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of
        <<var;match=12>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors may be
        used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY <<var;match=10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=10>> BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
        WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE
    """),
    ("isc", """
        Permission to use, copy, modify, and <<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=6>> BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE
    """),
    ("zlib", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such,
        and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be
        removed or altered from any source distribution
    """),
    ("unlicense", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE
    """),
)

#: Label and notice: what names a license, or opens its text, without being it. Fixed values.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "<<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction"),
    ("mit", "<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>open source<<endOptional>> License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "<<beginOptional>><<var;match=8>><<endOptional>> provided that the following conditions are met"),
    ("bsd", "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<var;match=2>> BSD <<beginOptional>>style<<endOptional>> license"),
    ("isc", "Permission to use, copy, modify, and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "GNU General Public License, <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 3"),
    ("gpl-2", "GNU General Public License, <<beginOptional>>as published by the Free Software Foundation, either<<endOptional>> version 2"),
    ("gpl", "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License"),
    ("gpl", "under the terms of the GNU General Public License"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Library<<endOptional>> General Public License <<beginOptional>>version 2<<endOptional>> LGPL"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, <<beginOptional>>v<<endOptional>> <<var;match=1>> 2"),
    ("cc-by-nc", "Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by", "licensed under a Creative Commons Attribution <<var;match=2>> <<beginOptional>>International<<endOptional>> License"),
    ("cc0", "CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "Copyright <<beginOptional>>c<<endOptional>> <<var;match=8>> All rights reserved"),
)

#: What a label is worth by what it rests on: a whole text, a notice, a phrase alone.
TEXT_SCORE, NOTICE_SCORE, PHRASE_SCORE = 1.0, 0.75, 0.5

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;match=\d+)>>")


class Template:
    """A word automaton. State i waits before step i; a step is a word or None (any word); ``skips``
    are the states that can be entered without a word."""

    def __init__(self, label: str, source: str, score: float = NOTICE_SCORE):
        self.label, self.score = label, score
        self.steps: list[str | None] = []
        skips: dict[int, set[int]] = {}
        open_at: list[int] = []
        for k, part in enumerate(_MARKUP.split(source)):
            if not k % 2:
                self.steps += [w.decode() for w in words_of(part.encode())]
            elif part == "beginOptional":
                open_at.append(len(self.steps))
            elif part == "endOptional":
                skips.setdefault(open_at.pop(), set()).add(len(self.steps))
            else:
                first, n = len(self.steps), int(part.rpartition("=")[2])
                self.steps += [None] * n
                for i in range(first, first + n):
                    skips.setdefault(i, set()).add(first + n)
        if open_at:
            raise ValueError(f"an optional region of {label} does not end")
        self.optional = [(a, b) for a, ends in skips.items() for b in ends]
        self.closure = [self._reach({i}, skips) for i in range(len(self.steps) + 1)]
        starts = {self.steps[i] for i in self.closure[0] if i < len(self.steps)}
        if None in starts or len(self.steps) in self.closure[0]:
            raise ValueError(f"the template of {label} needs a word to begin with")
        self.starts = starts

    def _reach(self, states: set[int], skips: dict[int, set[int]]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for x in skips.get(todo.pop(), ()):
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return frozenset(states)

    def end(self, words: list[str], at: int) -> int | None:
        """Where the shortest accepted run from ``at`` ends."""
        states, last = self.closure[0], len(self.steps)
        for i in range(at, len(words)):
            ahead: set[int] = set()
            for s in states:
                if s < last and (self.steps[s] is None or self.steps[s] == words[i]):
                    ahead |= self.closure[s + 1]
            if last in ahead:
                return i + 1
            if not ahead:
                return None
            states = ahead
        return None


class Scanner:
    def __init__(self, texts=TEXTS, notices=NOTICES, phrases=PHRASES):
        self.templates = [Template(*t, TEXT_SCORE) for t in texts] + [Template(*t) for t in notices]
        self.by_start: dict[str, list[Template]] = {}
        for t in self.templates:
            for word in t.starts:
                self.by_start.setdefault(word, []).append(t)
        # a template can only match a text that has all of its mandatory words; one rare one is enough
        self.phrases = [(f" {p} ".encode(), len(p.split()), label) for p, label in phrases]
        self.needed = {t: self._rarest(t) for t in self.templates}

    @staticmethod
    def _rarest(template: Template) -> bytes:
        """The longest word that every accepted text holds, between blanks."""
        must = [w for i, w in enumerate(template.steps) if w and not any(a <= i < b for a, b in template.optional)]
        return f" {max(must, key=len)} ".encode() if must else b" "

    def scan(self, text: bytes | None):
        """(n_words, places of phrases (word, label), matches of templates (first, end, label, score))."""
        words = words_of(text)
        if not words:
            return 0, [], []
        line = b" " + b" ".join(words) + b" "
        places = []
        for wording, _, label in self.phrases:
            at, counted, before = line.find(wording), 0, 0
            while at >= 0:
                before += line.count(b" ", counted, at)  # blanks in front of this place, counted once
                places.append((before, label))
                counted, at = at, line.find(wording, at + 1)
        wanted = [t for t in self.templates if self.needed[t] in line]
        matches = []
        if wanted:
            starts = {w.encode(): [t for t in self.by_start[w] if t in wanted] for t in wanted for w in t.starts}
            texts = None
            for i, word in enumerate(words):
                if word in starts:
                    texts = texts or [w.decode() for w in words]
                    for template in starts[word]:
                        end = template.end(texts, i)
                        if end is not None:
                            matches.append((i, end, template.label, template.score))
        return len(words), places, matches


MATCH = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")] + [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH)), T.StructField("score", T.DoubleType()),
    ]
)


def find_licenses(docs: DataFrame, *, texts=TEXTS, notices=NOTICES, phrases=PHRASES, text: str = "text", into: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``into``: n_words; the phrases' places (n_base, first_word, last_word,
    base_labels); labels of phrases and templates, distinct and sorted; the templates' matches with
    their words and characters of the original text; and a score.

    The score is 0 without a label, 1 where a whole license text is accepted, 0.75 where a notice is, and
    0.5 where a phrase alone stands. Null and empty texts have no words and no labels. All columns and repeated rows stay;
    ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"the documents already have a column {into}")
    ship_package(docs.sparkSession)
    work = fresh(docs.columns, "license_work")
    schema = T.StructType([*docs.schema.fields, T.StructField(work, RESULT)])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(RESULT)
        scanner = held(("licenses", texts, notices, phrases), lambda: Scanner(texts, notices, phrases))
        for batch in in_slices(batches, text):
            rows = []
            for x in batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist():
                n, places, matches = scanner.scan(x)
                base = sorted({label for _, label in places})
                found = []
                if matches:
                    first, end = word_places(x)
                    a = char_places(x, first[np.array([m[0] for m in matches])]).tolist()
                    b = char_places(x, end[np.array([m[1] for m in matches]) - 1]).tolist()
                    found = [
                        {"first_word": m[0], "end_word": m[1], "start": s, "end": e, "label": m[2], "score": m[3]} for m, s, e in zip(matches, a, b, strict=True)
                    ]
                rows.append(
                    {
                        "n_words": n, "n_base": len(places), "first_word": min((p for p, _ in places), default=None),
                        "last_word": max((p for p, _ in places), default=None), "base_labels": base,
                        "labels": sorted({*base, *(m[2] for m in matches)}), "matches": found,
                        "score": max((m[3] for m in matches), default=PHRASE_SCORE if places else 0.0),
                    }
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, work])

    return docs.mapInArrow(scan, schema).withColumnRenamed(work, into)
