"""License scans by template-markup matching.

Templates are license texts with the public SPDX markup: ``<<beginOptional>> ... <<endOptional>>`` may be missing,
``<<var;name=...;match=N>>`` stands for up to N words. Each template is compiled into an automaton over words; it
accepts where all mandatory words stand exactly and in order, whatever case, punctuation and line breaks are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels: places where the words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed texts, whole, of well-known public licenses in SPDX template markup; the two disclaimers stand in several.
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL <<var;name="holder";match=10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
    THE SOFTWARE."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=10>> "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";match=10>> BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """<<beginOptional>>Copyright <<var;name="copyright";match=20>><<endOptional>>
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<var;name="marker";match=1>> Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. <<var;name="marker";match=1>>
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_ADVERTISING = """<<var;name="marker";match=1>> All advertising materials mentioning features or use of this software
    must display the following acknowledgement: This product includes software developed by
    <<var;name="organization";match=16>>"""
_BSD_NAMES = """<<var;name="marker";match=1>> Neither the name of <<var;name="organization";match=16>> nor the names of its
    contributors may be used to endorse or promote products derived from this software without specific prior written
    permission."""
TEMPLATES = {
    "BSD-2-Clause": f"{_BSD_TWO} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_TWO} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "BSD-4-Clause": f"{_BSD_TWO} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "ISC": """<<beginOptional>>Copyright <<var;name="copyright";match=20>><<endOptional>>
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose
        with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";match=6>> DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name="holder";match=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": f"""<<beginOptional>>MIT License<<endOptional>>
        <<beginOptional>>Copyright <<var;name="copyright";match=20>><<endOptional>> Permission is hereby granted, free of
        charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
        portions of the Software. {_MIT_DISCLAIMER}""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
        laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
        domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law. {_MIT_DISCLAIMER}
        <<beginOptional>>For more information, please refer to <<var;name="url";match=6>><<endOptional>>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: <<var;name="marker";match=1>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required.
        <<var;name="marker";match=1>> Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. <<var;name="marker";match=1>> This notice may not be removed or
        altered from any source distribution.""",
}


def _gnu_notice(kind: str, version: str) -> str:
    """The public notice that puts a work under a GNU license, this version or a later one."""
    return f"""you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the
        Free Software Foundation, either version {version} of the License, or (at your option) any later version.
        <<var;name="work";match=6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License
        for more details. <<beginOptional>>You should have received a copy of the GNU {kind} Public License along with
        <<var;name="work";match=6>> If not, see <<var;name="url";match=6>><<endOptional>>"""


#: Fixed texts: notices, which name a license without being one. Whole notices of the Apache and GNU licenses, and the
#: lines by which documents usually say under what they stand.
NOTICES = {
    "AGPL-3.0-or-later": _gnu_notice("Affero General", "3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;name="url";match=8>> Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "Apache-2.0-line": """<<beginOptional>>licensed under the<<endOptional>> Apache License
        <<beginOptional>>version<<endOptional>> 2.0""",
    "CC-BY-NC-4.0-line": """licensed under <<beginOptional>>a<<endOptional>> CC BY NC 4.0""",
    "CC-BY-NC-4.0-name": """creative commons attribution noncommercial 4.0 <<beginOptional>>international<<endOptional>>
        license""",
    "GPL-2.0-or-later": _gnu_notice("General", "2"),
    "GPL-3.0-or-later": _gnu_notice("General", "3"),
    "GPL-line": """<<beginOptional>>this <<var;name="thing";match=3>> is<<endOptional>> licensed under the
        <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License
        <<beginOptional>>version <<var;name="version";match=2>><<endOptional>>""",
    "LGPL-2.1-or-later": _gnu_notice("Lesser General", "2.1"),
    "LGPL-3.0-or-later": _gnu_notice("Lesser General", "3"),
    "MIT-line": """<<beginOptional>>released<<endOptional>> under the MIT License""",
    "all-rights-reserved": """<<beginOptional>>copyright <<var;name="holder";match=8>> <<endOptional>> All rights reserved""",
}
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of ASCII-lower-cased UTF-8
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;[^>]*?match=(\d+)[^>]*)?>>")


def words(text: bytes | None) -> list[bytes]:
    """Words of A-Z-lower-cased UTF-8: ASCII letters and digits and everything beyond ASCII."""
    return _WORD.findall((text or b"").lower())


def parse(template: str) -> list:
    """Markup as a tree: words (bytes), ``("var", n)`` and ``("optional", [...])``."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += words(template[at : m.start()].encode())
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("var", int(m[2] or 0)))
    stack[-1] += words(template[at:].encode())
    if len(stack) != 1:
        raise ValueError("optional regions are not closed")
    return stack[0]


@dataclass
class Automaton:
    """States 0..n; ``step[s]`` holds (word or None for any word, next state), ``free[s]`` moves without a word."""

    step: list[list[tuple[bytes | None, int]]]
    free: list[list[int]]
    final: int
    mandatory: list[bytes]

    @classmethod
    def of(cls, template: str) -> Automaton:
        a = cls([[]], [[]], 0, [])

        def state() -> int:
            a.step.append([])
            a.free.append([])
            return len(a.step) - 1

        def build(nodes: list, s: int, needed: bool) -> int:
            for node in nodes:
                if isinstance(node, bytes):
                    n = state()
                    a.step[s].append((node, n))
                    if needed:
                        a.mandatory.append(node)
                elif node[0] == "var":
                    n = state()
                    for _ in range(node[1]):
                        k = state()
                        a.free[s].append(n)
                        a.step[s].append((None, k))
                        s = k
                    a.free[s].append(n)
                else:
                    inner = build(node[1], s, False)
                    n = state()
                    a.free[inner].append(n)
                    a.free[s].append(n)
                s = n
            return s

        a.final = build(parse(template), 0, True)
        if not a.mandatory:
            raise ValueError("a template needs a mandatory word")
        return a

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in states:
                    states.add(n)
                    todo.append(n)
        return states

    def firsts(self) -> set[bytes] | None:
        """Words that a match can begin with; None: any."""
        w = {word for s in self._closed({0}) for word, _ in self.step[s]}
        return None if None in w else w

    def longest(self, text: list[bytes], start: int) -> int:
        """End of the longest match that begins at ``start``; ``start`` itself if there is none."""
        now, end, i = self._closed({0}), start, start
        while now and i < len(text):
            now = self._closed({n for s in now for word, n in self.step[s] if word is None or word == text[i]})
            i += 1
            if self.final in now:
                end = i
        return end


class Scanner:
    """Phrases and automata over one text at a time."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: Automaton.of(t) for label, t in templates.items()}
        # Long words first: they are the ones that other texts lack.
        self.needed = {label: sorted(set(a.mandatory), key=len, reverse=True) for label, a in self.automata.items()}
        self.firsts = {label: a.firsts() for label, a in self.automata.items()}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]

    def __call__(self, raw: bytes | None) -> tuple:
        low = (raw or b"").lower()
        text = _WORD.findall(low)
        starts: list[int] = []
        base: set[str] = set()
        spans: list[tuple[str, int, int]] = []
        present: dict[bytes, bool] = {}

        def has(word: bytes) -> bool:
            if word not in present:
                present[word] = word in low
            return present[word]

        for phrase, label in self.phrases:
            if all(map(has, phrase)):
                n, last = len(phrase), phrase[-1]
                found = [
                    i - n + 1 for i, w in enumerate(text) if w == last and i >= n - 1 and text[i - n + 1 : i + 1] == phrase
                ]
                starts += found
                base |= {label} if found else set()
        for label, a in self.automata.items():
            if all(map(has, self.needed[label])):
                begins, at = self.firsts[label], 0
                for i, w in enumerate(text):
                    if i >= at and (begins is None or w in begins):
                        end = a.longest(text, i)
                        if end > i:
                            spans.append((label, i, end))
                            at = end
        return len(text), starts, sorted(base), spans


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``; one row per input row.

    ``spans`` lists ``(label, start, end)`` of every longest template match in words; matches of one template do not
    overlap. ``score`` is 1 where a whole license (``templates``) matches, else 0.75 where a notice does (labels differ
    from those of ``templates``), else 0.5 where a phrase stands, else 0. Null and empty texts have no words and no
    labels; texts of any length are read whole; an empty table gives no rows.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    templates, phrases, notices = (given if given is not None else fixed for given, fixed in
                                   ((templates, TEMPLATES), (phrases, PHRASES), (notices, NOTICES)))
    if set(templates) & set(notices):
        raise ValueError(f"labels of both a license and a notice: {sorted(set(templates) & set(notices))}")
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner({**templates, **notices}, phrases)
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in b.column(1):
                n, starts, base, spans = scanner(t.as_py())
                labels = sorted({*base, *(s[0] for s in spans)})
                row = (
                    n,
                    len(starts),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(base),
                    ",".join(labels),
                    1.0 if any(s[0] in templates for s in spans) else 0.75 if spans else 0.5 if base else 0.0,
                    [dict(zip(("label", "start", "end"), s)) for s in spans],
                )
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(
                arrays,
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(
        run,
        f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label: string, start: long, end: long>>",
    )


def to_regex(template: str) -> str:
    """The same template as a regular expression over words that are each followed by a blank."""

    def build(nodes: list) -> str:
        parts = []
        for node in nodes:
            if isinstance(node, bytes):
                parts.append(f"{node.decode()} ")
            elif node[0] == "var":
                parts.append("(?:[^ ]+ ){0,%d}" % node[1])
            else:
                parts.append(f"(?:{build(node[1])})?")
        return "".join(parts)

    return f"(?:^| ){build(parse(template))}"
