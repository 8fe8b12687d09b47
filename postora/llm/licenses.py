"""Licence notices and texts by template matching.

A template is mandatory words with optional regions, `<<optional>> ... <<end>>`, and replaceable ones, `<<any:N>>` (up
to N words of any kind, none included) or `<<one:regex>>` (a word that the regex matches whole). It is compiled to an
automaton over words; a text holds the licence where the automaton accepts words that stand consecutively. Texts are
scanned a block at a time for places where two words that can open a template stand together, by word hash; automata
run from those places only.

Of templates accepted from one place only those count that accept most words: a notice that goes on with "or any later
version" isn't that of the version alone, and three clauses aren't two. Base phrases, whole words in sequence, are
counted as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postora.llm import text as tx
from postora.llm.frames import free, in_small_batches

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public licences and of their usual notices, by SPDX identifier in lower case.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<optional>>THE<<end>> <<any:6>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<any:8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:8>> BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = "free software <<optional>>you can<<end>> redistribute it and/or modify it under the terms of the GNU"
_PUBLISHED = "General Public License as published by the Free Software Foundation <<optional>>either<<end>> version"
_LATER = "of the License or (at your option) any later version"
_TERMS = "licensed under the <<optional>>terms of the<<end>> GNU General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version"
TEMPLATES = {
    "gpl-2.0-only": [f"{_TERMS} 2 <<optional>>0<<end>> <<optional>>only<<end>>", f"{_GNU} {_PUBLISHED} 2 of the License <<optional>>only<<end>>"],
    "gpl-2.0-or-later": [f"{_TERMS} 2 <<optional>>0<<end>> or <<optional>>any<<end>> later <<optional>>version<<end>>", f"{_TERMS} 2 {_LATER}", f"{_GNU} {_PUBLISHED} 2 {_LATER}"],
    "gpl-3.0-only": [f"{_TERMS} 3 <<optional>>0<<end>> <<optional>>only<<end>>", f"{_GNU} {_PUBLISHED} 3 of the License <<optional>>only<<end>>"],
    "gpl-3.0-or-later": [f"{_TERMS} 3 <<optional>>0<<end>> or <<optional>>any<<end>> later <<optional>>version<<end>>", f"{_TERMS} 3 {_LATER}", f"{_GNU} {_PUBLISHED} 3 {_LATER}"],
    "lgpl-2.0-or-later": [f"{_GNU} Library {_PUBLISHED} 2 {_LATER}"],
    "lgpl-2.1-only": [f"{_GNU} Lesser {_PUBLISHED} 2.1 of the License"],
    "lgpl-2.1-or-later": [f"{_GNU} Lesser {_PUBLISHED} 2.1 {_LATER}"],
    "lgpl-3.0-or-later": [f"{_GNU} Lesser {_PUBLISHED} 3 {_LATER}"],
    "agpl-3.0-only": [f"{_GNU} Affero {_PUBLISHED} 3 of the License"],
    "agpl-3.0-or-later": [f"{_GNU} Affero {_PUBLISHED} 3 {_LATER}"],
    "apache-2.0": [
        "Licensed under the Apache License <<optional>>Version<<end>> 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at <<one:https?>> <<optional>>www<<end>> apache.org/licenses/LICENSE-2.0
        <<optional>>html<<end>> Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ],
    "mpl-2.0": [
        """subject to the terms of the Mozilla Public License, <<one:v|version>> 2.0 <<optional>>If a copy of the MPL was not distributed
        with this file, You can obtain one at <<one:https?>> <<optional>>www<<end>> mozilla.org/MPL/2.0<<end>>"""
    ],
    "mit": [
        "Released under the <<optional>>terms of the<<end>> MIT License",
        "Licensed under the <<optional>>terms of the<<end>> MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial
        portions of the Software. """ + _WARRANTY,
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""
    ],
    "0bsd": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
    ],
    "bsd-2-clause": [f"{_BSD} {_BSD_WARRANTY}"],
    "bsd-3-clause": [
        f"""{_BSD} <<optional>>3<<end>> Neither the name of <<any:12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. {_BSD_WARRANTY}"""
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
    ],
    "bsl-1.0": ["""Distributed under the Boost Software License, Version 1.0"""],
    "unlicense": ["""free and unencumbered software released into the public domain"""],
    "cc-by-4.0": ["<<optional>>is<<end>> licensed under <<optional>>a<<end>> CC BY 4.0"],
    "cc-by-sa-4.0": ["<<optional>>is<<end>> licensed under <<optional>>a<<end>> CC BY-SA 4.0"],
    "cc-by-nc-4.0": ["<<optional>>is<<end>> licensed under <<optional>>a<<end>> CC BY-NC 4.0"],
    "cc-by-nd-4.0": ["<<optional>>is<<end>> licensed under <<optional>>a<<end>> CC BY-ND 4.0"],
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(optional|end|any:\d+|one:.*?)>>")


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class Template:
    """An automaton over words. State s goes to s + 1 on its word or pattern; skips[s] are states reached without one.

    A template opens with two mandatory words after any optional regions, so that places can be looked up.
    """

    def __init__(self, markup: str) -> None:
        self.steps: list[str | re.Pattern | None] = []
        self.skips: dict[int, list[int]] = {}
        #: The same as a regular expression over words that each end in a blank.
        self.pattern = ""
        opened, at = [], 0
        for mark in [*_MARK.finditer(markup), None]:
            plain = _WORD.findall(_lower(markup[at : mark.start() if mark else None]))
            self.steps += plain
            self.pattern += "".join(f"{re.escape(w)} " for w in plain)
            if mark is None:
                break
            at, kind = mark.end(), mark[1]
            if kind == "optional":
                opened.append(len(self.steps))
                self.pattern += "(?:"
            elif kind == "end":
                self.skips.setdefault(opened.pop(), []).append(len(self.steps))
                self.pattern += ")?"
            elif kind.startswith("any:"):
                self.pattern += f"(?:[^ ]+ ){{0,{int(kind[4:])}}}"
                for _ in range(int(kind[4:])):
                    self.skips.setdefault(len(self.steps), []).append(len(self.steps) + 1)
                    self.steps.append(None)
            else:
                self.steps.append(re.compile(kind[4:]))
                self.pattern += f"(?:{kind[4:]}) "
        if opened:
            raise ValueError("an optional region isn't ended")
        if not all(isinstance(w, str) for pair in self.openings() for w in pair):
            raise ValueError("a template must open with two mandatory words")

    def closed(self, states: set[int]) -> set[int]:
        """States and all that skips reach from them."""
        found, todo = set(states), list(states)
        while todo:
            for t in self.skips.get(todo.pop(), ()):
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return found

    def openings(self) -> set[tuple]:
        """The pairs of words that an accepted text can begin with."""
        return {(self.steps[s], self.steps[t] if t < len(self.steps) else None) for s in self.closed({0}) if s < len(self.steps) for t in self.closed({s + 1})}

    def accepts(self, words: Iterator[str]) -> int:
        """How many of the words the longest accepted beginning has; 0 if there is none."""
        states, longest = self.closed({0}), 0
        for n, word in enumerate(words, 1):
            after = set()
            for s in states:
                if s < len(self.steps):
                    step = self.steps[s]
                    if step is None or (step == word if isinstance(step, str) else step.fullmatch(word)):
                        after.add(s + 1)
            if not after:
                break
            states = self.closed(after)
            if len(self.steps) in states:
                longest = n
        return longest


@dataclass
class Scanner:
    phrases: list[tuple[np.ndarray, list[bytes], str]]
    templates: list[tuple[Template, str, list[np.ndarray]]]


def _hash(words: list[str]) -> np.ndarray:
    return tx.words_of([" ".join(words).encode()], tx.PUNCTUATED).hashes()


def compiled(phrases: dict[str, str], templates: dict[str, list[str]]) -> Scanner:
    own = [(_hash(_WORD.findall(_lower(p))), [w.encode() for w in _WORD.findall(_lower(p))], label) for p, label in phrases.items()]
    made = [(t := Template(markup), label, [_hash(list(pair)) for pair in sorted(t.openings())]) for label, each in templates.items() for markup in each]
    return Scanner(own, made)


@cache
def _standard() -> Scanner:
    return compiled(PHRASES, TEMPLATES)


def _rows(scanner: Scanner | None, text: str, columns: list[str], out: str):
    kind = pa.struct([("words", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("covered", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner or _standard()
        for batch, texts in tx.blocks(batches, text):
            words = tx.words_of(texts, tx.PUNCTUATED, lower=True)
            hashes, last = words.hashes(), words.last()
            at: dict[int, list] = {}

            def places(wanted: np.ndarray) -> list[int]:
                if len(hashes) < len(wanted):
                    return []
                good = hashes[: len(hashes) - len(wanted) + 1] == wanted[0]
                for k in range(1, len(wanted)):
                    good &= hashes[k : len(hashes) - len(wanted) + 1 + k] == wanted[k]
                found = np.flatnonzero(good)
                return found[found + len(wanted) <= last[found]].tolist()

            for wanted, spelled, label in own.phrases:
                for i in places(wanted):
                    if all(words.word(i + k) == w for k, w in enumerate(spelled)):
                        at.setdefault(int(np.searchsorted(words.first, i, "right")) - 1, []).append((i, len(spelled), label, True))
            longest: dict[int, tuple[int, set[str]]] = {}
            for template, label, openings in own.templates:
                for wanted in openings:
                    for i in places(wanted):
                        n = template.accepts(words.word(j).decode("utf-8", "replace") for j in range(i, int(last[i])))
                        most, labels = longest.get(i, (1, set()))
                        if n >= most:
                            longest[i] = (n, {label} if n > most else labels | {label})
            for i, (n, labels) in longest.items():
                at.setdefault(int(np.searchsorted(words.first, i, "right")) - 1, []).extend((i, n, label, False) for label in labels)
            values = []
            for r, count in enumerate(words.counts().tolist()):
                found, begin = at.get(r, ()), int(words.first[r])
                base = [f for f in found if f[3]]
                held = {i - begin + k for i, n, _, _ in found for k in range(n)}
                starts = [f[0] - begin for f in base]
                values.append({"words": count, "base": len(base), "first": min(starts, default=None), "last": max(starts, default=None), "base_labels": sorted({f[2] for f in base}), "labels": sorted({f[2] for f in found}), "covered": len(held)})
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(values, kind)], names=[*columns, out])

    return rows


def scan(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those named) and license_found: words of the whole text, base (places of
    phrases), first and last (the least and greatest word that a phrase starts at, null without any), base_labels,
    labels (of phrases and templates, distinct, sorted) and covered (words within what was found).

    Words are runs of letters and digits of ASCII and of whatever isn't ASCII, lower-cased in A-Z. Overlapping places
    all count; of templates that accept equally many words from one place each counts. Null and empty texts have no
    words; texts of any length are scanned whole. Rows are judged one by one, so repeated rows fare alike. Other columns
    pass through; where docs has a column license_found, the result's has underscores before it. An empty table gives
    an empty one.
    """
    scanner = None if phrases is None and templates is None else compiled(phrases or {}, templates or {})
    columns = docs.columns if columns is None else columns
    needed = in_small_batches(docs).select(*dict.fromkeys([*columns, text]))
    out, names = free("license_found", docs.columns), [c for c in needed.columns if c in columns]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in needed.schema.fields if f.name in columns]
    found = "struct<words: long, base: long, first: long, last: long, base_labels: array<string>, labels: array<string>, covered: long>"
    return needed.mapInArrow(_rows(scanner, text, names, out), ", ".join([*fields, f"`{out}` {found}"]))
