"""License scans: templates with optional and replaceable regions, compiled to token automata.

A template is wording in which ``<<beginOptional>> ... <<endOptional>>`` (nested at will) may be absent and
``<<var;min=A;max=B>>`` stands for A to B words of any kind.  Compiled, it is an automaton over words: a state
for each place of the wording, a step for its word, free steps around optional regions, and counted
steps of any word for replaceable ones.  A text is accepted where all mandatory words stand in order with
nothing but such regions between them.  White space, case and punctuation don't matter.

Fixed phrases (``BASE``) are sought the same way: they're templates without regions.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map, texts, values

#: Words: runs of digits, letters a-z and everything beyond ASCII; in UTF-8 those are bytes from 0x80.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# The wording of well-known licences and of the notices that name them, with the markup above.
TEMPLATES = {
    "apache-2.0": "<<beginOptional>>this <<var;min=1;max=3>> is <<endOptional>>licensed under the Apache License <<beginOptional>>version<<endOptional>> 2 0",
    "mit": "<<beginOptional>>this <<var;min=1;max=3>> is <<endOptional>>released under the <<beginOptional>>terms of the<<endOptional>> MIT license",
    "gpl-3.0": "<<beginOptional>>this <<var;min=1;max=3>> is <<endOptional>>licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>",
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY <<beginOptional>>version<<endOptional>> 4 0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY NC <<beginOptional>>version<<endOptional>> 4 0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY SA <<beginOptional>>version<<endOptional>> 4 0",
    "copyright-notice": "copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=8>> all rights reserved",
    "mit-text": """<<beginOptional>>The MIT License <<beginOptional>>MIT<<endOptional>><<endOptional>> <<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc-text": """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>>
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;min=1;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "bsd-text": """<<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>>
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3<<endOptional>> Neither the name of <<var;min=1;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.<<endOptional>>
        THIS SOFTWARE IS PROVIDED BY <<var;min=1;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE""",
    "zlib-text": """<<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>>
        This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;min=1;max=4>> be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
        for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE <<beginOptional>>For more information, please refer to <<var;min=1;max=1>> unlicense org<<endOptional>>""",
    "apache-2.0-notice": """<<beginOptional>>Copyright <<beginOptional>>c<<endOptional>> <<var;min=1;max=20>><<endOptional>>
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;min=1;max=2>> except in compliance with the License. You may obtain a copy of the License at
        <<var;min=1;max=9>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License""",
    "gpl-notice": """This <<var;min=1;max=3>> is free software: you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>>
        General Public License as published by the Free Software Foundation, either version <<var;min=1;max=2>> of the License, or (at your option) any later version.
        This <<var;min=1;max=3>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License for more details.
        You should have received a copy of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License along with this <<var;min=1;max=3>> If not, see
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www gnu org licenses""",
}
MARK = re.compile(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>|([0-9A-Za-z]+)")
ANY = b""


class Automaton:
    """Steps of one template: ``steps[state][word]`` and ``steps[state][ANY]`` are next states, ``free[state]``
    those that need no word; the last state accepts."""

    def __init__(self, template: str):
        self.steps: list[dict[bytes, int]] = [{}]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []

        def state() -> int:
            self.steps.append({})
            self.free.append([])
            return len(self.steps) - 1

        for m in MARK.finditer(template):
            now = len(self.steps) - 1
            if m[4]:
                self.steps[now][m[4].lower().encode()] = state()
            elif m[1] == "beginOptional":
                opened.append(now)
                self.free[now].append(state())
            elif m[1] == "endOptional":
                end = state()
                self.free[now].append(end)
                self.free[opened.pop()].append(end)
            else:
                end_of = []
                for k in range(int(m[3])):
                    if k >= int(m[2]):
                        end_of.append(len(self.steps) - 1)
                    last = len(self.steps) - 1
                    self.steps[last][ANY] = state()
                end = len(self.steps) - 1
                for s in end_of:
                    self.free[s].append(end)
        if opened or re.search("<<|>>", MARK.sub("", template)):
            raise ValueError(f"markup that isn't closed or known: {template!r}")
        self.last = len(self.steps) - 1
        self.start = self.closed({0})
        if self.last in self.start:
            raise ValueError(f"no mandatory word: {template!r}")
        self.first = {w for s in self.start for w in self.steps[s]}
        #: A word that every accepted text has: at a state that can't be gone around, the only step.
        self.anchor = max((w for w in {w for s in self.steps for w in s if w} if not self.reaches_without(w)), key=len, default=ANY)

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def reaches_without(self, word: bytes) -> bool:
        todo, seen = list(self.start), set(self.start)
        while todo:
            s = todo.pop()
            for t in [*self.free[s], *(t for w, t in self.steps[s].items() if w != word)]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return self.last in seen

    def longest(self, words: list[bytes], at: int) -> int:
        """Where the longest accepted run of words from ``at`` on ends (-1: none)."""
        states, end = self.start, -1
        for i in range(at, len(words)):
            states = self.closed({t for s in states for t in (self.steps[s].get(words[i]), self.steps[s].get(ANY)) if t is not None})
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Leftmost, longest, without overlap."""
        found, at = [], 0
        anywhere = ANY in self.first
        while at < len(words):
            end = self.longest(words, at) if anywhere or words[at] in self.first else -1
            if end > 0:
                found.append((at, end))
            at = max(at + 1, end)
        return found


@cache
def automata(items: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(template)) for label, template in items]


IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class _Scan:
    def __init__(self, id_col, text_col, base, templates):
        self.id_col, self.text_col, self.base, self.templates = id_col, text_col, tuple(base.items()), tuple(templates.items())

    def __call__(self, batch: pa.RecordBatch) -> dict:
        base, templates = [(k, tuple(v.encode().split())) for k, v in self.base], automata(self.templates)
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for text in texts(batch, self.text_col):
            low = text.encode().lower()  # of bytes: A-Z alone
            likely = [(k, p) for k, p in base if all(w in low for w in p)]
            probable = [(k, a) for k, a in templates if a.anchor in low]
            mark = IS_WORD[np.frombuffer(low, dtype=np.uint8)]
            n = int(np.count_nonzero(mark[1:] > mark[:-1]) + (mark.size and mark[0]))
            places, named, spans, words = [], set(), [], []
            if likely or probable:
                words = WORD.findall(low)
            for label, phrase in likely:
                at = [i for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
                places += at
                spans += [(label, i, i + len(phrase)) for i in at]
                named |= {label} if at else set()
            base_labels = ",".join(sorted(named))
            for label, a in probable:
                found = a.spans(words)
                spans += [(label, i, j) for i, j in found]
                named |= {label} if found else set()
            covered = set().union(*(range(i, j) for _, i, j in spans))
            out["n_words"].append(n)
            out["n_base"].append(len(places))
            out["first_word"].append(min(places, default=None))
            out["last_word"].append(max(places, default=None))
            out["base_labels"].append(base_labels)
            out["labels"].append(",".join(sorted(named)))
            out["score"].append(len(covered) / n if n else 0.0)
            out["spans"].append([{"label": k, "first": i, "end": j} for k, i, j in sorted(spans, key=lambda s: (s[1], s[2], s[0]))])
        return {self.id_col: values(batch, self.id_col), **out}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row out for each row in, no shuffle: ``n_words``, ``n_base`` (places of ``base`` phrases, overlaps
    and repeats counted), ``first_word`` and ``last_word`` (least and greatest of those places, else null),
    ``base_labels``, ``labels`` (with those of ``templates``; distinct, sorted, comma-joined, else empty),
    ``score`` (share of the text's words inside any match) and ``spans`` (label, first word, end).

    Null and empty texts have no words, empty labels and score 0.  Repeated rows come out repeated.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,end:bigint>>"
    return arrow_map(df.select(id_col, text_col), _Scan(id_col, text_col, BASE if base is None else base, TEMPLATES if templates is None else templates), schema, text_col)
