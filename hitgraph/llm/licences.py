"""License scans: licence templates with optional and replaceable regions, compiled into token automata.

Template markup, in the text of a template:
``<<beginOptional>> .. <<endOptional>>`` may be there or not (regions nest);
``<<var;least=1;most=12>>`` stands for that many words of any kind.
All other words are mandatory and must stand there, in order, exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import util

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IS_WORD = np.array([b >= 128 or 48 <= b < 58 or 97 <= b < 123 for b in range(256)])

#: Phrases whose places count as base finds.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>
shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;least=1;most=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_THIRD = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;least=1;most=12>> nor the names of
<<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;least=1;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL <<var;least=1;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;least=1;most=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;least=1;most=12>> BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""


def _gnu_notice(name: str) -> str:
    """The notice that a program's files bear under a licence of this name."""
    return f"""is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of
        the {name} as published by the Free Software Foundation, either version <<var;least=1;most=3>> of the License, or
        (at your option) any later version. <<var;least=1;most=8>> distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
        the {name} for more details. You should have received a copy of the {name} along with <<var;least=1;most=8>> If
        not, <<beginOptional>>see<<endOptional>> <<var;least=1;most=16>>"""


#: label: template.  Licence wording is fixed by the licences.
TEMPLATES = {
    "mit": f"{_MIT} {_MIT_END}",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    "isc-full": f"{_ISC} {_ISC_END}",
    "gpl-full-notice": _gnu_notice("GNU General Public License"),
    "lgpl-full-notice": _gnu_notice("GNU Lesser General Public License"),
    "agpl-full-notice": _gnu_notice("GNU Affero General Public License"),
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at <<var;least=1;most=8>>""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not
        claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at <<var;least=1;most=12>> Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "cc-by-deed": """This work is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative
        Commons Attribution <<var;least=0;most=4>> International License""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not
        use this file except in compliance with the License. You may obtain a copy of the License at
        <<var;least=1;most=12>> Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied.<<endOptional>>""",
    "gpl-2.0": "licensed under the GNU General Public License<<beginOptional>>, as published by the Free Software Foundation<<endOptional>>, version 2",
    "gpl-3.0": "licensed under the GNU General Public License<<beginOptional>>, as published by the Free Software Foundation<<endOptional>>, version 3",
    "gpl-notice": """redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>>
        <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation;
        either version <<var;least=1;most=2>> of the License, or (at your option) any later version""",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "agpl": "licensed under the GNU Affero General Public License",
    "cc-by-4.0": "licensed under CC BY 4.0",
    "cc-by-nc-4.0": "licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "licensed under CC BY-SA 4.0",
    "cc-by-long": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution <<var;least=0;most=4>> License",
    "mit-notice": "<<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> <<beginOptional>>Distributed<<endOptional>> under the MIT License",
    "mit-text": _MIT,
    "bsd": _BSD,
    "isc": _ISC,
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "spdx": "SPDX-License-Identifier: <<var;least=1;most=1>>",
}


@dataclass
class Automaton:
    """States 0..n-1; step[s]: word -> states; any_[s]: states by any word.  Closure over empty moves is built in."""

    step: list[dict[bytes, set[int]]] = field(default_factory=list)
    wild: list[set[int]] = field(default_factory=list)
    empty: list[set[int]] = field(default_factory=list)
    accept: dict[int, str] = field(default_factory=dict)
    first: dict[bytes, list[int]] = field(default_factory=dict)
    closed: list[frozenset[int]] = field(default_factory=list)

    def state(self) -> int:
        self.step.append(defaultdict(set))
        self.wild.append(set())
        self.empty.append(set())
        return len(self.step) - 1

    def add(self, template: str, label: str) -> int:
        at = begin = self.state()
        opened: list[int] = []
        for part in re.split(r"(<<.*?>>)", template):
            if part.startswith("<<beginOptional"):
                opened.append(at)
            elif part.startswith("<<endOptional"):
                if not opened:
                    raise ValueError("an optional region ends that did not begin")
                new = self.state()
                self.empty[at].add(new)
                self.empty[opened.pop()].add(new)
                at = new
            elif part.startswith("<<var"):
                has = dict(x.split("=") for x in part[2:-2].split(";")[1:])
                least, most = int(has.get("least", 1)), int(has.get("most", 8))
                out = self.state()
                for k in range(most + 1):
                    if k >= least:
                        self.empty[at].add(out)
                    if k < most:
                        new = self.state()
                        self.wild[at].add(new)
                        at = new
                at = out
            else:
                for w in words(part):
                    new = self.state()
                    self.step[at][w].add(new)
                    at = new
        if opened:
            raise ValueError("an optional region does not end")
        self.accept[at] = label
        return begin

    def close(self, begins: list[int]) -> Automaton:
        for s in range(len(self.step)):
            seen, todo = {s}, [s]
            while todo:
                for t in self.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closed.append(frozenset(seen))
        firsts: dict[bytes, set[int]] = defaultdict(set)
        for b in begins:
            for s in self.closed[b]:
                if s in self.accept or self.wild[s]:
                    raise ValueError("a template must begin with a mandatory word")
                for w, to in self.step[s].items():
                    for t in to:
                        firsts[w] |= self.closed[t]
        self.first = {w: sorted(v) for w, v in firsts.items()}
        return self

    def run(self, first: bytes, rest: Iterator[bytes]) -> set[str]:
        """Labels of the templates that a prefix of the words satisfies."""
        live: set[int] = set(self.first.get(first, ()))
        found: set[str] = set()
        while live:
            found |= {self.accept[s] for s in live if s in self.accept}
            w = next(rest, None)
            if w is None:
                break
            live = {u for s in live for t in (self.step[s].get(w, set()) | self.wild[s]) for u in self.closed[t]}
        return found


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(util.ASCII_LOWER))


def compile_templates(templates: dict[str, str]) -> Automaton:
    out = Automaton()
    return out.close([out.add(t, label) for label, t in templates.items()])


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: words, places of base phrases, labels of base phrases and accepted templates.

    Null and empty texts have no words and no labels; repeated rows give repeated rows; null ids stay null.
    score is 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    Texts are read whole, one Arrow batch at a time, without a shuffle.
    """
    base = BASE if base is None else base
    templates = TEMPLATES if templates is None else templates

    def kernel(batches):
        auto = compile_templates({f"base:{v}": k for k, v in base.items()} | {f"more:{k}": t for k, t in templates.items()})
        anchors = re.compile(b"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, auto.first), key=len, reverse=True)) + b")(?![0-9a-z\x80-\xff])")
        for rb in util.slices(batches, "text"):
            raw, off = util.buffers(rb.column("text"))
            low, off = util.separated(raw, off, lower=True)
            inside = _IS_WORD[np.frombuffer(low, np.uint8)]
            starts, _ = util.starts_ends(inside, off)
            n = len(off) - 1
            first_of = np.searchsorted(starts, off)
            n_words = np.diff(first_of)
            n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
            tags: list[set[str]] = [set() for _ in range(n)]
            for m in anchors.finditer(low):
                d = int(np.searchsorted(off, m.start(), side="right")) - 1
                found = auto.run(m.group(), (x.group() for x in _WORD.finditer(low, m.end(), int(off[d + 1]))))
                tags[d] |= found
                hits = sum(x.startswith("base:") for x in found)
                if hits:
                    k = int(np.searchsorted(starts, m.start()) - first_of[d])
                    n_base[d] += hits
                    first[d] = k if first[d] is None else first[d]
                    last[d] = k
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rb.column("doc_id").cast(pa.int64()),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_base": pa.array(n_base, pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base_labels": pa.array([",".join(sorted({x[5:] for x in t if x[:5] == "base:"})) for t in tags], pa.string()),
                    "labels": pa.array([",".join(sorted({x[5:] for x in t})) for t in tags], pa.string()),
                    "score": pa.array([1.0 if any(x[:5] == "more:" for x in t) else 0.5 if t else 0.0 for t in tags], pa.float64()),
                }
            )

    util.ship(docs.sparkSession)
    return util.need(docs, "doc_id", "text").mapInArrow(kernel, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
