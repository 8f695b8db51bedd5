"""Licence scans: word windows compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: A-Z lower-cased, words of letters, digits, dots and plus signs. A segment is a
run of consecutive words anywhere in the text; it may start and end inside a line or span lines. The Dice coefficient of a
segment with a words' bigrams (as multisets) and a template with b is at most 2 min(a, b) / (a + b), which bounds a. The
best segment begins and ends with a bigram of the template (else a shorter one is better), so only such are compared, and
only where enough of the template's bigrams stand within its bound. The templates are a fixed, bounded list.

A template whose name ends in a version that its text holds fits only where that version stands in the segment or is the
word after it, so that a notice of a version without a template is not taken for another version. Variants (CC BY-ND, Lesser,
Affero) have templates of their own, of which the better one counts. The sentence that all BSD texts share is reported as
BSD, the family, where no whole BSD text fits around it.

Defined cases: null and empty texts hold no licence. A segment inside one that fits another template better does not count
(the first words of a CC BY-SA notice are most of a CC BY one). Of several segments the best counts for each licence; ties
go to the first. Texts of any length are scanned whole. Repeated rows are judged each; a null doc_id stays null. Other
columns may have any names; empty tables give none. The templates hold the full texts of the short licences and the usual
notices of the long ones, whose full texts are seldom in a document, and of CC licences from version 2.0 on; further texts can be
passed as a parameter. "text" in a name means the whole licence, "notice" and "header" its opening or usual notice.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+(?:[.+][a-z0-9]+)*\+?")
#: Licence texts and notices, as the licences or common practice word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS "
        "IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
        "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN "
        "NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution."
    ),
    "Unlicense notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0 notice": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."
    ),
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
        "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication "
        "to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, "
        "please refer to https://unlicense.org/"
    ),
    "BSL-1.0 text": (
        "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
for _name, _words, _work, _version in (
    ("GPL-3.0", "", "program", "3"), ("GPL-2.0", "", "program", "2"), ("LGPL-3.0", "Lesser ", "library", "3"), ("LGPL-2.1", "Lesser ", "library", "2.1"),
    ("LGPL-2.0", "Library ", "library", "2"), ("AGPL-3.0", "Affero ", "program", "3"),
):
    TEMPLATES[_name] = f"This work is licensed under the GNU {_words}General Public License, version {_version}."
    TEMPLATES[f"{_name} header"] = (
        f"This {_work} is free software: you can redistribute it and/or modify it under the terms of the GNU {_words}General Public License as published by the Free Software Foundation, "
        f"either version {_version} of the License, or (at your option) any later version."
    )
for _part, _words in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        TEMPLATES[f"CC-{_part}-{_version}"] = f"Licensed under CC {_part} {_version}."
    for _version, _port in (("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_part}-{_version} notice"] = f"This work is licensed under a Creative Commons {_words} {_version} {_port} License."
#: Sentences that several licences share; the name is that of the family.
FAMILIES = {"BSD"}
VERSION = re.compile(r"v?(\d+(?:\.\d+)*)\+?")
MIN_DICE = 0.8


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)})


def normal_words(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def version_of(word: str) -> str | None:
    """The version that a word is: 3 for 3, v3, 3+ and 3.0."""
    found = VERSION.fullmatch(word)
    return found and re.sub(r"(\.0)+$", "", found[1])


class Templates:
    def __init__(self, texts: dict[str, str] = TEMPLATES, min_dice: float = MIN_DICE):
        self.min_dice = min_dice
        self.grams = {name: bigrams(normal_words(t)) for name, t in texts.items()}
        self.sizes = {name: g.total() for name, g in self.grams.items()}
        #: the templates that hold a bigram
        self.known: dict[tuple[str, str], list[str]] = {}
        #: the version that a segment must hold, of templates that hold the one in their name
        ends = {name: re.search(r"-(\d+(?:\.\d+)+)(?: |$)", name) for name in texts}
        self.version = {name: version_of(end[1]) for name, end in ends.items() if end and version_of(end[1]) in map(version_of, normal_words(texts[name]))}
        for name, grams in self.grams.items():
            for gram in grams:
                self.known.setdefault(gram, []).append(name)
        #: a segment with fewer bigrams of the template, or of more bigrams in all, does not fit it
        self.least = {name: max(1, math.ceil(n * min_dice / (2 - min_dice) - 1e-9)) for name, n in self.sizes.items()}
        self.most = {name: n * (2 - min_dice) / min_dice + 1e-9 for name, n in self.sizes.items()}

    def fits(self, name: str, at: list[int], words: list[str], versions: dict[str, list[int]]) -> Iterator[tuple[float, int, int]]:
        """Dice coefficient, first and last bigram of the best segment from every start; at: where the template's bigrams stand.

        The bigrams in common with the longest segment from a start bound those with all others from there; they are counted
        as the window moves, so that starts that cannot fit cost a step each."""
        grams, n, least, most = self.grams[name], self.sizes[name], self.least[name], self.most[name]
        marks = versions.get(self.version[name], []) if name in self.version else None
        held, shared, ahead, mark = Counter(), 0, 0, 0
        for p, first in enumerate(at):
            while ahead < len(at) and at[ahead] - first + 1 <= most:
                gram = words[at[ahead]], words[at[ahead] + 1]
                held[gram] += 1
                shared += held[gram] <= grams[gram]
                ahead += 1
            fits = shared >= least
            gram = words[first], words[first + 1]
            shared -= held[gram] <= grams[gram]
            held[gram] -= 1
            if marks is not None:
                while mark < len(marks) and marks[mark] < first:
                    mark += 1
                fits = fits and mark < len(marks)
            if not fits:
                continue
            enough = first if marks is None else marks[mark] - 2
            best, end, common, seen = 0.0, first, 0, Counter()
            for q in range(p, ahead):
                last = at[q]
                gram = words[last], words[last + 1]
                seen[gram] += 1
                common += seen[gram] <= grams[gram]
                if last >= enough and (dice := 2 * common / (n + last - first + 1)) > best:
                    best, end = dice, last
                    if best == 1:
                        break
            if best >= self.min_dice:
                yield best, first, end

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Licence, Dice coefficient, first line and number of lines of its best segment, for every licence found."""
        words = normal_words(text or "")
        stand: dict[str, list[int]] = {}
        for i, names in enumerate(map(self.known.get, zip(words, words[1:]))):
            for name in names or ():
                stand.setdefault(name, []).append(i)
        versions: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            if (word[0].isdigit() or word[0] == "v") and (version := version_of(word)):
                versions.setdefault(version, []).append(i)
        found = sorted((first, last, dice, name) for name, at in stand.items() if len(at) >= self.least[name] for dice, first, last in self.fits(name, at, words, versions))
        if not found:
            return []
        longest = max(self.most.values())
        best: dict[str, tuple[float, int, int]] = {}
        for first, last, dice, name in sorted(found, key=lambda x: (-x[2], x[0])):
            if name in best:
                continue
            near = found[bisect_left(found, (first - longest,)) : bisect_left(found, (first + 1,))]
            if not any(f <= first and e >= last and other != name and (d > dice or (name in FAMILIES and self.sizes[other] > self.sizes[name])) for f, e, d, other in near):
                best[name] = dice, first, last
        starts = [m.start() for m in WORD.finditer(lowered(text))]
        out = []
        for name, (dice, first, last) in best.items():
            begin = starts[first]
            out.append((name, dice, text.count("\n", 0, begin), text.count("\n", begin, starts[last + 1]) + 1))
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_dice: float = MIN_DICE) -> DataFrame:
    """One row per document and licence found: doc_id, licence, dice, first_line, n_lines; a document without any has one row of nulls."""
    held = Templates(templates, min_dice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [(doc_id, *x) for doc_id, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in held.scan(t) or [(None, None, None, None)]]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "licence", "dice", "first_line", "n_lines"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, licence string, dice double, first_line int, n_lines int")
