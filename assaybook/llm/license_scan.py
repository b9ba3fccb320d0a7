"""License scan by conditional compression.

Candidate blocks for short notices are the lines, and the paragraphs of several
lines, that hold a cue word; for whole license texts, which go over several
paragraphs, overlapping stretches of the text that hold one. A block is compressed
alone and with each license template as a Zstandard raw dictionary. The bytes that
the dictionary saves rank the templates, so of license texts that share most of
their wording the one that explains most of the block comes first. The ranking
rejects none, as in long blocks zstd's own matches hide what a dictionary saves. All
that can hold are then confirmed on the wording, best saving first (of savings within ``TIE`` bytes, the one
with the fewest differences): the words of the
block are aligned with the template's, the differences are listed, and a template
stands only where nearly all of its words are there in order, its naming words
(license name and version) exactly, and no naming word of another license in
between. Confirmed words are taken out and the rest of the block is looked at again,
so a block may hold several notices; whole texts are taken out first, so their
sentences are not reported again as short notices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaybook.llm.common import table, text_or_empty

#: Least share of the template's words in order.
LEAST_WORDS = 0.8
#: A long block is looked at in parts of so many characters and an overlap that holds any notice.
PART, OVERLAP = 1500, 600

# Cue words (lower case) and the usual wording of license notices
CUES = ("licen", "copyright", "warrant", "permission", "redistribut", "cc by", "cc-by", "cc0", "public domain", "spdx")
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
}
NAMING = frozenset("mit apache bsd gnu general lesser affero mozilla cc cc0 by sa nc nd 1.0 2 2.0 2.1 3 3.0 4.0 "
                   "2-clause 3-clause hereby redistribution".split())


def _full_texts() -> dict[str, str]:
    """License texts and file headers as their licenses give them, from the passages that they share."""
    # Wording of public licenses
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
             "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
             "Software, and to permit persons to whom the Software is furnished to do so")
    notice = ("subject to the following conditions: The above copyright notice and this permission notice shall be included "
              "in all copies or substantial portions of the Software.")
    as_is = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
             "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
             "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
             "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
             "DEALINGS IN THE SOFTWARE.")
    source = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
              "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
              "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
              "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
              "materials provided with the distribution.")
    endorse = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
               "products derived from this software without specific prior written permission.")
    holders = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
               "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
               "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
               "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
               "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
               "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
               "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
    use = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted")
    appear = "provided that the above copyright notice and this permission notice appear in all copies"
    author = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
              "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
              "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
              "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
              "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
              "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
              "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
              "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
              "the specific language governing permissions and limitations under the License.")
    mozilla = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    gnu = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published "
           "by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This "
           "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
           "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have "
           "received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.")
    gpl = "General Public License"
    return {
        "MIT-full": f"{grant}, {notice} {as_is}", "MIT-0-full": f"{grant}. {as_is}",
        "BSD-2-Clause-full": f"{source} {holders}", "BSD-3-Clause-full": f"{source} {endorse} {holders}",
        "ISC-full": f"{use}, {appear}. {author}", "0BSD-full": f"{use}. {author}",
        "Apache-2.0-header": apache, "MPL-2.0-header": mozilla,
        "GPL-2.0-header": gnu.format(gpl, "2"), "GPL-3.0-header": gnu.format(gpl, "3"),
        "LGPL-2.1-header": gnu.format("Lesser " + gpl, "2.1"), "LGPL-3.0-header": gnu.format("Lesser " + gpl, "3"),
        "AGPL-3.0-header": gnu.format("Affero " + gpl, "3")}


FULL_TEXTS = _full_texts()
FULL_NAMING = frozenset("apache mozilla gnu lesser affero 2 2.0 2.1 3".split())
#: Savings that differ by no more bytes are a tie; the fewest differences in wording win it.
TIE = 12
#: Whole license texts are looked for in stretches of so many characters, with an overlap that holds any of them.
FULL_PART, FULL_OVERLAP = 3000, 2 * max(map(len, FULL_TEXTS.values()))

_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*(?:-clause)?|[^\W\d_]+[0-9]*", re.I)
_INK = re.compile(r"[^\n]")


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


class _Template:
    def __init__(self, name: str, text: str, alone: zstandard.ZstdCompressor, level: int, naming: frozenset[str]):
        """``naming``: words that must agree exactly; a text that holds none of them is told by its wording alone."""
        self.name, self.words = name, _words(text)[0]
        self.naming = naming.intersection(self.words)
        self.rivals = naming if self.naming else frozenset()
        self.vocabulary = set(self.words)
        raw = " ".join(self.words).encode()
        self.with_it = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(
            raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        self.own = max(1, self.saved(raw, len(alone.compress(raw))))

    def able(self, have: set[str]) -> bool:
        """Whether a block of the words ``have`` can be confirmed at all."""
        return self.naming <= have and len(self.vocabulary - have) <= (1 - LEAST_WORDS) * len(self.words)

    def saved(self, block: bytes, alone: int) -> int:
        """Bytes that the template saves on ``block``."""
        return alone - len(self.with_it.compress(block))

    def confirm(self, words: list[str]) -> tuple[int, int, list[str], list[str]] | None:
        """(first, last + 1, missing, added) of the template's wording in ``words``."""
        spans = [m for m in SequenceMatcher(None, self.words, words, autojunk=False).get_matching_blocks() if m.size]
        # leave out stray matches far from the densest stretch
        while spans and spans[-1].b + spans[-1].size - spans[0].b > 2 * len(self.words):
            spans.remove(min((spans[0], spans[-1]), key=lambda m: m.size))
        if not spans:
            return None
        kept = {i for m in spans for i in range(m.a, m.a + m.size)}
        missing = [w for i, w in enumerate(self.words) if i not in kept]
        first, last = spans[0].b, spans[-1].b + spans[-1].size
        held = {j for m in spans for j in range(m.b, m.b + m.size)}
        added = [words[j] for j in range(first, last) if j not in held]
        if len(kept) < LEAST_WORDS * len(self.words) or self.naming.intersection(missing) or self.rivals.intersection(added):
            return None
        return first, last, missing, added


class _Family:
    """Templates that are looked for in the same blocks."""

    def __init__(self, templates: dict[str, str], naming: frozenset[str], part: int, overlap: int, level: int):
        self.size, self.overlap = part, overlap
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.templates = [_Template(n, t, self.alone, level, naming) for n, t in templates.items()]

    def rank(self, able: list[_Template], words: list[str]) -> list[tuple[int, _Template]]:
        """(bytes saved, template), most bytes first. Compressed are the words in lower
        case, so that line breaks, comment marks and capitals hide no match."""
        raw = " ".join(words).encode()
        alone = len(self.alone.compress(raw)) if able else 0
        return sorted(((t.saved(raw, alone), t) for t in able), key=lambda x: -x[0])

    def block(self, block: str) -> list[dict]:
        """Confirmed notices of one block. Long blocks are looked at in
        overlapping parts, so the work grows with the length alone; a notice
        that begins in the overlap belongs to the next part."""
        found: list[dict] = []
        reach = 0  # end of the last notice
        for at in range(0, max(1, len(block) - self.overlap), self.size):
            last = at + self.size + self.overlap >= len(block)
            part = _without(block[at:at + self.size + self.overlap], [(0, max(0, reach - at))])
            for h in self.part(part):
                if last or h["start"] < self.size:
                    found += _moved([h], at)
                    reach = max(reach, found[-1]["stop"])
        return found

    def part(self, block: str) -> list[dict]:
        """Confirmed notices of one part, best saving first."""
        found: list[dict] = []
        while _has_cue(block):
            words, spans = _words(block)
            have = set(words)
            best = None
            for saved, t in self.rank([t for t in self.templates if t.able(have)], words):
                if best and saved < best[1] - TIE:
                    break
                if got := t.confirm(words):
                    differ = len(got[2]) + len(got[3])
                    if best is None or differ < best[0]:
                        best = differ, max(saved, best[1] if best else saved), saved, t, got
            if best is None:
                return found
            _, _, saved, t, (first, last, missing, added) = best
            found.append({"license": t.name, "start": spans[first][0], "stop": spans[last - 1][1],
                          "saving": round(saved / t.own, 6), "missing": missing, "added": added})
            block = _without(block, _spans(found[-1:]))  # look at the rest
        return found


class Scanner:
    """Compressors of all templates; one per task."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, full_texts: dict[str, str] = FULL_TEXTS):
        self.short = _Family(templates, NAMING, PART, OVERLAP, 3)
        self.full = _Family(full_texts, FULL_NAMING, FULL_PART, FULL_OVERLAP, 19)

    def text(self, text: str) -> list[dict]:
        """Notices of a whole text, by position; what a line shows is not
        reported again for its paragraph."""
        if not _has_cue(text):
            return []
        found, at, para = self.full.block(text), 0, None
        text = _without(text, _spans(found))
        whole, found = found, []
        for line in [*text.split("\n"), ""]:
            found += _moved(self.short.block(line), at)
            if line.strip():
                para = para or [at, 0, 0]
                para[1], para[2] = at + len(line), para[2] + 1
            elif para:
                if para[2] > 1:
                    own = [h for h in found if h["start"] >= para[0]]
                    block = _without(text[para[0]:para[1]], _spans(_moved(own, -para[0])))
                    found += _moved(self.short.block(block), para[0])
                para = None
            at += len(line) + 1
        return sorted(whole + found, key=lambda h: (h["start"], h["license"]))


def _has_cue(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES)


def _spans(hits: list[dict]) -> list[tuple[int, int]]:
    return sorted((h["start"], h["stop"]) for h in hits)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with blanks for the spans; offsets and lines are kept."""
    out, at = [], 0
    for lo, hi in spans:
        lo = max(lo, at)
        out += [text[at:lo], _INK.sub(" ", text[lo:hi])]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def _moved(hits: list[dict], by: int) -> list[dict]:
    return [h | {"start": h["start"] + by, "stop": h["stop"] + by} for h in hits]


_HIT = T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("stop", T.IntegerType()), T.StructField("saving", T.DoubleType()),
    T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("added", T.ArrayType(T.StringType()))])
_HIT_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for b in batches:
        hits = [(i, h) for i, t in enumerate(b.column("_text").to_pylist()) for h in scanner.text(t)]
        if hits:
            cols = [pa.array([h[f] for _, h in hits], k) for f, k in zip(_HIT.names, _HIT_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array([i for i, _ in hits])), *cols],
                                             ["_id", *_HIT.names])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: doc_id, license, start and stop (code points in the
    text), saving, missing and added (the wording's differences), exact.

    Null and empty texts have no notice; repeated rows report each; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    d = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return (d.mapInArrow(_scan_batches, T.StructType([d.schema["_id"], *_HIT.fields]))
            .withColumnRenamed("_id", "doc_id")
            .withColumn("exact", (F.size("missing") == 0) & (F.size("added") == 0)))


# ---------------------------------------------------------------- query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE: dict[str, str] = {}
