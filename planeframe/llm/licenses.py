"""License scans: TF-IDF cosine to notice templates, then inheritance from the nearest licensed directory."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, slices, tidy

#: Notices by SPDX identifier; a license may have several wordings.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-Proprietary", "All rights reserved."),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1-only", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
#: Words that tell the licenses of a family apart, by the beginnings of their names: a match has those of its template and no others.
SIBLINGS = {("CC-BY",): "sharealike noderivatives noncommercial sa nd nc", ("GPL", "LGPL", "AGPL"): "affero lesser", ("BSD",): "endorse"}
#: Families whose versions are licenses of their own: a match has the digits of its template.
VERSIONED = ("CC-BY", "GPL", "LGPL", "AGPL")
#: Words from which a template counts as a whole license: a file that is like one as a whole has that license, whatever its lines are like.
WHOLE = 60
#: Whole license texts by SPDX identifier (fixed values), without names and years: a license file is compared with them as a whole.
FULL: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
#: Least cosine of a match, and lines with words of a file's head, in which the beginning of a notice makes it a license file of its directory.
COSINE, HEAD_LINES = 0.75, 20
#: Parts that the files of a directory are dealt in when they meet its license.
SALTS = 16

#: Letters in lower case, digits and other bytes as they are; ASCII punctuation separates, the line feed stays a mark of its own.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32



class Templates:
    """The templates' terms as sorted hashes, and unit TF-IDF vectors over them."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        w = Words(pa.array([t for _, t in templates], pa.string()), _TABLE)
        self.terms = np.unique(w.hash)
        self.tf = np.zeros((len(templates), len(self.terms)))
        np.add.at(self.tf, (np.repeat(np.arange(len(templates)), np.diff(w.first)), np.searchsorted(self.terms, w.hash)), 1)
        self.whole = np.diff(w.first) >= WHOLE
        self.must, self.never = np.zeros(self.tf.shape), np.zeros(self.tf.shape)
        for j, name in enumerate(self.names):
            for family, words in SIBLINGS.items():
                if name.startswith(family):
                    marks = self._some(words.split())
                    self.must[j, marks], self.never[j, marks] = self.tf[j, marks] > 0, self.tf[j, marks] == 0
            if name.startswith(VERSIONED):
                digits = self._some("1234")
                self.must[j, digits] = self.tf[j, digits] > 0

    def _some(self, words) -> np.ndarray:
        code = self.codes(Words(pa.array([" ".join(words)], pa.string()), _TABLE).hash)
        return code[code >= 0]

    def fits(self, have: np.ndarray) -> np.ndarray:
        """Which templates' telling words are just those of a text that has these terms."""
        have = (have > 0).astype(float)
        return (self.must @ (1 - have) == 0) & (self.never @ have == 0)

    def codes(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)


def _frequencies(texts: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Documents in all, and documents that hold each term of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(templates.terms) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), _TABLE)
                code = templates.codes(w.hash)
                hit = code >= 0
                owner = np.repeat(np.arange(len(w)), np.diff(w.first))[hit]
                df[:-1] += np.bincount(np.unique(owner * len(df) + code[hit]) % len(df), minlength=len(df))[:-1]
                n += len(w)
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], names=["i", "n"])

    got = {r[0]: r[1] for r in texts.mapInArrow(tidy(run), "i int, n long").groupBy("i").agg(F.sum("n")).collect()}
    n = len(templates.terms)
    return int(got.get(n, 0)), np.array([got.get(i, 0) for i in range(n)], float)


def _windows(w: Words, line: np.ndarray, code: np.ndarray, unit: np.ndarray, idf: np.ndarray, rare: float, cosine: float, joined: int = 3) -> Iterator[tuple[int, int, int]]:
    """(first word, end, place of the first line in its text) of the one to ``joined`` lines that may reach the cosine.

    A bound decides, never how common a term is: the products with the templates
    add up over lines, and a vector's square is at least the sum of its lines'
    squares, in which a word that no template has counts once for each place.
    """
    if not len(line):
        return
    _, first, row = np.unique(line, return_index=True, return_inverse=True)
    n, size = len(first), len(idf)
    end = np.append(first[1:], len(line))
    text = np.searchsorted(w.first, first, "right") - 1
    place = np.arange(n) - np.searchsorted(text, text)
    inner = code >= 0
    cell, times = np.unique(row[inner] * size + code[inner], return_counts=True)
    at, term = cell // size, cell % size
    value = times * idf[term]
    products = np.stack([np.bincount(at, value * u[term], n) for u in unit])
    square = np.bincount(at, value**2, n) + np.bincount(row[~inner], minlength=n) * rare**2
    for more in range(min(joined, n)):
        k = n - more
        dot, least = sum(products[:, i : i + k] for i in range(more + 1)), sum(square[i : i + k] for i in range(more + 1))
        may = (text[:k] == text[more:]) & (dot.max(axis=0) >= (cosine - 1e-9) * np.sqrt(least))
        for i in np.flatnonzero(may).tolist():
            yield int(first[i]), int(end[i + more]), int(place[i])


def license_scan(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES + FULL, cosine: float = COSINE, head_lines: int = HEAD_LINES) -> DataFrame:
    """(doc_id, path, own_license, own_cosine, license, inherited_from) of each file.

    Every line of a whole text, every two and three lines together (a notice may
    be wrapped), and the whole text (a license file) is a TF-IDF vector of its words; ``own_license`` is the
    template of the greatest cosine, if that reaches ``cosine`` (ties: the
    earlier template). Document frequencies count all files; words that no
    template has weigh as the rarest ones. A file with a match in its first
    ``head_lines`` lines licenses its directory (of several the smallest path
    decides), and a file without a license of its own inherits from the nearest
    ancestor directory that has one; ``inherited_from`` is that directory.

    Inheritance is settled once per directory: distinct directories meet their
    ancestors by joins, then files meet their directory. A null text has no
    license of its own; a null path has no directory and inherits nothing;
    repeated rows give a row each; an empty table gives none; other columns are
    ignored.
    """
    known = Templates(templates)
    src = files.select(files[id_col].cast("long").alias("doc_id"), files[text_col].cast("string").alias("text"), path.cast("string").alias("path"))
    total, df = _frequencies(src, known)
    idf = np.log((1 + total) / (1 + df)) + 1
    rare = np.log(1 + total) + 1
    unit = known.tf * idf
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1), _TABLE)
                best, name, head = np.zeros(len(w)), np.full(len(w), -1), np.zeros(len(w), bool)
                breaks = np.flatnonzero(w.data == 10)
                code = known.codes(w.hash)
                owner = np.repeat(np.arange(len(w)), np.diff(w.first))
                line = np.searchsorted(breaks, w.start) + owner  # a text's begin is a break, too
                lines = ((*x, False) for x in _windows(w, line, code, unit, idf, rare, cosine))
                for x, y, lo, whole in chain(lines, ((*x, True) for x in _windows(w, owner, code, unit, idf, rare, cosine, 1))):
                    d = int(np.searchsorted(w.first, x, "right")) - 1
                    c = code[x:y]
                    inside = np.bincount(c[c >= 0], minlength=len(idf)) * idf
                    _, other = np.unique(w.hash[x:y][c < 0], return_counts=True)
                    norm = np.sqrt((inside**2).sum() + ((other * rare) ** 2).sum())
                    cos = np.where(known.fits(inside), unit @ inside / norm, 0.0)
                    if whole and (cos[known.whole].max(initial=0.0)) >= cosine:
                        j = int(np.argmax(np.where(known.whole, cos, 0.0)))
                        best[d], name[d], head[d] = cos[j], j, True
                        continue
                    j = int(np.argmax(cos))
                    if cos[j] > best[d] + 1e-12 or (cos[j] > best[d] - 1e-12 and j < name[d]):
                        best[d], name[d] = cos[j], j
                    if cos[j] >= cosine and lo < head_lines:
                        head[d] = True
                ok = best >= cosine
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([known.names[j] if o else None for j, o in zip(name, ok, strict=True)], pa.string()), pa.array(np.where(ok, np.round(best, 6), np.nan), mask=~ok), pa.array(head & ok)],
                    names=["doc_id", "path", "own_license", "own_cosine", "is_file"],
                )

    scan = cut(src.mapInArrow(tidy(run), "doc_id long, path string, own_license string, own_cosine double, is_file boolean").withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)))
    licensed = scan.where("is_file AND path IS NOT NULL").groupBy(F.col("dir").alias("_dir")).agg(F.min_by("own_license", F.struct("path", "doc_id")).alias("dir_license"))
    dirs = scan.where("path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))).alias("a")).select(F.col("dir").alias("of"), "a.depth", "a.ancestor").distinct()
    near = up.join(licensed, F.col("ancestor") == F.col("_dir")).groupBy("of").agg(F.max_by(F.struct("ancestor", "dir_license"), "depth").alias("near"))
    # a directory may hold a third of all files, so they are dealt in parts, each with the directory's one row
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = scan.withColumn("_part", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int"))
    return dealt.join(near, (F.col("dir") == F.col("of")) & (F.col("_part") == F.col("part")), "left").select(
        "doc_id", "path", "own_license", "own_cosine",
        F.coalesce("own_license", F.when(F.col("path").isNotNull(), F.col("near.dir_license"))).alias("license"),
        F.when(F.col("own_license").isNull() & F.col("path").isNotNull(), F.col("near.ancestor")).alias("inherited_from"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The whole table, cases as in ``license_scan``. Documents as files: a folder for each source, in it one for each language but English, in that one for each thousand ids."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    deep = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000").cast("string"))
    path = F.concat_ws("/", F.when(F.col("lang") == "en", F.col("source")).otherwise(deep), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(d, path)
