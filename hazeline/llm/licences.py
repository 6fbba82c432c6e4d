"""Licence notices in texts, by Dice coefficient over word bigrams.

Text is normalised to lower-case words of letters and digits. Every line, every
paragraph (lines up to an empty one) and the whole text are compared with templates:
twice the bigrams in common over the bigrams of both. A coefficient of `LEAST`
bounds the ratio of sizes, so most templates are ruled out by length; the number of
bigrams that occur in any template rules out most others. What is left is compared in full.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazeline.llm import batches

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")

#: Notices as their licences give or recommend them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(found: list[str]) -> Counter:
    """Word pairs with their number; a single word is a pair with nothing."""
    return Counter(zip(found, found[1:], strict=False)) if len(found) > 1 else Counter((w, "") for w in found)


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> None:
        self.least = least
        self.templates = [(name, grams, grams.total()) for name in sorted(templates) for t in templates[name] if (grams := bigrams(words(t)))]
        self.templates.sort(key=lambda t: t[2])
        self.sizes = [size for _, _, size in self.templates]
        self.known = {pair for _, grams, _ in self.templates for pair in grams}
        ratio = (2 - least) / least
        self.smallest, self.largest = min(self.sizes) / ratio, max(self.sizes) * ratio
        self.ratio = ratio

    def best(self, found: list[str], hits: int) -> tuple[float, str] | None:
        """Best template for a run of words, of which `hits` pairs occur in some template."""
        size = max(len(found) - 1, 1)
        grams = None
        best = None
        for name, template, n in self.templates:
            if not n / self.ratio - 1e-9 <= size <= n * self.ratio + 1e-9 or 2 * hits < self.least * (size + n) - 1e-9:
                continue
            grams = bigrams(found) if grams is None else grams
            score = dice(grams, template)
            if score >= self.least and (best is None or score > best[0] or score == best[0] and name < best[1]):
                best = (score, name)
        return best

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, end line) of every line, paragraph and whole text that matches."""
        lines = [words(line) for line in text.split("\n")]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).tolist()
        every = [w for line in lines for w in line]
        if not every:
            return []
        pairs = zip(every, every[1:] + [""], strict=True)
        hit = np.concatenate([[0], np.cumsum([p in self.known for p in pairs])])
        if len(every) > 1 and not hit[-1]:
            return []
        units, first = {(i, i + 1) for i in range(len(lines))}, 0
        for i, line in enumerate([*lines, []]):
            if not line:
                if i > first:
                    units.add((first, i))
                first = i + 1
        units.add((0, len(lines)))
        out, seen = [], set()
        for a, b in sorted(units):
            span = starts[a], starts[b]
            size = max(span[1] - span[0] - 1, 1)
            if span[0] == span[1] or span in seen or not self.smallest <= size + 1e-9 or size > self.largest + 1e-9:
                continue
            seen.add(span)
            found = self.best(every[span[0] : span[1]], int(hit[max(span[1] - 1, span[0] + 1)] - hit[span[0]]))
            if found:
                out.append((found[1], found[0], a, b))
        return out


def scan(df: DataFrame, key: str, text: str, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """`key, licence, score, n_matches, matches` of every row.

    `matches` lists (licence, score, first_line, end_line) by position; `licence` is the
    one of the highest score, ties by name, null if none matches, as for null and
    empty texts. Words are those of a whole line, paragraph or text.
    """
    match = T.StructType([
        T.StructField("licence", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("first_line", T.LongType()), T.StructField("end_line", T.LongType()),
    ])
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("licence", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("matches", T.ArrayType(match))])
    element = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("first_line", pa.int64()), ("end_line", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches.slices(rows, "text"):
            found = [scanner.scan(t) for t in batches.texts(batch, "text")]
            best = [min(f, key=lambda m: (-m[1], m[0]), default=(None, None)) for f in found]
            names = ("licence", "score", "first_line", "end_line")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()),
                    pa.array([len(f) for f in found], pa.int64()), pa.array([[dict(zip(names, m, strict=True)) for m in f] for f in found], element),
                ],
                names=schema.names,
            )

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
