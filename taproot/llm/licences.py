"""Licence scans in DataFrame functions: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame

from taproot.llm.common import F, hash_sample
from taproot.llm.langid import calibrate, fit_ftrl, softmax

# Notices of well-known licences, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC BY 4.0 unless otherwise noted.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. SPDX-License-Identifier: CC0-1.0",
    ],
}
#: Names of licences by family, and the sentences that commonly carry one.
NAMES: dict[str, list[str]] = {
    "agpl": ["GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "artistic": ["Artistic License 2.0", "Perl Artistic License"],
    "boost": ["Boost Software License, Version 1.0", "BSL-1.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "epl": ["Eclipse Public License 2.0", "EPL-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL v2", "GPLv3", "GPL-2.0"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPLv3", "LGPL-2.1"],
    "mit": ["MIT License", "MIT licence"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "public-domain": ["CC0 1.0 Universal", "Unlicense", "CC0"],
    "zlib": ["zlib License", "zlib/libpng license"],
}
FORMS = [
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is licensed under the {} - see the LICENSE file for details.",
    "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "The code is made available under the {}.", "Published under {}; all other rights are reserved by the authors.",
]
for _family, _names in NAMES.items():
    TEMPLATES.setdefault(_family, [])
    TEMPLATES[_family] += [f.format(n) for f in FORMS[:6] for n in _names]
TEMPLATES = dict(sorted(TEMPLATES.items()))
#: Sentences near the subject that name no licence, whole ones and ones to be filled in.
NEAR = [
    "The {} was released in its second version under a new name.", "We compared the terms of the {} with those of the former contract.", "A member of the {} showed a license and the officer gave permission.",
    "The {} may redistribute the notes, and copyright remains with the museum.", "No warranty is given for the {} that was distributed last year.", "Under the following conditions the {} can be used by the public.",
    "Ask the {} for a driving licence, a fishing license or a permit.", "The general public was free to visit the {}.", "The {} published its source of income in version 3 of the report.",
    "Visit the {} to obtain a copy of the file and see the details.", "The license of the {} expired in May and was not renewed.", "The lesser works of the {} are in the public library.",
]
NEAR_OF = ["apache helicopter", "free software foundation", "students at MIT", "mozilla browser", "creative commons room", "eclipse of the sun", "perl community", "boost in sales", "university press", "gnu herd", "software house", "attribution error"]
DECOYS = [
    "The driver showed a license and the officer gave permission to go on.",
    "A general version of the work was published by the foundation this year.",
    "All rights reserved. Copyright of the pictures is with the museum.",
    "You may obtain a copy of the report at the public library free of charge.",
    "The software is distributed to schools and the terms are subject to change.",
    "Under the following conditions any person can use the source of the river.",
    "The apache helicopter was released in its second version under the name.",
    "Students at MIT may redistribute the notes in the documentation provided.",
    "The creative director gave attribution to the common work of the team.",
    "This file is part of the library of the university and must be included.",
]
UNKNOWN = "unknown"
STOP = set(
    "a above all along an and any are as at be been being below but by can could do does each either even for from had has have how if in into is it "
    "may more most must no not of on or other shall should some such than that the then there these this those to under was were what when where "
    "which who whose will with would you your".split()
)
#: What parts words: all but Latin letters and digits.
BETWEEN = "[^a-z0-9\u00df-\u024f]+"


def content(word: str) -> bool:
    return len(word) > 1 and word not in STOP


def grams(text: str) -> list[str]:
    """Content words, and pairs of neighbouring words of which one is such, lower-case, each once.

    Stop words and single characters are no content words.
    """
    w = [x for x in re.sub(BETWEEN, " ", text.lower()).split(" ") if x]
    pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if content(a) or content(b)]
    return list(dict.fromkeys([x for x in w if content(x)] + pairs))


@dataclass
class Model:
    families: list[str]  # unknown is the last
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    threshold: float
    templates: dict[str, list[list[str]]] = field(default_factory=dict)


def near_misses() -> list[str]:
    return [*DECOYS, *(f.format(x) for f in NEAR for x in NEAR_OF)]


def examples(others: list[str], seed: int, part: int | None = None) -> list[tuple[str, str]]:
    """Windows of the templates within strange words, and paragraphs that are no licence.

    With ``part`` 0 or 1 only from one side of a split of templates and near misses: every fourth one is
    on side 1.  ``others`` are paragraphs of the corpus; they are shown in windows and whole.
    """
    r = random.Random(seed)
    mine = lambda k: part is None or (k % 4 == 3) == part
    near = [d for k, d in enumerate(near_misses()) if mine(k)]
    prose = [p.split() for p in [*others, *near] if p.split()]
    out = []
    for family, texts in TEMPLATES.items():
        some = [t for k, t in enumerate(texts) if mine(k)]
        for t in some:
            w = t.split()
            for _ in range(max(3, 120 // len(some))):
                cut = w
                if len(w) > 12 and r.random() < 0.5:
                    k = r.randint(max(8, len(w) // 2), len(w))
                    at = r.randint(0, len(w) - k)
                    cut = w[at : at + k]
                if len(w) > 6:
                    cut = [x for x in cut if r.random() > 0.04]
                p = r.choice(prose)
                extra = p[: r.choice([0, 0, 0, 5, 15])]
                out.append((family, " ".join([*extra, *cut] if r.random() < 0.5 else [*cut, *extra])))
    for _ in range(len(out) // 2):
        p = r.choice(prose)
        k = min(len(p), r.randint(3, 60))
        at = r.randint(0, len(p) - k)
        out.append((UNKNOWN, " ".join(p[at : at + k])))
    out += [(UNKNOWN, d) for d in near for _ in range(4)]
    out += [(UNKNOWN, p) for p in others]
    r.shuffle(out)
    return out


def corpus_paragraphs(docs: DataFrame, max_rows: int, longest: int, key: str, text: str) -> list[str]:
    """Paragraphs of about ``max_rows`` documents, at most ten times as many, chosen by a hash over whole texts.

    Of one longer than ``longest`` characters a stretch of that length is taken, from a place that the
    hash gives.  Paragraphs that share a third of their word pairs with the templates are left out, as
    they may be licences; those that merely speak of licences stay.
    """
    some = hash_sample(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")), ["k", "t"], max_rows)
    lines = some.select(F.explode(F.split("t", r"\n+")).alias("p")).where(F.trim("p") != "").distinct()
    place = F.pmod(F.xxhash64("p"), F.greatest(F.length("p") - longest + 1, F.lit(1)))
    lines = lines.select("p", place.alias("place")).orderBy(F.xxhash64("p", F.lit(1))).limit(10 * max_rows)
    others = sorted(r.p for r in lines.select(F.expr(f"substring(p, cast(place as int) + 1, {int(longest)})").alias("p")).collect())
    shelf = {g for texts in TEMPLATES.values() for t in texts for g in grams(t) if " " in g}
    return [p for p in others if 3 * sum(g in shelf for g in grams(p)) <= sum(" " in g for g in grams(p))]


def fitted(rows: list[tuple[str, str]], families: list[str], index: dict[str, int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = [np.array([index[g] for g in grams(t) if g in index], int) for _, t in rows]
    y = [families.index(f) for f, _ in rows]
    w, bias = fit_ftrl([(f, np.full(len(f), 0.5)) for f in x], y, len(families), len(index), alpha=0.5, l1=0.5, l2=1e-3, epochs=3, seed=seed)
    return 0.5 * w, bias


def train(
    docs: DataFrame | None = None, *, max_rows: int = 400, longest: int = 20_000, key: str = "doc_id", text: str = "text", false_rate: float = 1e-3, seed: int = 5
) -> Model:
    """Fits the classifier on the driver, from templates, near misses and paragraphs of about ``max_rows`` documents.

    Features are the grams of the templates and near misses, so that words which merely stood near one
    carry no weight.  The documents, chosen by a hash, show what text without a licence looks like
    (``corpus_paragraphs``); that sample bounds training alone.  A first fit sees three quarters of the
    templates, near misses and paragraphs.  The rest, which it has not seen, sets the temperature, and the
    threshold of the unknown class: the least confidence at which a share of at most ``false_rate`` of the
    unknown ones would be taken for a licence, 0.5 at least.  The last fit sees all.
    """
    others = [] if docs is None else corpus_paragraphs(docs, max_rows, longest, key, text)
    families = [*TEMPLATES, UNKNOWN]
    known = sorted({g for texts in [*TEMPLATES.values(), near_misses()] for t in texts for g in grams(t)})
    index = {g: i for i, g in enumerate(known)}
    held = [p for p in others if xxhash.xxh32_intdigest(p) % 4 == 3]
    w, bias = fitted(examples([p for p in others if xxhash.xxh32_intdigest(p) % 4 != 3], seed, 0), families, index, seed)
    rest = examples(held, seed + 1, 1)
    logits = np.array([w[[index[g] for g in grams(t) if g in index]].sum(axis=0) + bias for _, t in rest])
    y = np.array([families.index(f) for f, _ in rest])
    temperature = calibrate(logits, y)
    p = np.array([softmax(z / temperature) for z in logits])
    wrong = np.sort(p[y == len(families) - 1, :-1].max(axis=1))[::-1]
    spare = int(false_rate * len(wrong))
    threshold = max(0.5, float(wrong[spare]) + 1e-6) if len(wrong) else 0.5
    w, bias = fitted(examples(others, seed), families, index, seed)
    weights = {g: [round(float(v), 6) for v in w[i]] for g, i in index.items() if np.abs(w[i]).sum() > 0}
    templates = {f: [sorted(set(grams(t))) for t in texts] for f, texts in TEMPLATES.items()}
    return Model(families, weights, [round(float(b), 6) for b in bias], float(temperature), threshold, templates)


def telling(model: Model) -> list[str]:
    """Words without all of which no licence can win.

    A paragraph without a gram that speaks more for a family than for none is unknown, and each such
    gram has a content word.  Empty if the bias alone would name a family.
    """
    if (np.array(model.bias[:-1]) - model.bias[-1]).max() > 0:
        return []
    return sorted({x for g, w in model.weights.items() if max(np.array(w[:-1]) - w[-1]) > 0 for x in g.split(" ") if content(x)})


def column_words(p: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(p), BETWEEN, " "), " ")


def column_grams(w: Column) -> Column:
    """``grams`` of an array of words."""
    said = lambda x: (F.length(x) > 1) & ~x.isin(*sorted(STOP))
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.when(said(a) | said(b), F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(w, said), F.filter(pairs, lambda x: x.isNotNull())))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def constant(values: list, kind: str) -> Column:
    """Constant values, given as one text that Spark folds once; thousands of literals would burden the planner."""
    return F.from_json(F.lit(json.dumps(values)), kind)


class Shelf:
    """A constant table by word: rows lie in slots by a hash of the word, so that a look-up takes one step."""

    def __init__(self, rows: dict, kind: str):
        self.slots = 1 << max(4, (2 * len(rows)).bit_length())
        table: list[list] = [[] for _ in range(self.slots)]
        for k in sorted(rows):
            table[xxhash.xxh64_intdigest(k, seed=42) % self.slots].append({"k": k, "v": rows[k]})
        self.table = constant(table, f"array<array<struct<k:string,v:{kind}>>>")

    def found(self, word: Column) -> Column:
        """The rows of ``word``: one or none."""
        return F.filter(F.get(self.table, F.pmod(F.xxhash64(word), F.lit(self.slots)).cast("int")), lambda e: e["k"] == word)


def scan(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", confirm: float = 0.5) -> DataFrame:
    """``key, paragraph, family, score, likeness, confirmed``: one row per paragraph taken for a licence.

    Paragraphs are the parts between line ends, counted from 0.  The sparse weights are looked up for
    the grams that a paragraph shares with the model.  A prediction is confirmed when the grams of some
    template of its family and those of the paragraph overlap to ``confirm`` of the smaller set.  Null
    and empty texts give no row; rows that repeat, or whose id is null, are scanned like any other.  Row by
    row, without a shuffle; no other column is read.
    """
    kinds = len(model.families)
    shelf, words = Shelf(model.weights, "array<double>"), telling(model)
    gate = Shelf(dict.fromkeys(words, True), "boolean")
    has = lambda w: F.exists(w, lambda x: F.size(gate.found(x)) > 0) if words else F.lit(True)
    lines = F.transform(F.split(text, r"\r\n|[\r\n]"), lambda p, i: F.struct(i.alias("i"), F.filter(column_words(p), lambda x: x != "").alias("w")))
    parts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.filter(lines, lambda s: has(s["w"]))).alias("s"))
    parts = parts.select("key", F.col("s.i").alias("paragraph"), column_grams(F.col("s.w")).alias("g_"))
    hits = F.flatten(F.transform(F.col("g_"), lambda g: F.transform(shelf.found(g), lambda e: e["v"])))
    total = F.aggregate(hits, literal(model.bias), lambda a, w: F.zip_with(a, w, lambda x, y: x + y))

    def chosen(e: Column) -> Column:
        """The likeliest family's share of ``e`` and its place."""
        some = F.slice(e, 1, kinds - 1)
        return let(F.array_max(some), lambda top: F.struct((top / F.aggregate(e, F.lit(0.0), lambda x, y: x + y)).alias("score"), F.array_position(some, top).cast("int").alias("place")))

    best = let(total, lambda z: let(F.array_max(z), lambda top: chosen(F.transform(z, lambda v: F.exp((v - top) / model.temperature)))))
    parts = parts.withColumn("r_", best).where(F.col("r_.score") >= model.threshold)
    parts = parts.withColumn("score", F.col("r_.score")).withColumn("family", F.get(literal(model.families), F.col("r_.place") - 1))
    own = Shelf({f: [[*t] for t in ts] for f, ts in model.templates.items()}, "array<array<string>>")
    like = F.array_max(F.transform(F.get(own.found(F.col("family")), F.lit(0))["v"], lambda t: F.size(F.array_intersect(t, "g_")) / F.least(F.size(t), F.size("g_"))))
    parts = parts.withColumn("likeness", like)
    return parts.select(F.col("key").alias(key), "paragraph", "family", "score", F.round("likeness", 6).alias("likeness"), (F.col("likeness") >= confirm).alias("confirmed"))


def licensed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_rows: int = 400) -> DataFrame:
    """``scan`` with a model trained on templates and a sample of ``docs``."""
    return scan(docs, train(docs, max_rows=max_rows, key=key, text=text), key=key, text=text)
