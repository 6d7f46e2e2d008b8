"""Licence scan by a trained paragraph classifier, with DataFrame operations only.

Paragraphs are lines, and blocks of lines that are wrapped text. A multinomial logistic regression over hashed word n-grams (one to three words), trained on the
templates below and on shortened forms of them, names a licence family or `unknown`. Its probabilities are calibrated by
a temperature chosen for a first fit, on templates it has not seen and on new forms of those it has. A family counts if
its calibrated probability reaches a threshold and the paragraph shares enough word pairs with one of the family's
templates.

The classifier reads every line that shares enough word pairs with a template of any family, and every line with a cue.
Other lines can't be confirmed, whatever it would say of them, so none that it would name is lost.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Paragraphs of licences and of the notices that they ask for, by family.
PARAGRAPHS = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", "This work is licensed under the GNU General Public License, version 3."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", "Released under CC0 1.0 Universal, dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    UNKNOWN: ["Copyright 2020 the authors, all rights reserved.", "No part of this publication may be reproduced without permission of the publisher.", "She renewed her driving licence at the office.", "The licence plate of the car was covered in mud.", "The vendor offers a warranty of two years on all parts.", "Please ask for permission before you enter the garden.", "The city council issued a liquor license to the new bar.", "Version 2 of the report was released to the public last week.", "The software is licensed to the customer for internal use only.", "The committee granted permission for the march through the old town.", "You can redistribute the chairs along the wall before the guests arrive.", "The terms of the general agreement were published by the foundation last year.", "A copy of the letter can be found in the file on her desk.", "All or substantial portions of the harvest were lost to the storm.", "The source of the river is subject to the terms of a border treaty.", "Admission is free of charge to any person under the age of twelve.", "His work was dedicated to the public library of the town.", "The use of this path is governed by the rules of the park.", "Released under pressure from the board, the figures surprised everyone.", "The band shared a common creative streak and a public stage.", "To the extent possible, please use the stairs.", "The above notice shall be read aloud at every meeting.", "MIT and other universities published the study together.", "The bar sells food and drink with or without a reservation.", "Distribution of the leaflets starts at noon in the square."],
}
# How texts call a licence, and phrases in which they do; for the unknown class, names that are no licence of these.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"],
    "mit": ["MIT License", "MIT license (MIT)", "MIT"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL, version 2", "GPL, version 3 or later", "GPLv3", "GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "LGPL, version 3 or later", "GNU LGPL", "LGPLv3", "LGPL-2.1-or-later"],
    "agpl": ["GNU Affero General Public License, version 3", "AGPL, version 3 or later", "GNU AGPL", "AGPLv3", "AGPL-3.0-only"],
    "bsd": ["BSD 3-Clause License", "BSD license", "BSD 2-Clause License", "BSD-3-Clause"],
    "mpl": ["Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License", "MPL-2.0"],
    "isc": ["ISC License", "ISC"],
    "zlib": ["zlib License", "Zlib"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial License", "CC-BY-NC-4.0"],
    "cc0": ["CC0", "CC0-1.0"],
    "unlicense": ["Unlicense"],
    UNKNOWN: ["supervision of the board", "commercial licence of the vendor", "city code", "terms of the sale", "company licence agreement"],
}
PHRASES = ["Released under the {}.", "Licensed under the {}.", "Distributed under the terms of the {}.", "This code is {} licensed.", "Licensed under {}", "Available under the {}", "License: {}"]
TEMPLATES = {family: PARAGRAPHS[family] + [p.format(name) for name in NAMES[family] for p in PHRASES] + [f"SPDX-License-Identifier: {name}" for name in NAMES[family] if " " not in name and family != UNKNOWN] for family in PARAGRAPHS}
# Patterns of the names by which a line may state several licences.
STATED = {
    "apache": r"(?i)\bapache\b", "mit": r"\bMIT\b", "gpl": r"(?<![LA])\bGPL|(?i:general public license)", "lgpl": r"\bLGPL|(?i:lesser general public)", "agpl": r"\bAGPL|(?i:affero)", "bsd": r"\bBSD\b", "mpl": r"\bMPL\b|(?i:mozilla public)",
    "isc": r"\bISC\b", "zlib": r"(?i)\bzlib\b", "cc-by": r"(?i)\bcc[ -]by(?![ -](?:sa|nc|nd))", "cc-by-sa": r"(?i)\bcc[ -]by-sa", "cc-by-nc": r"(?i)\bcc[ -]by-nc", "cc0": r"(?i)\bcc0\b", "unlicense": r"(?i)\bunlicense\b",
}
#: Lines that state a licence by name: such a line's licences are those it names.
STATEMENT = r"(?i)spdx-license-identifier|\b(?:dual|triple|tri)[ -]?licen[cs]ed|licen[cs]ed under (?:either|both)|\b(?:or|and|/)\b.*licen[cs]e|licen[cs]e.*\b(?:or|and)\b"
#: Lines with any of these are reported even if they are like no template, then mostly as unknown.
CUES = r"(?i)licen[cs]|copyright|warrant|permission|permitted|redistribut|public domain|creative commons|spdx|\bgpl|\bcc0|\bcc[ -]by|unencumbered|free software"
FEATURES, FORMS, LONG_FORMS, SEED = 1 << 14, 4, 24, 7


def forms(words: list[str], source: random.Random, n: int) -> list[str]:
    """Shortened forms of a template: a start, an end or a middle of at least half its words, some words left out."""
    out = [" ".join(words)]
    for _ in range(n - 1):
        size = source.randint(max(3, len(words) // 2), max(3, len(words)))
        at = source.randint(0, max(0, len(words) - size))
        out.append(" ".join(w for w in words[at : at + size] if source.random() > 0.08))
    return out


def held_out(templates: list[str]) -> list[str]:
    """Every third template, from the third on, of a family that has as many."""
    return templates[2::3]


def others(templates: list[str]) -> list[str]:
    return [t for t in templates if t not in held_out(templates)]


def training_rows(choose: Callable[[list[str]], list[str]], seed: int = SEED) -> list[tuple[str, float]]:
    source = random.Random(seed)
    return [(form, float(i)) for i, family in enumerate(TEMPLATES) for t in choose(TEMPLATES[family]) for form in forms(t.split(), source, LONG_FORMS if len(t.split()) > 9 or family == UNKNOWN else FORMS)]


def split_words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+")


def words_of(text: Column) -> Column:
    return F.filter(split_words(text), lambda w: w != "")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with the column, as a generator's output: no filter or projection above it repeats the expression."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def neighbours(words: Column, joined: Callable[[Column, Column], Column]) -> Column:
    """Neighbouring words without closing stops; the last word's has null for the second."""
    bare = lambda w: F.rtrim(w, F.lit("."))
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: joined(bare(a), bare(b)))


def pair_keys(words: Column) -> Column:
    return neighbours(words, F.xxhash64)


def pairs_of(words: Column) -> Column:
    """Distinct neighbouring words."""
    return F.array_distinct(F.filter(neighbours(words, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))


def with_grams(rows: DataFrame) -> DataFrame:
    """rows with grams, the one to three neighbouring words of a paragraph; the time grows with its length."""
    rows = once(rows, "words", F.transform(words_of(F.col("paragraph")), lambda w: F.rtrim(w, F.lit("."))))
    after = lambda k: F.slice("words", F.lit(k + 1), F.size("words"))
    joined = lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))
    rows = once(rows, "two", F.zip_with("words", after(1), joined))
    three = F.zip_with("two", after(2), joined)
    return rows.withColumn("grams", F.filter(F.concat("words", "two", three), lambda g: g.isNotNull())).drop("words", "two")


def constant(value: list, kind: str) -> Column:
    """A list as one literal: Spark folds the parsing of a constant, and plans stay small."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class Classifier:
    """The fitted regression, its temperature, and the word pairs of the chosen templates as literals of some hundred words."""

    def __init__(self, spark: SparkSession, choose: Callable[[list[str]], list[str]] = list):
        self.families = list(TEMPLATES)
        rows = lambda forms: with_grams(spark.createDataFrame(forms, "paragraph string, label double").coalesce(1))
        tf = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
        regression = LogisticRegression(family="multinomial", regParam=1e-2, maxIter=60, probabilityCol="p", rawPredictionCol="raw")
        pipeline = Pipeline(stages=[tf, regression])
        first = pipeline.fit(rows(training_rows(lambda templates: others(choose(templates)))))
        unseen = training_rows(lambda templates: held_out(choose(templates))) + training_rows(lambda templates: others(choose(templates)), SEED + 1)
        held = [(list(r["raw"]), int(r["label"])) for r in first.transform(rows(unseen)).select("raw", "label").collect()]  # some thousand forms
        loss = lambda t: sum(math.log(sum(math.exp((x - max(raw)) / t) for x in raw)) - (raw[y] - max(raw)) / t for raw, y in held)
        self.temperature = min((0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
        self.model = pipeline.fit(rows(training_rows(choose)))
        templates = spark.createDataFrame([(f, t) for f in TEMPLATES if f != UNKNOWN for t in choose(TEMPLATES[f])], "family string, paragraph string")
        templates = templates.select("family", words_of(F.col("paragraph")).alias("words")).select("family", pairs_of(F.col("words")).alias("own"), pair_keys(F.col("words")).alias("keys")).collect()
        self.keys = sorted({key for t in templates for key in t.keys[:-1]})
        self.pairs = sorted({pair for t in templates for pair in t.own})
        self.templates = [(t.family, t.own) for t in templates]

    def like(self, words: Column) -> Column:
        """Whether any word pair of a template stands in the line; by hashes, so others may pass."""
        return F.arrays_overlap(pair_keys(words), constant(self.keys, "array<bigint>"))

    def templates_as(self) -> Column:
        return constant([{"family": family, "own": own} for family, own in self.templates], "array<struct<family:string,own:array<string>>>")

    def near(self, common: Column, size: Column, similarity: float) -> Column:
        """Whether a template shares enough pairs; where all shared pairs together are too few for it, none are compared."""
        enough = lambda t: similarity * F.greatest(F.lit(1), F.least(F.size(t.own), size))
        return F.exists(self.templates_as(), lambda t: (F.size(common) >= enough(t)) & (F.size(F.array_intersect(t.own, common)) >= enough(t)))

    def likeness(self, common: Column, size: Column) -> Column:
        """(family, share) structs: shared word pairs over the smaller of a template's and the line's number of them."""
        share = lambda t: F.size(F.array_intersect(t.own, common)) / F.greatest(F.lit(1), F.least(F.size(t.own), size))
        return F.transform(self.templates_as(), lambda t: F.struct(t.family.alias("family"), share(t).alias("share")))

    def compared(self, lines: DataFrame, similarity: float) -> DataFrame:
        """Lines and blocks (words, cue, ..) that have a cue or share enough word pairs with a template, with their likeness to each."""
        rows = once(lines.withColumn("size", F.size("words") - 1), "own", pairs_of(F.filter("words", lambda w: w != ""))).drop("words")
        rows = once(rows, "common", F.array_intersect("own", constant(self.pairs, "array<string>")))
        # A block counts as a notice if most of it is a notice's words.
        rows = rows.where((F.col("n_lines") == 1) | (F.size("common") >= similarity * F.col("size"))).drop("size")
        rows = rows.where(F.col("cue") | self.near(F.col("common"), F.size("own"), similarity)).drop("cue")
        return once(rows, "likeness", self.likeness(F.col("common"), F.size("own"))).drop("own", "common")

    def classify(self, rows: DataFrame, threshold: float, similarity: float) -> DataFrame:
        """Rows (paragraph, likeness, ..) with family, probability and similarity in place of likeness."""
        kept = [c for c in rows.columns if c != "likeness"]
        raw = self.model.transform(with_grams(rows)).withColumn("z", F.transform(vector_to_array("raw"), lambda x: x / self.temperature))
        e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
        p = F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        named = F.element_at(F.array(*map(F.lit, self.families)), F.array_position("z", F.array_max("z")).cast("int"))
        rows = raw.select(*kept, "likeness", named.alias("family"), p.alias("probability"))
        alike = F.array_max(F.transform(F.filter("likeness", lambda x: x.family == F.col("family")), lambda x: x.share))
        rows = rows.withColumn("similarity", F.coalesce(alike, F.lit(0.0)))
        sure = (F.col("probability") >= threshold) & (F.col("similarity") >= similarity)
        return rows.select(*kept, F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "similarity")


#: The fitted classifier of each application.
FITTED: dict[str, Classifier] = {}


def classifier(spark: SparkSession) -> Classifier:
    key = spark.sparkContext.applicationId
    if key not in FITTED:
        FITTED[key] = Classifier(spark)
    return FITTED[key]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line, paragraph, words, cue of every line of every text, and of every block of several lines.

    A block is lines with no blank one between them, so it is how a wrapped notice stands in a text; its lines are joined by
    a blank and it has the number of its first line."""
    piece = lambda x, at, n: F.struct(at.cast("int").alias("line"), n.cast("int").alias("n_lines"), x.alias("paragraph"), split_words(x).alias("words"))
    lines = F.split("text", "\n")
    filled = lambda x: F.rlike(x, F.lit(r"\S"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
    # Starts of blocks: a filled line behind a blank one or the beginning; ends alike.
    texts = once(texts, "filled", F.transform("lines", filled))
    at = F.sequence(F.lit(1), F.size("lines"))
    side = lambda step: F.filter(at, lambda i: F.element_at("filled", i) & ~F.coalesce(F.try_element_at("filled", F.when(i + step > 0, i + step)), F.lit(False)))
    texts = once(texts, "blocks", F.filter(F.arrays_zip(side(-1).alias("a"), side(1).alias("b")), lambda x: x["a"] < x["b"]))
    text_of = lambda x: F.array_join(F.slice("lines", x["a"], x["b"] - x["a"] + 1), " ")
    cued = F.filter("blocks", lambda x: F.rlike(text_of(x), F.lit(CUES)))
    pieces = F.concat(F.transform("lines", lambda x, i: piece(x, i, F.lit(1))), F.transform(cued, lambda x: piece(text_of(x), x["a"] - 1, x["b"] - x["a"] + 1)))
    rows = texts.select("doc_id", F.explode(pieces).alias("of"))
    return rows.select("doc_id", "of.line", "of.n_lines", "of.paragraph", "of.words", F.rlike("of.paragraph", F.lit(CUES)).alias("cue"))


def stated(paragraph: Column) -> Column:
    """Families whose names stand in a line, in order of STATED."""
    return F.filter(F.array(*[F.when(F.rlike(paragraph, F.lit(pattern)), F.lit(family)) for family, pattern in STATED.items()]), lambda x: x.isNotNull())


def scan_licences(docs: DataFrame, threshold: float = 0.5, similarity: float = 0.6, model: Classifier | None = None) -> DataFrame:
    """doc_id, line (from 0), n_lines, paragraph, family, families, probability, similarity of every line with a licence cue
    or like a template, and of every wrapped notice that is named as a whole.

    family is one of TEMPLATES, or 'unknown' if the calibrated probability or the likeness to the family's templates is
    too low. families are the family, or none if it is unknown; a line that states licences by name, as an SPDX expression or
    a dual licence does, has all that it names, and is of the first of them. Ties in probability go to the first family.
    Blocks of several lines give a row only where they are named. Null and empty texts, and lines without a cue that
    share less than `similarity` of their word pairs with every template, give no row. Repeated rows and null ids stay.
    Every line of a very long text is read. Other columns, whatever their names, are ignored. An empty table gives an
    empty result.
    """
    model = model or classifier(docs.sparkSession)
    lines = lines_of(docs)
    rows = model.classify(model.compared(lines.where(F.col("cue") | model.like(F.col("words"))), similarity), threshold, similarity)
    rows = rows.where((F.col("n_lines") == 1) | (F.col("family") != UNKNOWN))
    names = F.when((F.col("n_lines") == 1) & F.rlike("paragraph", F.lit(STATEMENT)) & (F.length("paragraph") < 300), stated(F.col("paragraph"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("names", names).withColumn("family", F.when(F.size("names") > 0, F.when(F.array_contains("names", F.col("family")), F.col("family")).otherwise(F.element_at("names", 1))).otherwise(F.col("family")))
    own = F.when(F.size("names") > 0, F.col("names")).when(F.col("family") != UNKNOWN, F.array("family")).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "line", "n_lines", "paragraph", "family", own.alias("families"), "probability", "similarity")
