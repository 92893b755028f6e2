"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over the word 1- to 3-grams present in a paragraph tells licence families apart. It is
trained here: on variations of the templates below, on invented licences (the class ``unknown``) and on paragraphs of the
corpus (the class ``none``). Its probabilities are calibrated by a temperature on variations it has not seen. A
prediction counts if a template of its family confirms it; what looks like a licence otherwise is ``unknown``.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common wordings of licence notices, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2 license.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No part of this document may be reproduced without the prior written permission of the owner.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
_UNKNOWN_FORMS = [
    "Licensed under the {} License.", "Released under the {} license, version {}.", "This work is licensed under the {} {} License.",
    "SPDX-License-Identifier: LicenseRef-{}", "Use of this {} is subject to the {} license agreement.",
    "Distributed under the terms of the {} Public License.",
]
UNKNOWN, NONE = "unknown", "none"
#: Bounds: paragraphs of the corpus in the training set, n-grams of the model, variations of each template.
CORPUS_SAMPLE, MAX_FEATURES, VARIATIONS = 2_000, 4_000, 30
#: A paragraph of more words is scanned in windows of this many that overlap by half.
WINDOW = 80
#: Shares of a template's n-grams (or of the paragraph's, where it is shorter) that confirm a prediction.
CONFIRMED = 0.6
#: Width of lines that may go on in the next one.
_WRAPPED = 40, 160
#: Comment marks and white space at either end of a line.
_MARKS = re.compile(r"""^(?:\s|/\*+|\*+/|//+|\*+|\#+|--+|;+|%+|<!--|-->|\"{3}|'{3}|(?i:rem|dnl)\s)+|(?:\s|\*+/|\*+|\#+|-->|\"{3}|'{3})+$""")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    """The distinct word 1-, 2- and 3-grams."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class Model:
    classes: list[str]
    features: dict[str, int]
    weights: np.ndarray  # classes × features; the last column is the bias
    temperature: float
    threshold: float

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        scores = np.array([self.weights[:, at].sum(axis=1) + self.weights[:, -1] for at in found]) / self.temperature
        return _softmax(scores)

    def known(self, words: list[str]) -> list[int]:
        """The features of a paragraph. A known n-gram has known words only, so others are not even put together."""
        features = self.features
        at = [w in features for w in words]
        if not any(at):
            return []
        found = {features[w] for w, yes in zip(words, at) if yes}
        for i in range(len(words) - 1):
            if at[i] and at[i + 1]:
                for n in (2, 3):
                    k = features.get(" ".join(words[i : i + n]))
                    if k is not None:
                        found.add(k)
        return sorted(found)


def _softmax(scores: np.ndarray) -> np.ndarray:
    x = np.exp(scores - scores.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _variations(draw: random.Random, fillers: list[str], n: int) -> list[tuple[str, list[str]]]:
    """Labelled word lists: templates with words lost and text around them, and licences of invented names."""
    out = []
    some = lambda most: [draw.choice(fillers) for _ in range(draw.randrange(most + 1))]
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = words_of(text)
            for k in range(n):
                kept = [w for w in words if k == 0 or len(words) < 8 or draw.random() > 0.08]
                out.append((family, kept if k < 3 else some(6) + kept + some(6)))
    for form in _UNKNOWN_FORMS:
        for _ in range(4 * n):
            name = lambda: "".join(draw.choice("aeioubdfgklmnprstvz") for _ in range(draw.randrange(3, 9)))
            out.append((UNKNOWN, some(6) + words_of(form.format(name(), name())) + some(6)))
    return out


def _trained(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Weights by accelerated gradient descent on the mean logistic loss, every class with the same weight."""
    share = 1.0 / (np.bincount(y, minlength=classes)[y] * classes)
    target = np.zeros((len(y), classes), np.float32)
    target[np.arange(len(y)), y] = 1
    w = np.zeros((classes, x.shape[1]), np.float32)
    ahead, rate = w.copy(), 2.0 / float((share[:, None] * x * x).sum(axis=0).max() + ridge) / 2
    for i in range(rounds):
        gradient = ((_softmax(x @ ahead.T) - target) * share[:, None]).T @ x + ridge * ahead
        following = (ahead - rate * gradient).astype(np.float32)
        ahead = following + (i / (i + 3)) * (following - w)
        w = following
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the templates and a paragraph each of about ``CORPUS_SAMPLE`` documents, chosen by hashes.

    Paragraphs that hold most of a template are no example of the class ``none``.
    """
    share = int(1_000_000 * min(1.0, CORPUS_SAMPLE / max(1, docs.count())))
    text = F.col(text_col).cast("string")
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1_000_000)) < share)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x).between(20, 2_000))
    first = F.array_min(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("line"))))
    sample = some.select(first["line"].alias("line")).where("line is not null")
    return trained_on(sorted({r["line"] for r in sample.collect()}))


def trained_on(paragraphs: list[str]) -> Model:
    draw = random.Random(11)
    clean = [w for w in (words_of(p)[: 2 * WINDOW] for p in paragraphs) if w and best_template(w)[1] < 0.5]
    fillers = sorted({w for words in clean for w in words[:5]}) or ["text"]
    examples = _variations(draw, fillers, VARIATIONS) + [(NONE, w) for w in clean or [["text"]]]
    counts = Counter(g for label, words in examples if label != NONE for g in grams(words))
    templates = {g for texts in TEMPLATES.values() for t in texts for g in grams(words_of(t))}
    templates |= {g for f in _UNKNOWN_FORMS for part in f.split("{}") for g in grams(words_of(part))}
    # Only n-grams of the templates and forms: the words around them must not become evidence.
    kept = sorted(templates, key=lambda g: (-counts[g], g))[:MAX_FEATURES]
    kept_set = set(kept)
    features = {g: i for i, g in enumerate(kept) if all(w in kept_set for w in g.split())}
    features = {g: i for i, g in enumerate(sorted(features))}
    classes = [*TEMPLATES, UNKNOWN, NONE]
    model = Model(classes, features, np.zeros((len(classes), len(features) + 1), np.float32), 1.0, 0.5)

    def matrix(rows: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(features) + 1), np.float32)
        x[:, -1] = 1
        for i, (_, words) in enumerate(rows):
            x[i, model.known(words)] = 1
        return x, np.array([classes.index(label) for label, _ in rows])

    x, y = matrix(examples)
    model.weights = _trained(x, y, len(classes))
    x, y = matrix(_variations(random.Random(12), fillers, max(1, VARIATIONS // 3)))
    scores = x @ model.weights.T
    loss = lambda t: -np.log(_softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss)
    # The calibrated probability that all but one in a hundred right predictions reach.
    p = _softmax(scores / model.temperature)
    right = p.argmax(axis=1) == y
    model.threshold = float(np.quantile(p.max(axis=1)[right], 0.01)) if right.any() else 0.5
    return model


_TEMPLATE_GRAMS = {
    family: [{g for g in grams(words_of(t)) if " " in g} for t in texts] for family, texts in TEMPLATES.items()
}


def likeness(words: list[str], family: str) -> float:
    """The largest share of a template's 2- and 3-grams that the words have, or of theirs if they have fewer."""
    own = {g for g in grams(words) if " " in g}
    if not own:
        return 0.0
    return max(len(own & t) / max(min(len(t), len(own)), 3) for t in _TEMPLATE_GRAMS[family])


def best_template(words: list[str]) -> tuple[str, float]:
    return max(((f, likeness(words, f)) for f in TEMPLATES), key=lambda x: x[1])


def unwrapped(text: str) -> Iterator[tuple[int, str]]:
    """Number of the first line, and text, of each paragraph.

    A line of the width of wrapped text that ends within a sentence goes on in the next one; blank lines, and lines with
    nothing but comment marks, end a paragraph. Comment marks around a line are no part of it.
    """
    start, held = 0, []
    for number, line in enumerate(text.split("\n")):
        bare = _MARKS.sub("", line)
        if held and not bare:
            yield start, " ".join(held)
            held = []
        if not bare:
            continue
        start = start if held else number
        held.append(bare)
        if not _WRAPPED[0] <= len(line.strip()) <= _WRAPPED[1] or bare[-1] in ".!?:":
            yield start, " ".join(held)
            held = []
    if held:
        yield start, " ".join(held)


def paragraphs(text: str) -> Iterator[tuple[int, list[str]]]:
    """Number and words of each paragraph; a long one comes in overlapping windows under one number."""
    for number, paragraph in unwrapped(text):
        words = words_of(paragraph)
        if len(words) <= WINDOW:
            if words:
                yield number, words
        else:
            for i in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                yield number, words[i : i + WINDOW]


FOUND = "array<struct<paragraph: int, family: string, probability: double, likeness: double>>"


def findings(model: Model, pairs: set[int], text: str) -> list[dict]:
    """What the paragraphs of a text hold, one entry per paragraph and family.

    A paragraph without a 2- or 3-gram of the model could not be confirmed; it is passed over.
    """
    some = [(number, words, at) for number, words in paragraphs(text) if pairs.intersection(at := model.known(words))]
    if not some:
        return []
    best: dict[tuple[int, str], dict] = {}
    for (number, words, _), p in zip(some, model.probabilities([at for _, _, at in some])):
        k = int(p.argmax())
        family, alike = model.classes[k], 0.0
        if family == NONE:
            continue
        if family != UNKNOWN:
            alike = likeness(words, family)
            if p[k] < model.threshold or alike < CONFIRMED:
                family = UNKNOWN
        entry = {"paragraph": number, "family": family, "probability": float(p[k]), "likeness": alike}
        if (number, family) not in best or best[number, family]["probability"] < entry["probability"]:
            best[number, family] = entry
    return list(best.values())


def scanned(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``families`` (confirmed, sorted), ``n_unknown`` paragraphs, and all ``found``.

    Null and empty texts have no findings. Rows with equal or null ids are scanned apart. Other columns are not read.
    """
    model = model or fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = F.col(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pairs = {i for g, i in model.features.items() if " " in g}
        item = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])
        for batch in batches:
            found = [findings(model, pairs, t) if (t := batch.column(1)[i].as_py()) else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["id", "found"])

    rows = docs.select(kind.cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"id string, found {FOUND}")
    names = F.transform("found", lambda x: x["family"])
    return rows.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.array_sort(F.array_distinct(F.filter(names, lambda x: x != UNKNOWN))).alias("families"),
        F.size(F.filter(names, lambda x: x == UNKNOWN)).alias("n_unknown"), "found",
    )
