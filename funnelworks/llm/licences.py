"""Licence scans by a trained paragraph classifier, in DataFrame operations alone.

Paragraphs are what blank lines part.  Their words and word pairs are the sparse
inputs of a multinomial logistic regression over licence families, ``none`` and
``unknown``; the last is learned from notices whose naming words are replaced, and
the probabilities are calibrated by a temperature and a threshold that variants and
whole families unseen in training decide.  A family is confirmed if the paragraph
has a template's naming words and half of its word pairs.

Inputs are n-grams with at least one telling word of the templates; a paragraph
without such a word has no inputs and is ``none`` whatever the weights, so whole
texts are first asked for telling words by one pass over their words.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dropped, staged

NONE, UNKNOWN = "none", "unknown"

#: Notices by which works state their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the terms of the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying is prohibited.",
    ),
}

#: Paragraphs that use such words and state no licence.
NEAR_MISSES = (
    "He renewed his driving license last week.",
    "The license plate was reported stolen in Boston.",
    "She obtained a fishing license and went to the lake.",
    "A software version was released in March.",
    "The public library is free and open to any person.",
    "Apache helicopters were seen above the valley.",
    "MIT students presented their work at the conference.",
    "The general public was invited to the exhibition.",
    "They were granted permission to use the hall.",
    "All rooms are reserved until Sunday.",
    "Human rights are universal and must be protected.",
    "The domain name was registered by a corporation.",
    "Several copies of the book were distributed for free.",
    "Please read the terms and conditions before you travel.",
    "The common sense of the creative writer was praised.",
    "The foundation published a report on the free press.",
    "The library is open from nine to five.",
    "Version two of the document follows the above form.",
    "The source of the river lies in the mountains.",
    "It is subject to change without notice.",
    "The commercial was shown between the programs.",
    "Attribution of the painting to the master is disputed.",
    "The wildebeest and the gnu live on the plains.",
    "The charge was modified under the new law.",
    "You may use this room until it is needed.",
    "This is a work of the early period.",
    "International copies of the magazine arrive late.",
    "The publisher released the second part of the work.",
)

_WORD = re.compile(r"[a-z0-9]+")
#: Words that say nothing on their own.
_COMMON = frozenset("a above all along an and any are as at be by can except file following for free from have if in into is it its later list may met not notice of on or part received should source terms that the their this to under use used was were with without you your published work form code program library document text project copy copies person portions international version 0 1 2 3 4 v http www org".split())
#: Copies of each template with words dropped, joined and added, for training; and as many for calibration.
VARIANTS = 24
#: Rounds in which a third of the families is held out to see what probability unseen families get.
ROUNDS = 3
#: Share of a template's word pairs that a confirmed paragraph has.
CONFIRM = 0.5


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def telling_words() -> list[str]:
    return sorted({w for group in TEMPLATES.values() for t in group for w in words_of(t)} - _COMMON)


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]
    #: n-gram -> a weight for each class; what it has for ``none`` is 0 less the others.
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    #: A family needs this probability.
    threshold: float


def naming_words(template: str) -> list[str]:
    """Telling words of a template that no other family's templates have."""
    own = next(f for f, group in TEMPLATES.items() if template in group)
    others = {w for f, group in TEMPLATES.items() if f != own for t in group for w in words_of(t)}
    return sorted(set(words_of(template)) & set(telling_words()) - others)


def _variant(words: list[str], rng: random.Random, fillers: list[str]) -> list[str]:
    out = [w for w in words if rng.random() > 0.08] or words
    at = rng.randint(0, len(out))
    some = [rng.choice(fillers) for _ in range(rng.choice((0, 0, 1, 3)))]
    return out[:at] + some + out[at:]


def _sample(families: list[str], rng: random.Random) -> tuple[list[set[str]], list[str]]:
    """Inputs and classes: variants of the families' templates, of those without their names, and of near misses; and texts without inputs."""
    telling = set(telling_words())
    fillers = sorted({w for t in NEAR_MISSES for w in words_of(t)} - telling)
    xs, ys = [], []

    def add(words: list[str], label: str) -> None:
        xs.append(ngrams(words))
        ys.append(label)

    for family in families:
        for template in TEMPLATES[family]:
            own, names = words_of(template), set(naming_words(template))
            for k in range(VARIANTS):
                add(own if k == 0 else _variant(own, rng, fillers), family)
            rest = set(own) & telling - names
            # A notice without its name may be another family's, as that of a licence with fewer conditions.
            another = any(set(words_of(t)) & telling <= rest for f in families if f != family for t in TEMPLATES[f])
            for _ in range(VARIANTS if names and not another else 0):
                add(_variant([rng.choice(fillers) if w in names else w for w in own], rng, fillers), UNKNOWN)
    for template in NEAR_MISSES:
        own = words_of(template)
        for k in range(VARIANTS):
            add(own if k == 0 else _variant(own, rng, fillers), NONE)
    for _ in range(4 * VARIANTS):
        add([], NONE)
    return xs, ys


def _matrix(rows: list[set[str]], index: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(rows), len(index)))
    for i, row in enumerate(rows):
        out[i, [index[g] for g in row if g in index]] = 1
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _fit(families: list[str], rng: random.Random) -> tuple[tuple[str, ...], dict[str, int], np.ndarray, np.ndarray]:
    classes, telling = (NONE, UNKNOWN, *families), set(telling_words())
    xs, ys = _sample(families, rng)
    seen = Counter(g for x in xs for g in x if telling & set(g.split()))
    index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= VARIANTS // 2))}
    x, y = _matrix(xs, index), np.eye(len(classes))[[classes.index(c) for c in ys]]
    w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(300):
        d = (_softmax(x @ w + b) - y) / len(x)
        speed_w, speed_b = 0.9 * speed_w - (x.T @ d + 1e-4 * w), 0.9 * speed_b - d.sum(0)
        w, b = w + 1.5 * speed_w, b + 1.5 * speed_b
    return classes, index, w, b


@lru_cache(maxsize=1)
def train(seed: int = 11) -> LicenceModel:
    """Fit on variants of the templates and near misses; bounded by their number, the same at every run.

    In rounds, a third of the families is held out: their notices are ``unknown`` to a
    model of the others.  What it says of those, and of new variants of the others,
    decides the temperature (by likelihood) and the threshold (by balanced accuracy).
    """
    rng = random.Random(seed)
    every = list(TEMPLATES)
    logits, wanted = [], []
    for k in range(ROUNDS):
        held = every[k::ROUNDS]
        classes, index, w, b = _fit([f for f in every if f not in held], rng)
        xs, ys = _sample(every, rng)
        logits.append((_matrix(xs, index) @ w + b, np.array([classes.index(UNKNOWN if y in held else y) for y in ys])))

    def loss(t: float) -> float:
        return float(np.mean(np.concatenate([-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12) for z, y in logits])))

    temperature = min((t / 10 for t in range(2, 41)), key=loss)
    for z, y in logits:
        p = _softmax(z / temperature)
        licence = y != 0
        wanted += zip(p[licence, 2:].max(1).tolist(), ((y[licence] > 1) & (p[licence, 2:].argmax(1) + 2 == y[licence])).tolist(), strict=True)
    high, known = (np.array(x) for x in zip(*wanted, strict=True))
    threshold = max((t / 100 for t in range(50, 100)), key=lambda t: float((high[known] >= t).mean() + (high[~known] < t).mean()))
    classes, index, w, b = _fit(every, rng)
    return LicenceModel(classes, {g: tuple(w[i]) for g, i in index.items()}, tuple(b), temperature, threshold)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: str) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def scan_licences(documents: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Paragraphs of ``documents`` (doc_id, text) that state a licence.

    Columns: doc_id, paragraph (what blank lines part, from 0), family (``unknown`` if it
    looks like a licence and no family reaches the model's threshold), probability
    (of the likeliest family), confirmed, similarity (share of word pairs of the
    nearest template of the likeliest family whose naming words it has, else 0) and
    text (the paragraph).  Of equally likely families the first by order of the
    classes.  Null and empty texts have none; very long texts and paragraphs are read
    whole; an empty table gives no rows; repeated rows are scanned each.  Other
    columns are not read.
    """
    spark = documents.sparkSession
    model = model or train()
    telling = F.array(*[F.lit(w) for w in telling_words()])
    marked = documents.select("doc_id", "text").where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), telling)).withColumn("row", F.monotonically_increasing_id())
    blocks = marked.select("doc_id", "row", F.posexplode(F.split("text", "\n[\\x20\\x09-\\x0D]*\n")).alias("paragraph", "line")).withColumn("words", _words(F.col("line"))).where(F.arrays_overlap("words", telling))
    lines = staged(blocks, "licence-lines")
    grams = lines.select("row", "paragraph", F.explode(F.array_distinct(F.concat("words", _pairs("words")))).alias("gram"))
    columns = [f"w{i}" for i in range(len(model.classes))]
    # As many rows as the model has inputs: the templates bound them.
    weights = F.broadcast(spark.createDataFrame([(g, *map(float, w)) for g, w in model.weights.items()], ", ".join(["gram string", *[f"{c} double" for c in columns]])))
    sums = grams.join(weights, "gram").groupBy("row", "paragraph").agg(*[F.sum(c).alias(c) for c in columns])
    logits = F.array(*[(F.col(c) + F.lit(float(b))) / model.temperature for c, b in zip(columns, model.bias, strict=True)])
    # Written tables end the plans here: expressions that use each other would be written out again and again in one plan.
    scaled = staged(sums.select("row", "paragraph", logits.alias("z")).select("row", "paragraph", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("p")), "licence-scores")
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.slice("p", 3, len(model.classes)))
    judged = scaled.where(F.col("p")[0] / total < 0.5).select("row", "paragraph", (best / total).alias("probability"), F.array(*[F.lit(x) for x in model.classes])[F.array_position(F.slice("p", 3, len(model.classes)), best).cast("int") + 1].alias("likeliest"))
    judged = staged(judged.withColumn("family", F.when(F.col("probability") >= model.threshold, F.col("likeliest")).otherwise(F.lit(UNKNOWN))), "licence-verdicts")
    dropped(scaled)
    found = judged.join(lines, ["row", "paragraph"])
    rows = [(family, naming_words(t), sorted({f"{a} {b}" for a, b in zip(words_of(t), words_of(t)[1:], strict=False)})) for family, group in TEMPLATES.items() for t in group]
    templates = F.broadcast(spark.createDataFrame(rows, "likeliest string, names array<string>, pairs array<string>"))
    alike = F.when(F.size(F.array_intersect("names", "words")) == F.size("names"), F.size(F.array_intersect(_pairs("words"), "pairs")) / F.size("pairs")).otherwise(0.0)
    # A template without naming words has to be there whole.
    enough = alike >= F.when(F.size("names") > 0, CONFIRM).otherwise(1.0)
    nearest = found.join(templates, "likeliest").groupBy("row", "paragraph").agg(F.max(alike).alias("similarity"), F.max(enough).alias("enough"))
    found = found.join(nearest, ["row", "paragraph"])
    return found.select("doc_id", "paragraph", "family", "probability", (F.col("enough") & (F.col("family") != UNKNOWN)).alias("confirmed"), "similarity", F.col("line").alias("text"))
