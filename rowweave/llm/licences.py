"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over words and word pairs, made sparse by an L1 penalty, tells licence families and
"unknown" apart. It is trained on TEMPLATES and on what is made of them (a bounded set, on the driver, in seconds); its few
hundred weights are a broadcast table. What has none of the words in anchors() is unknown without further ado: texts are
tested for them first, then lines. A paragraph ends at a blank line; its lines are scored one by one and, so that wrapped
statements are found, in windows of WIDTH words of all its lines. The class "unknown" is calibrated on paragraphs that were
held out: a temperature is fitted, and below MIN_PROBABILITY a line is unknown. Every family of at least MIN_COMPARED is
compared: it counts once enough word pairs of one of its templates are there, with a word or a pair that only this family has
(a pair, if it isn't the line's most probable), and nothing that denies it (NEGATED). The scan is DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_PROBABILITY, MIN_SHARED, MIN_COMPARED = 0.5, 0.6, 0.01
#: Windows begin at every half of their width, so that a template of up to half a window is whole in one of them.
WIDTH = 64
UNKNOWN = "unknown"

#: Sentences by which a text states its licence, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'SPDX-License-Identifier: Apache-2.0',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        'SPDX-License-Identifier: BSD-3-Clause',
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "The text is available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work may be shared for noncommercial purposes under CC BY-NC.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL v3.",
        'SPDX-License-Identifier: GPL-3.0-or-later',
        'You should have received a copy of the GNU General Public License along with this program.',
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL v3.",
        'SPDX-License-Identifier: LGPL-2.1-or-later',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The MIT License (MIT)",
        'SPDX-License-Identifier: MIT',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Released under the MPL 2.0.",
        'SPDX-License-Identifier: MPL-2.0',
    ],
    "agpl": [
        'This work is licensed under the GNU Affero General Public License, version 3.',
        'Licensed under the AGPL v3.',
        'SPDX-License-Identifier: AGPL-3.0-only',
    ],
    "boost": [
        'Distributed under the Boost Software License, Version 1.0.',
        'SPDX-License-Identifier: BSL-1.0',
    ],
    "cc0": [
        'Licensed under CC0 1.0 Universal.',
        'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
        'SPDX-License-Identifier: CC0-1.0',
    ],
    "epl": [
        'Licensed under the Eclipse Public License, version 2.0.',
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License',
        'Available under the terms of the Eclipse Public License.',
        'SPDX-License-Identifier: EPL-2.0',
    ],
    "isc": [
        'Licensed under the ISC License.',
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
        'SPDX-License-Identifier: ISC',
    ],
    "unlicense": [
        'This is free and unencumbered software released into the public domain.',
        'Released under the Unlicense.',
        'SPDX-License-Identifier: Unlicense',
    ],
}
#: Sentences with such words that state no licence.
NO_LICENCE = [
    "A driving license is required of every driver.",
    "The license fee was paid by the company last year.",
    "She was licensed to practise medicine in two states.",
    "The film was released in May under another title.",
    "This version is under test and may not be used.",
    "The general public was not admitted to the work.",
    "All rights reserved.",
    "Version 3 is better than version 2.0 in most cases.",
    "Permission to enter was granted free of charge.",
    "The foundation published its terms of use.",
    "Students at MIT and engineers at Mozilla built the software.",
    "The Apache helicopter took part in the exercise.",
    "The creative director left the commons to the public.",
    "Attribution of the painting is uncertain.",
    "You may use this file and a copy of the source.",
    "The conditions are met in source and in form.",
    "International trade is free for any person.",
    "Read the license before you use the software.",
    "Sold under license by a third party.",
    "It is said that the following is provided that it can be met, with or without modification.",
    "They hereby ask that any person in the form of this kind be governed by what the source has found.",
    "Subject to what may be shared, the code was published as free text for all purposes.",
    "Terms apply; copies are available with additional files and documentation, v. 4.0 and v3 included.",
    "Use and redistribution of binary forms is associated with this library and its software.",
    "Your compliance with it was obtained, and you can modify or deal in it at no charge.",
    "The work is under way and can be found in the file.",
    'SPDX-License-Identifier: LicenseRef-Proprietary',
    'Licensed under the terms of a written agreement with the company.',
    'The software is licensed, not sold, to you.',
    'Released under an embargo, the report was free of charge.',
    'The public domain of the name was sold without prior written permission.',
]
#: Word pairs by which a sentence says that a licence is not meant.
NEGATED = ["longer available", "longer distributed", "longer licensed", "longer released", "never licensed", "never released", "nor licensed", "nor released", "not available", "not covered", "not distributed", "not licensed", "not released", "not under", "t licensed", "t released"]
_BETWEEN = re.compile("[^0-9a-z\x80-\U0010ffff]+")


def _words(text: str) -> list[str]:
    return [x for x in _BETWEEN.split(text.translate(str.maketrans(common.UPPER, common.LOWER))) if x]


def features(text: str) -> list[str]:
    """The distinct words and word pairs of a paragraph."""
    w = _words(text)
    return sorted({*w, *map(" ".join, zip(w, w[1:]))})


def examples(seed: int = 7) -> tuple[list[tuple[list[str], str]], list[tuple[list[str], str]]]:
    """(training, held out): features and family. Templates as they are, within other words, without a word; and of each as
    many broken ones (its words in any order, or the half of them) that are unknown."""
    rng, found = np.random.default_rng(seed), []
    other = sorted({w for s in NO_LICENCE for w in features(s) if " " not in w})
    for family, texts in TEMPLATES.items():
        for text in texts:
            w = text.split()
            found.append((features(text), family))
            if re.search("(?i)licensed|released", text):
                found += [(features(re.sub("(?i)(licensed|released)", rf"{no} \1", text, count=1)), UNKNOWN) for no in ("is not", "no longer", "never")]
            for _ in range(3):
                a, b = (" ".join(rng.choice(other, int(rng.integers(1, 12)))) for _ in range(2))
                found.append((features(f"{a} {text} {b}"), family))
                if len(w) > 6:
                    drop = int(rng.integers(len(w)))
                    found.append((features(" ".join(w[:drop] + w[drop + 1 :])), family))
                found.append((features(" ".join(rng.permutation(other)[: int(rng.integers(3, 20))])), UNKNOWN))
                plain = [x for x in features(text) if " " not in x and x not in _telling(family)]
                found.append((features(" ".join(rng.permutation(plain)[: max(1, len(plain) // 2)])), UNKNOWN))
    found += [(features(s), UNKNOWN) for s in NO_LICENCE for _ in range(2)]
    held = rng.random(len(found)) < 0.25
    return [x for x, h in zip(found, held, strict=True) if not h], [x for x, h in zip(found, held, strict=True) if h]


def _telling(family: str) -> set[str]:
    """Words that are in templates of this family only."""
    own, others = ({w for s in texts for w in features(s)} for texts in (TEMPLATES[family], [s for f, ts in TEMPLATES.items() if f != family for s in ts] + NO_LICENCE))
    return own - others


@cache
def train(penalty: float = 0.002, steps: int = 300) -> tuple[list[str], list[tuple[str, list[float]]], list[float]]:
    """Classes (the first is unknown), the features that have a weight with their weights, and the classes' biases; all
    divided by the temperature that fits the held-out examples best."""
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    training, held = examples()
    names = sorted({f for fs, _ in training for f in fs})
    place = {f: i for i, f in enumerate(names)}

    def matrix(rows):
        x = np.zeros((len(rows), len(names)))
        for i, (fs, _) in enumerate(rows):
            x[i, [place[f] for f in fs if f in place]] = 1
        return x, np.array([classes.index(c) for _, c in rows])

    x, y = matrix(training)
    w, bias = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    rate = 4 * len(x) / np.linalg.norm(np.hstack([x, np.ones((len(x), 1))]), 2) ** 2
    momentum_w, momentum_b, t = w, bias, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        p = _softmax(x @ momentum_w + momentum_b)
        p[np.arange(len(y)), y] -= 1
        new_w = momentum_w - rate * (x.T @ p) / len(x)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = momentum_b - rate * p.mean(0)
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum_w, momentum_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - bias)
        w, bias, t = new_w, new_b, new_t
    x, y = matrix(held)
    z = x @ w + bias
    temperatures = np.geomspace(1, 8, 40)  # only ever less sure than the fit
    best = min(temperatures, key=lambda s: -np.log(np.maximum(_softmax(z / s)[np.arange(len(y)), y], 1e-12)).mean())
    used = np.flatnonzero(np.abs(w).sum(1) > 1e-9)
    return classes, [(names[i], (w[i] / best).tolist()) for i in used], (bias / best).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@cache
def anchors() -> list[str]:
    """Words of which every text with MIN_SHARED of the word pairs of a template has one: of each template so many, the
    least common first, that fewer pairs are without them than would be enough. A paragraph without any is unknown."""
    usual, out = Counter(w for s in NO_LICENCE for w in _words(s)), set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        pairs = {(a, b) for a, b in zip(_words(t), _words(t)[1:])}
        need = MIN_SHARED * len(pairs)
        for w in sorted({w for p in pairs for w in p}, key=lambda w: (w not in out, "licens" not in w, usual[w], -len(w), w)):
            if sum(not out & set(p) for p in pairs) < need:
                break
            out.add(w)
    return sorted(out)


def units(docs: DataFrame) -> DataFrame:
    """docs without text, and part, unit, w, matched: the words of each line (from 0) with an anchor of each paragraph (part) of
    text, and those of windows (-1 less the first word) of paragraphs of several lines; whether they have enough of a
    template's pairs. Windows that haven't can't be confirmed and are left out."""
    others = [c for c in docs.columns if c != "text"]
    known = F.array(*map(F.lit, anchors()))
    parts = docs.select(*others, F.posexplode(F.split("text", r"\n[ \t\r\f\x0B]*(?=\n)")).alias("part", "paragraph"))
    parts = parts.select(*others, "part", F.transform(F.split(F.trim(F.col("paragraph"), F.lit("\n")), "\n"), common.words).alias("lines"))
    parts = parts.select(*others, "part", "lines", F.when(F.size("lines") > 1, F.flatten("lines")).otherwise(F.array().cast("array<string>")).alias("all"))
    lines = F.transform("lines", lambda x, i: F.struct(i.alias("unit"), x.alias("w")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - WIDTH // 2 - 1, F.lit(0)), F.lit(WIDTH // 2))
    windows = F.transform(starts, lambda x: F.struct((-1 - x).alias("unit"), F.slice("all", x + 1, WIDTH).alias("w")))
    each = F.filter(F.concat(lines, windows), lambda u: F.arrays_overlap(u["w"], known))
    each = parts.select(*others, "part", F.inline(each))
    templates = F.array(*(F.array(*map(F.lit, (x for x in features(t) if " " in x))) for ts in TEMPLATES.values() for t in ts))
    matched = F.exists(F.array(pairs_of(F.col("w"))), lambda p: F.exists(templates, lambda t: F.size(F.array_intersect(t, p)) >= MIN_SHARED * F.size(t)))
    return each.withColumn("matched", matched).where((F.col("unit") >= 0) | F.col("matched"))


def pairs_of(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))


def suspects(docs: DataFrame, *keep: str) -> DataFrame:
    """row, keep, text of each row of docs (keep, text), stored so that rows keep their number; text is null if it has no anchor."""
    docs = common.pick(docs, *dict.fromkeys((*keep, "text")))
    anchored = F.arrays_overlap(common.words(F.col("text")), F.array(*map(F.lit, anchors())))
    return common.store(docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.when(anchored, F.col("text")).alias("text")), "suspects")


def scan(rows: DataFrame) -> DataFrame:
    """row, part, unit, family, probability, shared, confirmed: the lines of rows (row, text: what suspects() gave) that the
    classifier takes for a licence or that are confirmed to be one, and of paragraphs that have one in joined lines only its
    first window; shared: the part of the best template's word pairs that they have. Families of equal probability are all
    the most probable one. Null, empty and wordless texts have none."""
    spark = rows.sparkSession
    classes, weights, biases = train()
    if max(range(len(biases)), key=biases.__getitem__) != 0:
        raise ValueError("a paragraph without any feature must be unknown")
    table = F.broadcast(spark.createDataFrame([(f, *ws) for f, ws in weights], ["feature", *(f"w{i}" for i in range(len(classes)))]))
    pairs = pairs_of(F.col("w"))
    each = common.store(units(rows.select("row", "text").where("text is not null")), "units")
    scored = each.select("row", "part", "unit", "matched", F.explode(F.array_distinct(F.concat("w", pairs))).alias("feature"))
    sums = scored.join(table, "feature").groupBy("row", "part", "unit", "matched").agg(*(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(classes))))
    logits = F.array(*(F.col(f"w{i}") + b for i, b in enumerate(biases)))
    names = F.array(*map(F.lit, classes))
    # one after the other inside lambdas: else each family's expression would hold those of all again
    highest = F.transform(F.array(logits), lambda z: F.struct(z.alias("z"), F.array_max(z).alias("top")))
    bound = F.transform(highest, lambda s: F.struct(s["z"].alias("z"), s["top"].alias("top"), F.aggregate(s["z"], F.lit(0.0), lambda t, z: t + F.exp(z - s["top"])).alias("total")))
    each_family = F.transform(bound, lambda s: F.transform(s["z"], lambda z, i: F.struct(F.get(names, i).alias("family"), (F.exp(z - s["top"]) / s["total"]).alias("probability"), (z == s["top"]).alias("top"))))
    likely = lambda f: F.col("matched") & (f["probability"] >= MIN_COMPARED) | (F.col("unit") >= 0) & f["top"] & (f["probability"] >= MIN_PROBABILITY)
    families = F.filter(F.flatten(each_family), lambda f: (f["family"] != UNKNOWN) & likely(f))
    found = sums.select("row", "part", "unit", families.alias("families")).where(F.size("families") > 0)
    # what was found, beside the templates of their families
    again = each.select("row", "part", "unit", "w").join(found, ["row", "part", "unit"]).select("row", "part", "unit", "w", F.inline("families"))
    again = again.withColumn("pairs", F.when(F.size("w") > 1, pairs).otherwise(F.col("w")))
    telling = {f: sorted(_telling(f)) for f in TEMPLATES}
    known = F.broadcast(
        spark.createDataFrame(
            [(f, [[x for x in features(t) if " " in x] for t in ts], [x for x in telling[f] if " " not in x], [x for x in telling[f] if " " in x]) for f, ts in TEMPLATES.items()],
            "family string, templates array<array<string>>, own_words array<string>, own_pairs array<string>",
        )
    )
    shared = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.size(t)))
    line, top = F.col("unit") >= 0, F.col("top") & (F.col("probability") >= MIN_PROBABILITY)
    own = F.arrays_overlap("own_pairs", "pairs") | line & top & F.arrays_overlap("own_words", "w")
    denied = F.arrays_overlap("pairs", F.array(*map(F.lit, NEGATED)))
    again = again.join(known, "family").withColumn("shared", shared)
    again = again.withColumn("confirmed", (F.col("shared") >= MIN_SHARED) & own & ~denied)
    again = again.where(F.col("confirmed") | line & top)
    # joined lines count where no line of the paragraph is confirmed by itself, and once
    same = Window.partitionBy("row", "part", "family")
    again = again.withColumn("alone", F.max(line & F.col("confirmed")).over(same)).withColumn("first", F.max(F.when(~line, F.col("unit"))).over(same))
    again = again.where(line | ~F.col("alone") & (F.col("unit") == F.col("first")))
    return again.select("row", "part", "unit", "family", "probability", "shared", "confirmed")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: families confirmed (sorted, comma-joined; empty if none), their paragraphs, unconfirmed ones, the
    highest probability of these (0 if none). Repeated rows and null ids are rows like any other; null and empty texts have none."""
    rows = suspects(common.table(spark, sf_dir, "documents"), "doc_id")
    found = scan(rows).groupBy("row").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.sum(F.col("confirmed").cast("long")).alias("n_licence"),
        F.sum((~F.col("confirmed")).cast("long")).alias("n_unconfirmed"),
        F.max("probability").alias("probability"),
    )
    out = rows.select("row", "doc_id").join(found, "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_licence", "n_unconfirmed")]
    return out.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), *counts, F.coalesce("probability", F.lit(0.0)).alias("probability"))
