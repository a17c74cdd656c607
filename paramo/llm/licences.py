"""Licence scans: a trained paragraph classifier whose predictions templates confirm."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramo.llm.common import give_back, slices

# Notices and opening sentences by which public licences are given, per family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Licensed under CC0 1.0 Universal, a public domain dedication.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission.",
        "This document is confidential and proprietary. Unauthorized copying is prohibited.",
    ],
}
# Short names by which public licences are given, per family.
SHORT = {
    "MIT": ["MIT License", "The MIT License (MIT)", "MIT licensed", "License: MIT"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "License: Apache-2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "New BSD License", "License: BSD-3-Clause"],
    "GPL": ["GNU GPL v3", "GNU GPL v2", "GPL v3", "GNU General Public License v3.0", "License: GPL-3.0"],
    "LGPL": ["GNU LGPL v2.1", "GNU LGPL v3", "LGPL v3", "GNU Lesser General Public License v3.0", "License: LGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "License: MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0", "License: CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "License: CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "License: CC-BY-NC-4.0"],
    "public domain": ["CC0 1.0 Universal", "Released into the public domain.", "License: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Copyright 2020. All rights reserved.", "Proprietary and confidential."],
}
#: Sentences about licences that give none, for the unknown class.
NEAR_MISSES = [
    "Please read the license carefully before you install anything.",
    "The driving license expired in March and was renewed.",
    "A license fee is due on the first of each month.",
    "The city released a report on public parking.",
    "Permission to park here is granted to residents only.",
    "Version 2.0 of the schedule was released on Monday.",
    "The general public is invited to the free concert.",
    "All software must be updated before the deadline.",
    "Copies of the minutes may be obtained at the office.",
    "The work was licensed to a publisher in 1998.",
]
UNKNOWN = "unknown"
#: Longest n-gram of words, and paragraphs of the unknown class that must have an n-gram which no licence has, for a weight of its own.
GRAMS, LEAST_UNKNOWN = 3, 3
KNOWN_WORDS = 300_000
STRIP = b".,;:!?()[]{}<>\"'`*#/\\|=-_"


def word_code(word: bytes) -> int:
    return zlib.crc32(word.strip(STRIP) or word) + 1


def gram_hashes(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, paragraph) of the distinct word 1- to 3-grams of paragraphs laid out one after another."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    hashes, owners = [], []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        k = len(codes) - n + 1
        if k <= 0:
            break
        mixed = (mixed[:k] ^ codes[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        inside = of[:k] == of[n - 1:]
        hashes.append(mixed[inside])
        owners.append(of[:k][inside])
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])) if len(hashes) else np.zeros(0, bool)
    return hashes[new], owners[new]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """Weights of the known n-grams (``keys``, ascending; the last row is that of all others, 0) and biases per class, class names
    (UNKNOWN first) and the calibrated temperature."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float = 1.0

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def probabilities(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of every paragraph; each n-gram that it has counts once, as in training."""
        hashes, owners = gram_hashes(codes, sizes)
        known = self.rows(hashes)
        sums = np.zeros((len(sizes), len(self.classes)))
        use = np.nonzero(known < len(self.keys))[0]
        for k in range(len(self.classes)):
            sums[:, k] = np.bincount(owners[use], self.weights[known[use], k], len(sizes))
        grams = np.maximum(np.bincount(owners, minlength=len(sizes)), 1)
        return softmax((sums / np.sqrt(grams)[:, None] + self.bias) / self.temperature)


def words(paragraph: str) -> list[bytes]:
    return paragraph.lower().encode().split()


def encoded(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([word_code(w) for p in paragraphs for w in p], np.uint64), np.array([len(p) for p in paragraphs]))


def variants(template: str, rng: np.random.Generator, count: int) -> list[list[bytes]]:
    """The template, its halves, and copies behind comment marks or names with a word lost or added."""
    base = words(template)
    out = [base]
    if len(base) >= 12:
        out += [base[:len(base) // 2], base[len(base) // 2:]]
    leads = [b"#", b"//", b"*", b"copyright 2020 the authors.", b"(c) 2019 example", b"note:", b"--"]
    for _ in range(count):
        copy = list(base)
        if len(copy) > 5 and rng.random() < 0.4:
            del copy[rng.integers(len(copy))]
        if rng.random() < 0.3:
            copy.insert(int(rng.integers(len(copy) + 1)), b"the")
        if rng.random() < 0.5:
            copy = leads[rng.integers(len(leads))].split() + copy
        out.append(copy)
    return out


def train(unknown: list[list[bytes]], epochs: int = 12, rate: float = 0.5, seed: int = 42) -> Model:
    """Multinomial logistic regression by stochastic gradient descent, calibrated on a quarter held back.

    One temperature divides all scores, chosen for the least log loss on the rows held back."""
    rng = np.random.default_rng(seed)
    classes = [UNKNOWN, *TEMPLATES]
    unknown = [p for p in unknown if p]
    rows = [(p, 0) for p in unknown] + [(words(s), 0) for s in NEAR_MISSES for _ in range(10)]
    # words of licences give none by themselves, however often
    alone = {w for name in TEMPLATES for t in TEMPLATES[name] + SHORT[name] for w in words(t)}
    rows += [([w] * n, 0) for w in sorted(alone) for n in (1, 2, 3) for _ in range(8)]
    rows += [(v, k) for k, name in enumerate(classes) if k for t in TEMPLATES[name] + SHORT[name] for v in variants(t, rng, 24)]
    held = rng.random(len(rows)) < 0.25
    grams = [gram_hashes(*encoded([p]))[0] for p, _ in rows]
    every, times = np.unique(np.concatenate(grams[:len(unknown)] + [np.zeros(0, np.uint64)]), return_counts=True)
    keys = np.unique(np.concatenate([every[times >= LEAST_UNKNOWN], *grams[len(unknown):]]))
    model = Model(keys, np.zeros((len(keys) + 1, len(classes)), np.float32), np.zeros(len(classes), np.float32), classes)
    grams = [model.rows(g) for g in grams]
    sizes = [len(g) for g in grams]
    grams = [g[g < len(keys)] for g in grams]
    learn = np.nonzero(~held)[0]
    for e in range(epochs):
        lr = np.float32(rate * (1 - e / epochs))
        for i in rng.permutation(learn):
            ids = grams[i]
            share = np.float32(1 / np.sqrt(sizes[i]))
            z = model.weights[ids].sum(axis=0) * share + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[rows[i][1]] -= 1
            model.weights[ids] -= lr * share * p
            model.bias -= lr * np.float32(0.1) * p
    back = [rows[i] for i in np.nonzero(held)[0]]
    if back:
        y = np.array([k for _, k in back])
        z = np.log(model.probabilities(*encoded([p for p, _ in back])) + 1e-30)
        loss = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.25, 4, 17)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def pairs_of(paragraph: list[bytes]) -> set:
    clean = [w.strip(STRIP) or w for w in paragraph]
    return set(zip(clean, clean[1:]))


def similarity(paragraph: list[bytes], templates: list[set]) -> float:
    """The largest share of word pairs that the paragraph and a template have in common, of the shorter of both."""
    own = pairs_of(paragraph)
    return max((len(own & t) / min(len(own), len(t)) for t in templates if own and t), default=0.0)


def fit(df: DataFrame, id_col: str, text_col: str, documents: int = 400, paragraphs: int = 3000, most_bytes: int = 8 << 20, seed: int = 42) -> Model:
    """A model whose unknown class is learnt from paragraphs of every length of ``documents`` documents, those of the least hashes: at most
    ``paragraphs`` of them and ``most_bytes`` in all; these bounds are small enough for the driver."""
    ids = df.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(documents)
    lines = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select(
        F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) > 0).where(F.octet_length("line") <= most_bytes // 8)
    few = lines.distinct().orderBy(F.xxhash64(F.lit(seed), "line"), "line").limit(paragraphs)
    before = Window.orderBy(F.xxhash64(F.lit(seed), "line"), "line").rowsBetween(Window.unboundedPreceding, 0)  # of ``paragraphs`` rows at most
    rows = few.withColumn("_sum", F.sum(F.octet_length("line").cast("long")).over(before)).where(F.col("_sum") <= most_bytes).select("line").collect()
    known = [pairs_of(words(t)) for name in TEMPLATES for t in TEMPLATES[name] + SHORT[name]]
    return train([p for p in (words(r["line"]) for r in rows) if similarity(p, known) < 0.5], seed=seed)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, alike: float = 0.6,
         model: Model | None = None) -> DataFrame:
    """(id_col, paragraph, family, probability, similarity, confirmed): one row per paragraph that gives a licence.

    Paragraphs are the lines of a text (numbered from 0) that are not empty.  The distinct word 1- to 3-grams of a paragraph
    enter a sparse logistic regression over licence families and an unknown class; a paragraph is
    predicted if its best family has a calibrated probability of ``least`` or more.  Of families that are equally likely
    the first of TEMPLATES is taken.  ``similarity`` is the
    share of word pairs it has in common with the nearest template of the family, and ``confirmed`` says that this
    is ``alike`` or more.

    Null and empty texts have no rows.  A row with a null id is scanned and keeps its null id; repeated
    rows are reported each.  Other columns are not read.  An empty table gives an empty one.
    """
    model = fit(df, id_col, text_col) if model is None else model
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    held = source.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        templates = {k: [pairs_of(words(t)) for t in ts + SHORT[k]] for k, ts in TEMPLATES.items()}
        code: dict[bytes, int] = Codes()
        for batch in slices(batches, "text"):
            if len(code) > KNOWN_WORDS:
                code.clear()
            split, places = [], []
            for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                for j, line in enumerate((t or b"").lower().split(b"\n")):
                    found = line.split()
                    if found:
                        split.append(found)
                        places.append((i, j))
            rows = []
            at = 0
            while at < len(split):
                end, size = at, 0
                while end < len(split) and (end == at or size + len(split[end]) <= 1 << 17):
                    size += len(split[end])
                    end += 1
                part = split[at:end]
                p = m.probabilities(np.array([code[w] for line in part for w in line], np.uint64), np.array([len(x) for x in part]))
                best = p[:, 1:].argmax(axis=1) + 1
                for k in np.nonzero(p[np.arange(len(part)), best] >= least)[0].tolist():
                    family = m.classes[best[k]]
                    rows.append((*places[at + k], family, float(p[k, best[k]]), similarity(part[k], templates[family])))
                at = end
            if rows:
                own = batch.column("id").take(pa.array([r[0] for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]),
                     pa.array([r[4] for r in rows])], names=[id_col, "paragraph", "family", "probability", "similarity"])

    found = source.mapInArrow(give_back(run), f"`{id_col}` {id_type}, paragraph long, family string, probability double, similarity double")
    return found.withColumn("confirmed", F.col("similarity") >= alike)


class Codes(dict):
    """Codes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = word_code(word)
        return code
