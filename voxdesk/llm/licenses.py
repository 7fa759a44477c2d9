"""Licence statements: a paragraph classifier confirmed by templates.

Paragraphs are the lines of a text; one longer than a notice is judged by its
best window. A multinomial logistic regression over word
unigrams and bigrams names a licence family or none. It is fitted on crops of
the templates below and on a bounded sample of the corpus's own paragraphs.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import as_bytes

# Customary notices and opening sentences of public licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v2.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Content is available under CC BY 3.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "Copyright 2024. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Notices too short for a word triple; a paragraph must equal one.
SHORT = {
    "apache-2.0": ["Apache License", "Apache-2", "Apache 2"],
    "mit": ["MIT License", "MIT Licence", "MIT-licensed"],
    "gpl": ["GPLv2", "GPLv3", "GPL v2", "GPL v3", "GPL-2", "GPL-3", "GNU GPL", "GPL License", "GPL Licence"],
    "lgpl": ["LGPLv2", "LGPLv3", "LGPL v2", "LGPL v3", "LGPL-2", "LGPL-3", "GNU LGPL", "LGPL License", "LGPL Licence"],
    "bsd": ["BSD License", "BSD Licence"],
    "mpl-2.0": ["MPL-2", "MPL v2", "MPLv2"],
    "cc-by": ["CC BY"],
    "cc0": ["CC0", "CC0 License", "CC0 Licence"],
}
UNKNOWN = "unknown"

#: Crops of templates by family, and corpus paragraphs, that the fit sees.
CROPS = 400
BACKGROUND = 8_000
#: Share of background paragraphs that may be called a licence.
FALSE_RATE = 0.0005
#: Windows of paragraphs longer than so many words; each size in steps of half of it.
SIZES = (8, 16, 32, 64)
#: Words between two template triples of one stretch, and the least share of a template that confirms a part of a paragraph.
GAP = 6
COVERED = 0.5
#: Log-odds of background paragraphs are counted in bins, so many to a unit, up to the last one.
BINS = 100
LAST_BIN = 3_000
#: Share of the paragraph's word triples that one template of the family must have.
CONFIRMED = 0.6
SEED = 4

_TOKEN_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if chr(c).isalnum() and c < 128 or c >= 128 or c == 10 else 0x20 for c in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_TOKEN_BYTES).split()


@dataclass
class Model:
    """Weights by class over a vocabulary of unigrams and bigrams; class 0 is unknown."""

    families: list[str]
    words: dict[bytes, int]
    pairs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: float = 0.5

    def probabilities(self, ids: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
        """Class probabilities of each line; ids are word numbers (-1: not in the vocabulary)."""
        total = np.maximum(2 * np.bincount(line, minlength=lines) - 1, 1)
        single = ids >= 0
        features, owners = [ids[single]], [line[single]]
        if len(ids) > 1 and len(self.pairs):
            both = single[:-1] & single[1:] & (line[:-1] == line[1:])
            code = ids[:-1][both] * len(self.words) + ids[1:][both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            known = self.pairs[at] == code
            features.append(len(self.words) + at[known])
            owners.append(line[:-1][both][known])
        feature, owner = np.concatenate(features), np.concatenate(owners)
        logits = np.column_stack([
            np.bincount(owner, self.weights[k][feature], minlength=lines) for k in range(len(self.families))
        ]) / total[:, None] + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def window_probabilities(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Class probabilities of windows of the words; as probabilities() of each window alone."""
        single = np.flatnonzero(ids >= 0)
        first, feature = single, ids[single]
        pair = single[:-1][np.diff(single) == 1] if len(self.pairs) else single[:0]
        code = ids[pair] * len(self.words) + ids[np.minimum(pair + 1, len(ids) - 1)]
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        known = self.pairs[at] == code if len(pair) else np.zeros(0, bool)
        pair, at = pair[known], at[known]
        total = np.maximum(2 * (end - start) - 1, 1)
        # A window has the words from start to end and the pairs that begin before its last word.
        words, pairs = np.searchsorted(first, [start, end]), np.searchsorted(pair, [start, end - 1])
        logits = np.empty((len(start), len(self.families)))
        for k in range(len(self.families)):
            of_words = np.concatenate([[0.0], np.cumsum(self.weights[k][feature])])
            of_pairs = np.concatenate([[0.0], np.cumsum(self.weights[k][len(self.words) + at])])
            summed = of_words[words[1]] - of_words[words[0]] + of_pairs[pairs[1]] - of_pairs[pairs[0]]
            logits[:, k] = summed / total + self.bias[k]
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))

    def line_probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        flat = [w for words in lines for w in words]
        owner = np.repeat(np.arange(len(lines)), [len(words) for words in lines])
        return self.probabilities(self.number(flat), owner, len(lines))


def triples(words: list[bytes]) -> set[tuple]:
    return set(zip(words, words[1:], words[2:], strict=False))


_TEMPLATE_TRIPLES = {f: [triples(tokens(t.encode())) for t in listed] for f, listed in TEMPLATES.items()}


def template_share(words: list[bytes], family: str) -> float:
    """The largest share of the words' triples that one template of the family has; 0 for fewer words."""
    own = triples(words)
    return max(len(own & known) for known in _TEMPLATE_TRIPLES[family]) / len(own) if own else 0.0


def covered_share(words: list[bytes], family: str) -> float:
    """The largest share of a template of the family that the words have, of those that they consist of as CONFIRMED asks."""
    own = triples(words)
    both = [(len(own & known), len(known)) for known in _TEMPLATE_TRIPLES[family]]
    return max((n / size for n, size in both if size and n >= CONFIRMED * len(own) and n), default=0.0)


_SHORT_FAMILY = {tuple(tokens(t.encode())): f for f, listed in SHORT.items() for t in listed}
_ANY_TRIPLE = set().union(*(known for listed in _TEMPLATE_TRIPLES.values() for known in listed))
_TRIPLE_STARTS = {t[0] for t in _ANY_TRIPLE}


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) from the first to the last word of template triples that stand near each other."""
    out = []
    for k in range(len(words) - 2):
        if words[k] in _TRIPLE_STARTS and (words[k], words[k + 1], words[k + 2]) in _ANY_TRIPLE:
            if out and k - out[-1][1] <= GAP:
                out[-1] = (out[-1][0], k + 3)
            else:
                out.append((k, k + 3))
    return out


def windows(words: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of the whole paragraph, of overlapping windows of SIZES and of its stretches of template triples."""
    n = len(words)
    out = [(0, n)] if n else []
    for size in SIZES:
        if n > size:
            out += [(k, k + size) for k in range(0, n - size, size // 2)] + [(n - size, n)]
    return out + [w for w in stretches(words) if w != (0, n)]


def crops(draw: np.random.Generator) -> list[tuple[list[bytes], str]]:
    """Stretches of the templates, whole ones among them, some with strange words around."""
    out = []
    for family, listed in TEMPLATES.items():
        for k in range(CROPS):
            words = tokens(listed[k % len(listed)].encode())
            if k >= 2 * len(listed):
                size = int(draw.integers(max(3, len(words) // 2), len(words) + 1)) if len(words) > 3 else len(words)
                at = int(draw.integers(0, len(words) - size + 1))
                words = words[at : at + size]
                if draw.random() < 0.3:
                    words = [b"\xff"] * int(draw.integers(1, 4)) + words
            out.append((words, family))
    return out


def background(docs: DataFrame, text_col: str) -> list[list[bytes]]:
    """About BACKGROUND paragraphs out of all lines, drawn by hash, that no template resembles."""
    lines = docs.select(F.explode_outer(F.split(text_col, "\n")).alias("line")).where("line RLIKE '[^\\\\s]'")
    rows = lines.count()
    share = min(1.0, BACKGROUND / max(rows, 1))
    distinct = lines.where(F.pmod(F.xxhash64("line"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    # A line that stands in a third of all documents is one line here.
    found = [tokens(r[0].encode()) for r in distinct.orderBy(F.xxhash64("line")).limit(2 * BACKGROUND).collect()]
    return [words for words in found if words and max(template_share(words, f) for f in TEMPLATES) < 0.5]


def fit(spark, examples: list[tuple[list[bytes], str]], strange: list[list[bytes]]) -> Model:
    """Fit on all examples; the vocabulary is the n-grams of the licence examples."""
    families = [UNKNOWN, *TEMPLATES]
    known = sorted({w for words, _ in examples for w in words if w != b"\xff"})
    words = {w: k for k, w in enumerate(known)}
    codes = {
        words[a] * len(words) + words[b]
        for listed, _ in examples for a, b in zip(listed, listed[1:], strict=False) if a in words and b in words
    }
    model = Model(families, words, np.array(sorted(codes), np.int64), np.zeros((len(families), 0)), np.zeros(len(families)))
    labelled = [(w, families.index(f)) for w, f in examples] + [(w, 0) for w in strange]
    size = len(words) + len(codes)
    rows = []
    for listed, label in labelled:
        ids = model.number(listed)
        total = max(2 * len(listed) - 1, 1)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        code = ids[:-1][both] * len(words) + ids[1:][both]
        at = np.minimum(np.searchsorted(model.pairs, code), len(codes) - 1)
        hit = np.concatenate([ids[ids >= 0], len(words) + at[model.pairs[at] == code]])
        where, many = np.unique(hit, return_counts=True)
        rows.append((float(label), Vectors.sparse(size, where.tolist(), (many / total).tolist())))
    table = spark.createDataFrame(rows, ["label", "features"]).coalesce(2).cache()
    fitted = LogisticRegression(family="multinomial", standardization=False, regParam=1e-5, maxIter=60).fit(table)
    table.unpersist()
    weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    model.weights, model.bias = np.zeros((len(families), size)), np.full(len(families), -np.inf)
    model.weights[: len(weights)], model.bias[: len(bias)] = weights, bias
    return model


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Fit on a bounded sample, then set the threshold by all paragraphs of docs."""
    draw = np.random.default_rng(SEED)
    lines = background(docs, text_col)
    # Windows are judged, so the fit sees one of each longer line, too.
    parts = [windows(words)[int(draw.integers(1, len(windows(words))))] for words in lines if len(words) > SIZES[0]]
    longer = [words for words in lines if len(words) > SIZES[0]]
    strange = [words[s:e] for words, (s, e) in zip(longer, parts, strict=True)]
    model = fit(docs.sparkSession, crops(draw), lines + strange)
    model.threshold = calibrate(docs, model, text_col)
    return model


def candidates(text: bytes, model: Model) -> tuple[int, list[tuple[int, str, float, float, float]]]:
    """(paragraphs, those more likely a licence than not).

    The latter are (line number, family, probability, template share, odds of any
    family) of their best window: a confirmed one if there is any, then that of
    the greatest odds. A part of a paragraph is confirmed only if it holds
    COVERED of the template too; a few words in common are no notice.
    """
    split = [line.split() for line in text.translate(_TOKEN_BYTES).split(b"\n")]
    places = [(k, s, e) for k, words in enumerate(split) for s, e in windows(words)]
    if not places:
        return 0, []
    line, start, end = np.array(places, np.int64).T
    offset = np.concatenate([[0], np.cumsum([len(words) for words in split])])[line]
    ids = model.number([w for words in split for w in words])
    odds = model.window_probabilities(ids, start + offset, end + offset)
    best = odds[:, 1:].argmax(axis=1) + 1
    found: dict[int, tuple] = {}
    for w in np.flatnonzero(odds[:, 0] < 0.5):
        k, own = int(line[w]), split[line[w]][start[w] : end[w]]
        family = model.families[best[w]]
        share = template_share(own, family)
        if share >= CONFIRMED and len(own) < len(split[k]) and covered_share(own, family) < COVERED:
            share = 0.0
        row = (share >= CONFIRMED, float(1 - odds[w, 0]), share, k, family, float(odds[w, best[w]]))
        found[k] = max(found.get(k, row), row)
    out = {k: (k, family, p, share, any_) for k, (_, any_, share, _, family, p) in found.items()}
    for w, (k, s, e) in enumerate(places):
        family = _SHORT_FAMILY.get(tuple(split[k])) if e - s == len(split[k]) < 3 else None
        if family:
            out[k] = (k, family, float(odds[w, model.families.index(family)]), 1.0, 1.0)
    return sum(1 for words in split if words), [out[k] for k in sorted(out)]


def _bin(odds: float) -> int:
    return min(LAST_BIN, max(0, int(BINS * np.log(odds / max(1 - odds, 1e-16)))))


def calibrate(docs: DataFrame, model: Model, text_col: str = "text") -> float:
    """The odds of any family that no more than FALSE_RATE of the background exceeds, and half at least.

    Background are all paragraphs that no template resembles. They are counted
    by bin in Spark, so the driver gets LAST_BIN + 2 rows at most. Odds in the
    last bin are not told apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_bytes(texts):
            n, found = candidates(text or b"", sent.value)
            counts = Counter(_bin(odds) for *_, share, odds in found if share < 0.5)
            counts[-1] = n - len(found)
            out.append([{"bin": k, "n": v} for k, v in counts.items() if v])
        return pa.array(out, pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())])))

    judge = F.arrow_udf(of, "array<struct<bin: int, n: bigint>>")
    counted = docs.select(F.explode_outer(judge(F.col(text_col))).alias("x")).where("x IS NOT NULL")
    counts = {r["bin"]: r["n"] for r in counted.groupBy("x.bin").agg(F.sum("x.n").alias("n")).collect()}
    left = FALSE_RATE * sum(counts.values())
    lowest = LAST_BIN
    while lowest > 0 and counts.get(lowest, 0) <= left:
        left -= counts.get(lowest, 0)
        lowest -= 1
    least = lowest if lowest == LAST_BIN or counts.get(lowest, 0) <= left else lowest + 1
    return float(1 / (1 + np.exp(-least / BINS)))


def paragraphs_of(text: bytes, model: Model) -> Iterator[tuple[int, str, float, float]]:
    """(line number, family, probability, template share) of the lines taken for a licence.

    The family is `unknown` if no template of the predicted one confirms it.
    """
    for k, family, probability, share, odds in candidates(text, model)[1]:
        if odds >= model.threshold:
            yield k, family if share >= CONFIRMED else UNKNOWN, probability, share


LINES_TYPE = "array<struct<line_no: int, family: string, probability: double, template_share: double>>"


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_paragraphs, licences) of each row: its lines taken for a licence statement.

    Paragraphs are lines with a character other than a blank. A null text has
    none. Rows are judged each on its own; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("family", pa.string()),
                               ("probability", pa.float64()), ("template_share", pa.float64())]))

    def of(texts: pa.Array) -> pa.Array:
        counts, found = [], []
        for text in as_bytes(texts):
            text = text or b""
            counts.append(sum(1 for line in text.split(b"\n") if line.strip()))
            names = ("line_no", "family", "probability", "template_share")
            found.append([dict(zip(names, row, strict=True)) for row in paragraphs_of(text, sent.value)])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, kind)], ["n", "licences"])

    judge = F.arrow_udf(of, f"struct<n: bigint, licences: {LINES_TYPE}>")
    return docs.select(id_col, judge(F.col(text_col)).alias("r")).select(
        id_col, F.col("r.n").alias("n_paragraphs"), F.col("r.licences").alias("licences")
    )


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_paragraphs, n_licences, n_unknown, families): confirmed families by name, comma-joined."""
    sure = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return scanned.select(
        id_col, "n_paragraphs", F.size(sure).cast("bigint").alias("n_licences"),
        (F.size("licences") - F.size(sure)).cast("bigint").alias("n_unknown"),
        F.array_join(families, ",").alias("families"),
    )
