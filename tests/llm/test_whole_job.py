"""Cases in which operators once did less than the whole job."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, documents
from voxdesk.llm import licenses, line_dedup, mixing, quality
from voxdesk.llm.common import Scratch

# Line dedup


def removed_of_all(rows):
    seen, out = [], {}
    for d, t in sorted(rows):
        out[d] = []
        for k, line in enumerate(t.split("\n")):
            words = set(WORD.findall(line.lower()))
            if not words:
                continue
            if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                out[d].append(k)
            seen.append(words)
    return {d: ",".join(map(str, v)) for d, v in out.items()}


def test_short_lines_can_be_removed(spark):
    rows = [
        (1, "All rights reserved.\nles.\n漢字漢字漢字\n\nred green blue grey"), (2, "all Rights reserved.\nles.\n\none two"),
        (3, "漢字漢字漢字\nblue grey red green black\nles les.\ntwo one"), (4, "les.\n \nreserved. all rights"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = line_dedup.line_counts(docs, Scratch(spark, "t"), min_words=1).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in found} == removed_of_all(rows)
    kept = line_dedup.drop_lines(docs, Scratch(spark, "t"), min_words=1)
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[4] == " "


def test_short_lines_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    found = line_dedup.line_counts(documents(spark), Scratch(spark, "t"), min_words=1).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in found} == removed_of_all(rows)

class Counting(Scratch):
    """Keeps how many rows the largest table of each name had."""

    def store(self, df, name):
        out = super().store(df, name)
        self.rows = getattr(self, "rows", {})
        self.rows[name] = max(self.rows.get(name, 0), out.count())
        return out


def test_near_copies_of_a_line_give_no_pair_for_each_two(spark):
    base = [f"word{k}" for k in range(30)]
    rows = [(k, " ".join([*base[: k % 29], f"own{k}", *base[k % 29 + 1 :]]) + f"\nline {k} alone") for k in range(300)]
    docs, scratch = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Counting(spark, "t")
    found = line_dedup.line_counts(docs, scratch).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in found} == removed_of_all(rows)
    assert max(n for name, n in scratch.rows.items() if name in ("pairs", "near")) < 30 * len(rows)


def test_sizes_at_both_ends_of_a_band_are_compared(spark):
    words = [f"word{k}" for k in range(80)]
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 10, 13, 15, 16, 17, 20, 26, 31, 32, 33, 40, 52, 63, 64, 65, 80]
    for order in (sizes, sizes[::-1]):
        rows = [(k, " ".join(words[:n])) for k, n in enumerate(order)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = line_dedup.line_counts(docs, Scratch(spark, "t")).collect()
        assert {r["doc_id"]: r["removed_lines"] for r in found} == removed_of_all(rows)


# Quality


def test_forest_reads_every_statistic():
    row = dict(zip(quality.FIELDS, (100, 500, 5, 2, 20, 30, 40, 20), strict=True))
    means = np.full(len(quality.RATED) + len(quality.LINED), 0.1)
    plain = quality.features(pd.DataFrame([row]), means)
    for name, value in (("n_dup_lines", 18), ("n_repeat_words", 50), ("n_words", 400)):
        assert not np.array_equal(plain, quality.features(pd.DataFrame([row | {name: value}]), means)), name
    draw = np.random.default_rng(1)
    many = pd.DataFrame({f: draw.integers(10, 30, 500) for f in quality.FIELDS} | {"n_words": 200, "n_lines": 100})
    many["n_dup_lines"] = draw.integers(0, 3, 500)
    odd = pd.concat([many.head(1), many.head(1).assign(n_dup_lines=80)])
    forest = quality.grow_forest(quality.features(many, means), shares=quality.SHARES)
    scores = forest.scores(quality.features(odd, means))
    assert scores[1] > scores[0]


# Licences


def fixed_model():
    """A model whose odds of any family follow from one word of a line of four."""
    words = {b"low": 0, b"high": 1, b"higher": 2}
    families = [licenses.UNKNOWN, *licenses.TEMPLATES]
    weights, bias = np.zeros((len(families), 3)), np.full(len(families), -np.inf)
    weights[1], bias[:2] = 7 * np.log([0.1 / 0.9, 0.9 / 0.1, 0.99 / 0.01]), 0
    return licenses.Model(families, words, np.zeros(0, np.int64), weights, bias)


def test_threshold_counts_every_paragraph(spark):
    lines = ["low plain words here"] * 19_990 + ["high one odd line"] * 6 + ["higher an odder line"] * 4
    docs = spark.createDataFrame([(k, "\n".join(lines[k::50])) for k in range(50)], "doc_id long, text string")
    # 0.05 % of 20,000 paragraphs are 10: all odd ones may pass, at twice the size too.
    assert licenses.calibrate(docs, fixed_model()) < 0.9
    assert licenses.calibrate(docs.union(docs), fixed_model()) < 0.9
    more = docs.union(spark.createDataFrame([(99, "\n".join(["high one odd line"] * 2))], docs.schema))
    assert 0.9 < licenses.calibrate(more, fixed_model()) < 0.99


def test_windows_are_scored_as_alone():
    model = fixed_model()
    model.words, model.pairs = {b"a": 0, b"b": 1, b"c": 2}, np.array([1, 5])
    draw = np.random.default_rng(1)
    model.weights, model.bias = draw.normal(size=(len(model.families), 5)), draw.normal(size=len(model.families))
    words = [b"abcx"[k : k + 1] for k in draw.integers(0, 4, 40)]
    start, end = np.array([0, 3, 5, 38, 7]), np.array([40, 4, 20, 40, 10])
    alone = model.line_probabilities([words[s:e] for s, e in zip(start, end, strict=True)])
    assert np.allclose(model.window_probabilities(model.number(words), start, end), alone)


def test_inline_short_and_reworded_notices(spark):
    prose = "the old house stood by the river and nobody came to see it in those days " * 8
    mit = "This project is licensed under the MIT License."
    reworded = "This program is free software: you may share it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."
    texts = [
        (1, prose + mit + " " + prose), (2, "MIT License"), (3, "words\nGPLv3\nwords"), (4, prose + reworded + " " + prose),
        (5, prose + "the rights of the copyright notice and of the software in the old house " + prose), (6, "License"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = licenses.learn(documents(spark))
    rows = {r["doc_id"]: r["families"] for r in licenses.summary(licenses.scan(docs, model)).collect()}
    assert rows == {1: "mit", 2: "mit", 3: "gpl", 4: "gpl", 5: "", 6: ""}


# Mixing


def test_every_source_gets_its_target(spark):
    sources = [(f"s{k}", 100) for k in range(9)] + [("tiny", 3), ("one", 1), ("big", 5000), (None, 60)]
    rows, number = [], 0
    for name, words in sources:
        for part in (words // 3, words - words // 3):
            number += 1
            rows.append((number, " ".join(f"w{number}x{i}" for i in range(part)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mixing.taken_words(docs, Scratch(spark, "mix")).collect()
    by_source = {}
    names = {n: s for n, _, s in rows}
    for r in found:
        taken, target = by_source.get(names[r["id"]], (0, 0.0))
        by_source[names[r["id"]]] = (taken + r["taken"], r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(by_source) == len(sources)
    assert all(abs(taken - target) <= 0.5 for taken, target in by_source.values())
    mixed = mixing.mixed_documents(docs.withColumn("n_chars", F.length("text")), Scratch(spark, "mix")).collect()
    counts = {}
    for r in mixed:
        counts[r["source"]] = counts.get(r["source"], 0) + len(r["text"].split())
    assert counts == {s: t for s, (t, _) in by_source.items() if t}


def test_permutation_goes_back():
    for size in (1, 2, 3, 64, 1000):
        key = np.full(size, 12345, np.uint64)
        there = mixing.permuted(np.arange(size), np.full(size, size), key)
        assert sorted(there) == list(range(size))
        assert np.array_equal(mixing.permuted(there, np.full(size, size), key, back=True), np.arange(size))
