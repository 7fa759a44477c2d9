"""Quality rules, and an isolation forest over their statistics."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import UPPER, Scratch, each_text, give_back, word_ids

_BLANKS = b" \t\n\x0b\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = UPPER.encode()
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_punctuation", "n_lines",
)
STATS_TYPE = "struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">"

#: The statistics the forest reads per word, those it reads per line, and how many words
#: and lines of the corpus mean are mixed into each rate.
RATED = ("word_chars", "n_symbols", "n_upper", "n_punctuation", "n_repeat_words")
LINED = ("n_dup_lines",)
PRIOR_WORDS = 100
PRIOR_LINES = 10
#: How often the forest draws each column of features(), against the others. Repeats are rarer
#: among the bad labelled rows than among the clean ones; drawn as often, they hide the rest.
SHARES = np.array([1, 1, 1, 1, 0.3, 0.3, 0.5])

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 128
TREE_ROWS = 256
#: Share of bad labelled rows in the sample that the forest is grown on.
BAD = 0.03
#: Share of clean labelled rows that the threshold may reject.
MAX_CLEAN_LOSS = 0.004
BINS = 10_000
SEED = 6


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window of words that the text has twice or more."""
    ids, distinct = word_ids(words)
    if len(ids) < window:
        return 0
    code = ids[: len(ids) - window + 1]
    for k in range(1, window):
        code = code * distinct + ids[k : len(ids) - window + 1 + k]
        if k + 1 < window and distinct > 1_000_000:  # the next product would not fit 63 bits
            code = np.unique(code, return_inverse=True)[1]
    _, which, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(window):
        hit[k : len(ids) - window + 1 + k] |= twice
    return int(hit.sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The values of FIELDS for one text; a null text has no words."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, _BLANKS)
    continued = int(np.count_nonzero(np.frombuffer(solid, np.uint8) & 0xC0 == 0x80))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(solid) - continued,
        len(solid) - len(solid.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(solid) - len(solid.translate(None, _UPPER)),
        len(solid) - len(solid.translate(None, _PUNCTUATION)),
        len(lines),
    )


def _stats_of(texts: pa.Array) -> pa.Array:
    rows = np.array([text_stats(t) for t in each_text(texts)], np.int64).reshape(-1, len(FIELDS))
    give_back()
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(FIELDS))], FIELDS)


def stats(text: Column) -> Column:
    """A struct of FIELDS for each text."""
    return F.arrow_udf(_stats_of, STATS_TYPE)(text)


def base_failed(stats: Column) -> Column:
    few = stats["n_words"] < MIN_WORDS
    return few | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def features(rows: pd.DataFrame, means: np.ndarray) -> np.ndarray:
    """Rates per word of RATED and per line of LINED, and the log of the words; one row a document.

    Each rate is drawn to the corpus mean by PRIOR_WORDS words or PRIOR_LINES
    lines of it, so that a short clean document does not stand out by chance.
    """
    words = rows["n_words"].to_numpy(float)[:, None] + PRIOR_WORDS
    lines = rows["n_lines"].to_numpy(float)[:, None] + PRIOR_LINES
    per_word, per_line = means[: len(RATED)], means[len(RATED) :]
    return np.hstack([
        (rows[list(RATED)].to_numpy(float) + PRIOR_WORDS * per_word) / words,
        (rows[list(LINED)].to_numpy(float) + PRIOR_LINES * per_line) / lines,
        np.log(words),
    ])


def average_path(rows: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of so many rows."""
    if rows < 3:
        return float(max(rows - 1, 0))
    return 2 * (np.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows


@dataclass
class Forest:
    """Isolation trees; node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    norm: float
    means: np.ndarray | None = None

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / norm): near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                column = feature[node]
                right = rows[at, np.maximum(column, 0)] >= cut[node]
                node = np.where(column >= 0, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / max(len(self.path), 1) / max(self.norm, 1e-9))


def grow_forest(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED,
                shares: np.ndarray | None = None) -> Forest:
    """Random splits over random subsets of the rows; no rows give a forest of score 1 paths.

    A column is drawn in proportion to its share, if there are shares.
    """
    draw = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    cut = np.zeros((trees, nodes))
    path = np.zeros((trees, nodes))
    for tree in range(trees):
        stack = [(0, 0, rows[draw.choice(len(rows), size, replace=False)])] if size else []
        while stack:
            node, level, own = stack.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(open_):
                path[tree, node] = level + average_path(len(own))
                continue
            odds = None if shares is None else shares[open_] / shares[open_].sum()
            column = int(draw.choice(open_, p=odds))
            value = draw.uniform(low[column], high[column])
            right = own[:, column] >= value
            if right.all() or not right.any():
                path[tree, node] = level + average_path(len(own))
                continue
            feature[tree, node], cut[tree, node] = column, value
            stack.append((2 * node + 1, level + 1, own[~right]))
            stack.append((2 * node + 2, level + 1, own[right]))
    return Forest(feature, cut, path, depth, average_path(size))


def _drawn(rows: DataFrame, wanted: float) -> pd.DataFrame:
    """About so many rows' statistics, drawn by a hash of id and statistics out of all rows."""
    share = min(1.0, wanted / max(rows.count(), 1))
    drawn = F.pmod(F.xxhash64("id", "stats"), F.lit(1 << 30)) < int(share * (1 << 30))
    return rows.where(drawn).select("id", "stats.*").toPandas().sort_values(["id", *FIELDS])


def fit_forest(rated: DataFrame, labels: DataFrame, label_col: str = "quality") -> Forest:
    """Grow the forest on labelled rows that pass the base rules.

    rated has `id` and `stats`; labels has `id` and the label (1: clean). The
    sample is bounded: about TREES * TREE_ROWS clean rows, and bad ones so many
    that they make up a share of BAD. A few bad rows in each tree widen its
    ranges, so that splits fall between the two kinds. Without clean labelled
    rows the sample is drawn out of all rows that pass.
    """
    passed = rated.where(~base_failed(F.col("stats")))
    labelled = lambda k: labels.where(F.col(label_col) == k).select("id").distinct()
    clean = passed.join(labelled(1), "id", "left_semi")
    sample = _drawn(clean, TREES * TREE_ROWS)
    if not len(sample):
        clean, sample = passed, _drawn(passed, TREES * TREE_ROWS)
    bad = _drawn(passed.join(labelled(0), "id", "left_semi"), BAD * len(sample))
    totals = clean.agg(*(F.sum(f"stats.{f}").cast("double") for f in ("n_words", "n_lines", *RATED, *LINED))).first()
    words, lines, *sums = (t or 0.0 for t in totals)
    means = np.array(sums) / np.repeat([max(words, 1.0), max(lines, 1.0)], [len(RATED), len(LINED)])
    forest = grow_forest(features(pd.concat([sample, bad]), means), shares=SHARES)
    forest.means = means
    return forest


def score_udf(forest):
    """Anomaly scores of a struct of statistics; forest is a broadcast Forest."""

    @F.pandas_udf("double")
    def of(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.value.scores(features(rows, forest.value.means)))

    return of


def calibrate(scored: DataFrame, labels: DataFrame, label_col: str = "quality", loss: float = MAX_CLEAN_LOSS) -> float:
    """The score above which a document is rejected.

    Over all labelled rows that pass the base rules: the cut that best tells the
    labels apart among those that reject a share of the clean rows no larger
    than `loss`. Scores are counted in bins, so the driver gets 2 * BINS rows at
    most. Without labels of either kind nothing is rejected.
    """
    counts = (
        scored.where(~base_failed(F.col("stats")))
        .join(labels.where(F.col(label_col).isin(0, 1)).select("id", label_col), "id")
        .groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), F.col(label_col).alias("label"))
        .count()
        .toPandas()
    )
    clean, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for label, into in ((1, clean), (0, bad)):
        own = counts[counts["label"] == label]
        np.add.at(into, own["bin"].to_numpy(int), own["count"].to_numpy(float))
    if not clean.sum() or not bad.sum():
        return 2.0
    # above[k]: share of rows whose bin is k or more
    lost = clean[::-1].cumsum()[::-1] / clean.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= loss, caught - lost, -1)
    return float(np.flatnonzero(gain == gain.max())[-1] / BINS)


def rate(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id",
         text_col: str = "text", label_col: str = "quality"):
    """(rated, forest, threshold): statistics of all rows, and the fitted verdict.

    Labels with a null or an id that no document has are left out; an id with
    several labels counts with each. An empty table gives an empty result.
    """
    rated = scratch.store(
        docs.select(F.col(id_col).alias("id"), stats(F.col(text_col)).alias("stats")), "stats"
    )
    known = labels.select(F.col(id_col).alias("id"), label_col).where(
        F.col("id").isNotNull() & F.col(label_col).isNotNull()
    )
    forest = docs.sparkSession.sparkContext.broadcast(fit_forest(rated, known, label_col))
    scored = rated.withColumn("score", score_udf(forest)(F.col("stats")))
    return scored, forest, calibrate(scored, known, label_col)


def verdict(scored: DataFrame, threshold: float) -> DataFrame:
    """id, the statistics, score, base_failed, kept."""
    failed = base_failed(F.col("stats"))
    return scored.select(
        "id", "stats.*", "score", failed.alias("base_failed"),
        (~failed & (F.col("score") < threshold)).alias("kept"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id",
               text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, all columns unchanged, that the rules and the forest keep."""
    _, forest, threshold = rate(docs, labels, scratch, id_col, text_col, label_col)
    own = stats(F.col(text_col))
    # The verdict depends on the text alone, so it needs no join by id.
    kept = docs.select(F.struct(*docs.columns).alias("row"), own.alias("stats"))
    kept = kept.where(~base_failed(F.col("stats")))
    return kept.where(score_udf(forest)(F.col("stats")) < threshold).select("row.*")
