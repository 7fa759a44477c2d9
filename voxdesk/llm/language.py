"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of character n-grams up to ORDER. The tables of all
languages share sorted arrays of n-gram hashes; a row holds what every language
makes of that n-gram. A text's language is the one whose cross-entropy per
character is lowest. The models are fitted on a bounded sample of the labelled
rows; every text is scored whole.
"""

import math
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch

ORDER = 4
FOLDS = 5
DISCOUNT = 0.75
#: Characters of training text a language should have at most, about.
TRAIN_CHARS = 2_000_000
#: n-grams that a language's sample can give at most: ORDER for each character.
START = 2
UNDECIDED = "und"
#: Share of training texts whose cross-entropy may lie above a language's limit.
REJECTED = 0.001
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, ends): lower-cased texts one after another, each behind ORDER - 1 start marks.

    Runs of characters that are no letters become one blank.
    """
    parts, ends, total = [], [], 0
    for text in texts:
        parts.append("\x02" * (ORDER - 1) + (text or "").lower())
        total += len(parts[-1])
        ends.append(total)
    data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    return data, np.array(ends, np.int64)


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        _LETTER[:] = [unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]
    return _LETTER


def prepared(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, document of each, has a letter): blanks instead of other characters, never two in a row."""
    data, ends = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letter = _letters()[data]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    data[~letter & (data != START)] = 32
    keep = ~((data == 32) & (np.concatenate(([0], data[:-1])) == 32) & (owner == np.concatenate(([-1], owner[:-1]))))
    return data[keep], owner[keep], has


def gram_hashes(data: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the `order` characters that end at each position (wrapping at the start)."""
    out = np.full(len(data), order, np.uint64)
    for back in range(order - 1, -1, -1):
        out = (out ^ np.roll(data, back).astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(31)
    return out


def count_grams(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (hash, context hash, hash without the first character, count)."""
    data, _, _ = prepared(texts)
    real = data != START
    out = {}
    for order in range(1, ORDER + 1):
        whole = gram_hashes(data, order)[real]
        context = np.roll(gram_hashes(data, order - 1), 1)[real] if order > 1 else np.zeros(real.sum(), np.uint64)
        shorter = gram_hashes(data, order - 1)[real] if order > 1 else np.zeros(real.sum(), np.uint64)
        keys, first, counts = np.unique(whole, return_index=True, return_counts=True)
        out[order] = keys, context[first], shorter[first], counts
    return out


@dataclass
class Models:
    """Kneser-Ney models of several languages over shared sorted arrays.

    grams[k] holds the hashes of order k; logs[k] a row of log probabilities by
    language. contexts[k] holds the contexts of order k, and backs[k] a row of
    log weights that a model gives the next shorter order there. limits are
    cross-entropies above which a text is none of the language's.
    """

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray
    limits: np.ndarray = field(default_factory=lambda: np.empty(0))

    def log_probs(self, data: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row of log probabilities by language for the character at each position."""
        return self._at(data, np.arange(len(data)), order)

    def _at(self, data: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(places), len(self.languages)))
        keys = gram_hashes(data, order)[places]
        table = self.grams[order]
        if len(table):
            row = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            known = table[row] == keys
            out = self.logs[order][row]
        else:
            known, out = np.zeros(len(places), bool), np.empty((len(places), len(self.languages)))
        unknown = np.flatnonzero(~known)
        if len(unknown):
            lower = self._at(data, places[unknown], order - 1)
            out[unknown] = lower + self._backs(data, places[unknown], order)
        return out

    def _backs(self, data: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
        table = self.contexts[order]
        keys = gram_hashes(data, order - 1)[places - 1] if order > 1 else np.zeros(len(places), np.uint64)
        row = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
        known = (table[row] == keys)[:, None] if len(table) else np.zeros((len(places), 1), bool)
        return np.where(known, self.backs[order][row], 0.0) if len(table) else np.zeros((len(places), len(self.languages)))

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row by text of cross-entropies by language in nats a character, has a letter)."""
        data, owner, has = prepared(texts)
        real = data != START
        logs = self.log_probs(data)[real]
        counts = np.maximum(np.bincount(owner[real], minlength=len(texts)), 1)
        sums = [np.bincount(owner[real], logs[:, k], minlength=len(texts)) for k in range(len(self.languages))]
        return -np.column_stack(sums) / counts[:, None], has


def fit(samples: dict[str, dict]) -> Models:
    """Models from the counts of count_grams() by language.

    The highest order uses counts, lower ones the number of different characters
    before an n-gram. An n-gram one language has and another lacks gets its
    backed-off probability there, so one look-up serves all languages.
    """
    languages = sorted(samples)
    n = len(languages)
    if not n:
        return Models([], [], [], [], [], np.empty(0))
    alphabet = len(np.unique(np.concatenate([samples[x][1][0] for x in languages]))) + 1
    floor = np.full(n, -math.log(alphabet))
    grams, logs = [np.empty(0, np.uint64)], [np.empty((0, n))]
    contexts, backs = [np.empty(0, np.uint64)], [np.empty((0, n))]
    for order in range(1, ORDER + 1):
        own = []
        for x in languages:
            keys, context, shorter, counts = samples[x][order]
            if order < ORDER:  # continuation counts: different n-grams one longer that end in this one
                longer = samples[x][order + 1]
                endings, many = np.unique(longer[2], return_counts=True)
                row = np.minimum(np.searchsorted(endings, keys), max(len(endings) - 1, 0))
                counts = np.where(endings[row] == keys, many[row], 1) if len(endings) else counts
            own.append((keys, context, shorter, counts.astype(float)))
        table, first = np.unique(np.concatenate([o[0] for o in own]), return_index=True)
        context_of = np.concatenate([o[1] for o in own])[first]
        shorter_of = np.concatenate([o[2] for o in own])[first]
        known = np.unique(context_of)
        log, back = np.empty((len(table), n)), np.zeros((len(known), n))
        for k, (keys, context, _, counts) in enumerate(own):
            row = np.searchsorted(known, context)
            total = np.bincount(row, counts, minlength=len(known))
            kinds = np.bincount(row, minlength=len(known))
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            back[:, k] = np.log(weight)
            if order == 1:
                lower = np.full(len(table), math.exp(floor[k]))
            else:
                lower = np.exp(logs[order - 1][np.searchsorted(grams[order - 1], shorter_of), k])
            at = np.searchsorted(known, context_of)
            prob = weight[at] * lower
            mine = np.searchsorted(table, keys)
            prob[mine] += np.maximum(counts - DISCOUNT, 0) / total[row]
            log[:, k] = np.log(prob)
        grams.append(table)
        logs.append(log)
        contexts.append(known)
        backs.append(back)
    return Models(languages, grams, logs, contexts, backs, floor)


def learn(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str) -> Models:
    """Models of every language among the training rows, with calibrated limits.

    Training rows have a text, a language and an id whose CRC-32 leaves a
    remainder by FOLDS. Whole texts are drawn by a hash of id and text until a
    language has about TRAIN_CHARS characters; a fifth of the drawn rows is kept
    out of the counts and sets the limits. n-grams are counted by language in the
    tasks; the driver merges tables no larger than the sample.
    """
    training = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    ).where(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0)
    sizes = training.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    # One row for each language.
    drawn = training.join(F.broadcast(sizes), "lang").where(draw * F.col("chars") < F.lit(float(TRAIN_CHARS)))
    side = F.pmod(F.xxhash64("text", "id"), F.lit(FOLDS))
    drawn = scratch.store(drawn.select("lang", "text", (side == 0).alias("judge")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, list[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            for order, (keys, context, shorter, counts) in count_grams(texts).items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array([order] * len(keys), pa.int32()),
                     *(pa.array(a.view(np.int64)) for a in (keys, context, shorter)), pa.array(counts)],
                    names=["lang", "gram_order", "gram", "context", "shorter", "n"],
                )

    counted = (
        drawn.where("NOT judge").select("lang", "text")
        .mapInArrow(count, "lang string, gram_order int, gram bigint, context bigint, shorter bigint, n bigint")
        .groupBy("lang", "gram_order", "gram")
        .agg(F.first("context").alias("context"), F.first("shorter").alias("shorter"), F.sum("n").alias("n"))
        .toArrow()
    )
    samples: dict[str, dict] = {}
    langs = counted.column("lang").to_pylist()
    codes = np.array(langs, object)
    order_of = counted.column("gram_order").to_numpy()
    columns = [counted.column(c).to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")]
    counts = counted.column("n").to_numpy()
    for lang in sorted(set(langs)):
        samples[lang] = {}
        for order in range(1, ORDER + 1):
            own = np.flatnonzero((codes == lang) & (order_of == order))
            own = own[np.argsort(columns[0][own])]
            samples[lang][order] = (*(c[own] for c in columns), counts[own])
    models = fit(samples)
    if models.languages:
        models.limits = _limits(drawn.where("judge"), models)
    return models


def _limits(judged: DataFrame, models: Models) -> np.ndarray:
    """For each language, the cross-entropy that few of its judged texts exceed."""
    sent = judged.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, _ = sent.value.cross_entropies(batch.column(1).to_pylist())
            place = {x: k for k, x in enumerate(sent.value.languages)}
            rows = [(lang, entropy[i, place[lang]]) for i, lang in enumerate(batch.column(0).to_pylist()) if lang in place]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                names=["lang", "entropy"],
            )

    found = judged.select("lang", "text").mapInArrow(score, "lang string, entropy double").groupBy("lang").agg(
        F.percentile_approx("entropy", 1 - REJECTED, 10_000).alias("limit")
    ).collect()
    limits = {r["lang"]: r["limit"] for r in found}
    return np.array([limits.get(x, np.inf) for x in models.languages])


def _predictor(sent):
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def predict(texts: pa.Array) -> pa.Array:
        models, out = sent.value, []
        listed = texts.to_pylist()
        # A few texts at a time, so that long ones do not add up.
        start = 0
        while start < len(listed):
            stop, size = start, 0
            while stop < len(listed) and (stop == start or size + len(listed[stop] or "") < 1_000_000):
                size += len(listed[stop] or "")
                stop += 1
            some = listed[start:stop]
            start = stop
            if not models.languages:
                out += [{"lang": UNDECIDED, "score": 0.0, "entropy": None, "rejected": True}] * len(some)
                continue
            entropy, has = models.cross_entropies(some)
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(some)), best]
            share = 1 / np.exp(low[:, None] - entropy).sum(axis=1)
            for i in range(len(some)):
                if has[i]:
                    out.append({"lang": models.languages[best[i]], "score": float(min(share[i], 1.0)),
                                "entropy": float(low[i]), "rejected": bool(low[i] > models.limits[best[i]])})
                else:
                    out.append({"lang": UNDECIDED, "score": 0.0, "entropy": None, "rejected": True})
        return pa.array(out, kind)

    return F.arrow_udf(predict, "struct<lang: string, score: double, entropy: double, rejected: boolean>")


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cross_entropy, rejected) of each row of docs.

    A null text or one without a letter is `und` with score 0. score is the
    language's share of exp(-cross-entropy) over all languages. rejected tells
    that the text is less like its language than all but REJECTED of the texts
    that set the limit. Ties go to the first language by name. Without any
    training row everything is `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)
    found = docs.select(F.col(id_col), _predictor(sent)(F.col(text_col)).alias("p"))
    return found.select(
        id_col, F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"),
        F.col("p.entropy").alias("cross_entropy"), F.col("p.rejected").alias("rejected"),
    )


def held_out(key: int | None) -> bool:
    """Whether a document's id puts it into the test fold; null ids are not tested."""
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == 0
