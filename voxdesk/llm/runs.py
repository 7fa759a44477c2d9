"""Periodic runs of words, caught online over dyadic blocks.

A square of period q is a stretch of 2q words whose halves are equal. Take the
power of two L with 2L <= q < 4L: the left half holds a whole block of L words
that starts at a multiple of L, and the block stands again q words later. So a
block that is complete becomes a catcher: it watches the words appended between
2L and 4L words after its start, and each word that completes an equal block is
a suffix comparison to advance. The comparison is stretched to both sides; a
stretch of q equal pairs is a square, and squares that touch merge into a run. A
word is watched by two catchers of each size, so a text of n words costs
n log n comparisons, made for all appended words at once.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxdesk.llm.common import as_bytes, word_pieces
from voxdesk.session import ship_package

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Words appended to the catchers at once, and candidates whose suffixes are compared at once.
APPEND_WORDS = 1 << 17
CANDIDATES = 1 << 18
#: Bytes of texts that one catcher takes one after the other.
GROUP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


_powers = np.ones(1, np.uint64)


def _power_table(size: int) -> np.ndarray:
    """Powers of the base of the window hashes, at least `size` of them."""
    global _powers
    while len(_powers) < size:
        with np.errstate(over="ignore"):
            _powers = np.concatenate((_powers, _powers * (_powers[-1] * _BASE)))
    return _powers


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for at least `size` values."""
    if size <= len(values):
        return values
    out = np.empty(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


class RunCatcher:
    """Finds the runs of a sequence of word numbers as the words are appended.

    append() takes the next words; found() gives (start, end, period) of all
    runs of min_exponent periods and min_length words, the last ones as far as
    the words go. Window hashes only propose: every run is confirmed on the words
    themselves.
    """

    def __init__(self, min_exponent: int = 2, min_length: int = 2):
        self.min_exponent, self.min_length = min_exponent, min_length
        self.n = 0
        self.words = np.empty(1024, np.int64)
        self.prefix = np.zeros(1025, np.uint64)
        self.low = self.high = self.period = np.empty(0, np.int64)

    def append(self, ids: np.ndarray, longest: int | None = None) -> None:
        """Take the next words; no run is longer than `longest`, if that is given."""
        for start in range(0, len(ids), APPEND_WORDS):
            self._append(ids[start : start + APPEND_WORDS], longest)

    def _append(self, ids: np.ndarray, longest: int | None) -> None:
        old, n = self.n, self.n + len(ids)
        self.words, self.prefix = _grown(self.words, n), _grown(self.prefix, n + 1)
        self.power = _power_table(n + 1)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        self.words[old:n] = ids
        self.prefix[old + 1 : n + 1] = self.prefix[old] + np.cumsum(mixed * self.power[old:n], dtype=np.uint64)
        self.n = n
        still = np.flatnonzero(self.high == old)
        if len(still):  # comparisons that had reached the last word go on into the new ones
            self.high[still] += self._forward(self.high[still] - self.period[still], self.period[still])
            self._keep(*[np.empty(0, np.int64)] * 3)
        self._short_periods(old)
        size = 2
        while 2 * self.min_exponent * size <= min(n, longest or n):
            self._catch(old, size)
            size *= 2

    def _same(self, a: np.ndarray, length: np.ndarray | int, shift: np.ndarray) -> np.ndarray:
        """Whether the windows of `length` words at a and at a + shift have one hash."""
        first = (self.prefix[a + length] - self.prefix[a]) * self.power[shift]
        return first == self.prefix[a + shift + length] - self.prefix[a + shift]

    def _keep(self, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> None:
        """Merge matches with those known: one each of equal ones, runs and those that may still become some."""
        low, high, period = (
            np.concatenate(x) for x in ((self.low, low), (self.high, high), (self.period, period))
        )
        good = (high - low >= np.maximum(self.min_exponent * period, self.min_length)) | (high == self.n)
        rows = np.unique(np.stack((low[good], high[good], period[good]), axis=1), axis=0)
        self.low, self.high, self.period = rows.T.copy()

    def _short_periods(self, old: int) -> None:
        """Periods under four words, each word compared with those just before it."""
        for q in (1, 2, 3):
            begin = max(old, q)
            if begin >= self.n:
                continue
            first, last = _stretches(self.words[begin : self.n] == self.words[begin - q : self.n - q])
            # One that begins with the first new word may go on from an open match.
            good = (last - first + q >= max(self.min_exponent * q, self.min_length)) | (last == self.n - begin) | (first == 0)
            if good.any():
                first, last = first[good] + begin, last[good] + begin
                shift = np.full(len(first), q)
                self._keep(first - q - self._backward(first - q, shift), last, shift)

    def _catch(self, old: int, size: int) -> None:
        """Blocks of `size` words against the catchers that watch the words appended since `old`."""
        begin = max(old + 1 - size, 2 * size)
        for start in range(begin, self.n - size + 1, CANDIDATES):
            at = np.arange(start, min(start + CANDIDATES, self.n - size + 1))
            newest = (at // size - 2) * size
            for block in (newest, newest - size):
                here = at if block[0] >= 0 else at[block >= 0]
                own = block[block >= 0]
                if not len(own):
                    continue
                hit = np.flatnonzero(self._same(own, size, here - own))
                if len(hit):
                    self._stretch(own[hit], here[hit] - own[hit], size)

    def _stretch(self, block: np.ndarray, period: np.ndarray, size: int) -> None:
        """Advance the suffix comparisons of equal blocks and keep what may be squares."""
        known = self._inside(block, block + period + size, period, size)
        block, period = block[~known], period[~known]
        if len(block):
            low = block - self._backward(block, period)
            self._keep(low, block + period + self._forward(block, period), period)

    def _inside(self, low: np.ndarray, high: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
        """Whether a known run covers a match and its period divides the match's.

        Runs of over three blocks with a period of half a block at most do not
        hold one another, so of those that begin before the match the last one
        reaches farthest.
        """
        long = np.flatnonzero((self.high - self.low >= 3 * size) & (2 * self.period <= size))
        if not len(long):
            return np.zeros(len(low), bool)
        order = long[np.lexsort((self.period[long], self.low[long]))]
        # The same run with its period doubled is no other run.
        order = order[np.concatenate(([True], np.diff(self.low[order]) > 0))]
        at = np.searchsorted(self.low[order], low, "right") - 1
        run = order[np.maximum(at, 0)]
        return (at >= 0) & (self.high[run] >= high) & (period % self.period[run] == 0)

    def _forward(self, a: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words from a on equal those `shift` later."""
        return self._longest(a, shift, self.n - a - shift, 0)

    def _backward(self, a: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words before a equal those `shift` later."""
        return self._longest(a, shift, a, 1)

    def _longest(self, a: np.ndarray, shift: np.ndarray, room: np.ndarray, back: int) -> np.ndarray:
        """The longest equal stretch from a on, or before it, found by doubling and halving."""
        length = np.zeros(len(a), np.int64)
        step, live = 1, np.arange(len(a))
        steps = np.ones(len(a), np.int64)
        while len(live):  # double while equal
            fits = length[live] + step <= room[live]
            live = live[fits]
            at = a[live] - back * (length[live] + step) + (1 - back) * length[live]
            live = live[self._same(at, step, shift[live])]
            length[live] += step
            steps[live] = step * 2
            step *= 2
        step = int(steps.max(initial=1))
        while step:
            live = np.flatnonzero((steps >= step) & (length + step <= room))
            at = a[live] - back * (length[live] + step) + (1 - back) * length[live]
            live = live[self._same(at, step, shift[live])]
            length[live] += step
            step //= 2
        return length

    def found(self) -> np.ndarray:
        """(start, end, period) of each run by start and period, confirmed on the words."""
        words, least = self.words[: self.n], {}
        for low, high, q in zip(self.low.tolist(), self.high.tolist(), self.period.tolist(), strict=True):
            for x, y in zip(*_stretches(words[low + q : high] == words[low : high - q]), strict=True):
                span = low + int(x), low + int(y) + q
                if span[1] - span[0] >= max(self.min_exponent * q, self.min_length):
                    least[span] = min(q, least.get(span, q))
        out = sorted((low, q, high) for (low, high), q in least.items())
        return np.array([(low, high, q) for low, q, high in out], np.int64).reshape(-1, 3)


def text_runs(
    texts: list[bytes | None], min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH
) -> list[tuple[int, np.ndarray]]:
    """(number of words, runs) of each text; a run is (start, end, period).

    The texts follow one another in one catcher. After each comes a word that
    nothing equals, so no run leaves its text.
    """
    catcher, known, counts = RunCatcher(min_exponent, min_length), {}, []
    waiting, longest = [], 0
    for k, text in enumerate(texts):
        count = 0
        for words in word_pieces(text):
            waiting.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            count += len(words)
            longest = max(longest, count)
            if count >= APPEND_WORDS:
                catcher.append(np.concatenate(waiting), longest)
                waiting = []
        waiting.append(np.array([-1 - k]))
        counts.append(count)
    if waiting:
        catcher.append(np.concatenate(waiting), longest)
    begin = np.cumsum([0] + [c + 1 for c in counts])
    runs = catcher.found()
    cut = np.searchsorted(runs[:, 0], begin)
    return [(c, runs[cut[k] : cut[k + 1]] - [begin[k], begin[k], 0]) for k, c in enumerate(counts)]


def collapse(text: bytes | None, n: int, runs: np.ndarray) -> Iterator[bytes]:
    """The words of a text, in joined pieces, without what a run repeats after its first period."""
    gone = np.zeros(n + 1, np.int32)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 1], -1)
    kept, at = np.cumsum(gone)[:n] <= 0, 0
    for words in word_pieces(text):
        own = kept[at : at + len(words)]
        at += len(words)
        if own.any():
            yield b" ".join(words) if own.all() else b" ".join(w for w, k in zip(words, own.tolist(), strict=True) if k)


def periodic_runs(
    docs: DataFrame,
    text_col: str | Column = "text",
    min_exponent: int = MIN_EXPONENT,
    min_length: int = MIN_LENGTH,
    with_text: bool = False,
) -> DataFrame:
    """docs without its text, and n_words, runs and collapsed_sha256 for each row.

    runs: (start, length, period) of every maximal stretch of words with smallest
    period `period` that has at least min_exponent (2 or more) periods and
    min_length words, by start, then period. Words are runs of characters other
    than ASCII white space and are numbered from 0. collapsed_sha256 is the digest
    of the words, joined by a space, without those that a run holds after its
    first period; with_text gives them as `collapsed`, too. A null, empty or blank
    text has no words and no runs. Every row is judged alone, so null ids, ties and
    repeated rows are nothing special; an empty table gives an empty result. New
    columns replace columns of docs that have their names.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    ship_package(docs.sparkSession)
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    new = ["n_words", "runs", "collapsed_sha256", *(["collapsed"] if with_text else [])]
    rest = [c for c in docs.columns if c.lower() not in new and not (isinstance(text_col, str) and c.lower() == text_col.lower())]
    taken = docs.select(*[F.col(f"`{c}`") for c in rest], text.cast("string").alias("_text_to_judge"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            ends = np.cumsum(pc.fill_null(pc.binary_length(body), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                before = ends[first - 1] if first else 0
                rows = max(1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")) - first)
                texts = as_bytes(body.slice(first, rows))
                yield judged(batch.slice(first, rows), texts, text_runs(texts, min_exponent, min_length))
                first += rows

    def judged(batch: pa.RecordBatch, texts: list[bytes | None], found: list[tuple]) -> pa.RecordBatch:
        listed, digests, kept = [], [], []
        for text, (n, runs) in zip(texts, found, strict=True):
            digest, parts = hashlib.sha256(), []
            for k, part in enumerate(collapse(text, n, runs)):
                digest.update(b" " + part if k else part)
                if with_text:
                    parts.append(part)
            listed.append([{"start": s, "length": e - s, "period": q} for s, e, q in runs.tolist()])
            digests.append(digest.hexdigest())
            kept.append(b" ".join(parts).decode())
        own = [pa.array([n for n, _ in found], pa.int64()), pa.array(listed, pa.list_(_RUN)), pa.array(digests, pa.string()),
               pa.array(kept, pa.string())][: len(new)]
        return pa.RecordBatch.from_arrays(batch.columns[:-1] + own, names=rest + new)

    added = StructType.fromDDL(f"n_words bigint, runs array<{RUN}>, collapsed_sha256 string, collapsed string")
    schema = StructType(taken.schema.fields[:-1] + added.fields[: len(new)])
    return taken.mapInArrow(judge, schema)
