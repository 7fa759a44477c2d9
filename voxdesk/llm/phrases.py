"""Collocations: phrases whose words stand together more often than apart.

Words are numbered by falling frequency, so the pairs of frequent words crowd
into a few tiles of the table (first number, second number). A task counts a
crowded tile by direct address, one dense array indexed by the cell, and all
other pairs as sorted coordinate lists. Pairs that are frequent are numbered by
frequency in their turn, and such a number followed by a word is the next pair:
phrases of three words are pairs of a two-word phrase and a word, and so on. A
phrase can only be frequent where its first words and its last words are.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, as_bytes, give_back, sliced, small_table

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
UNKNOWN = "und"

#: Side of a tile; pairs in a tile from which it is counted by address; tiles a task holds.
TILE = 512
DENSE_PAIRS = TILE * TILE // 16
DENSE_TILES = 8
#: Pairs gathered before they are counted, and coordinates a task holds before it hands them on.
PAIRS = 1 << 18
COORDINATES = 1 << 19
#: Distinct words a task holds before it hands their counts on.
LOCAL_WORDS = 100_000
#: Entries of a numbering that are sent to the tasks at once. A larger one is sent slice by slice.
SLICE = 500_000
#: Words of an encoded row, which ends where a piece of text ends. Readers take thousands of rows at once.
ROW_WORDS = 1 << 11

_BREAK = b"\n"
_UPPER = bytes(range(65, 91))
_LOWERED = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _UPPER.lower() + _BREAK * 9 + b" ")


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a line feed where a piece ends."""
    return [w for w in (text or b"").translate(_LOWERED).replace(_BREAK, b" \n ").split(b" ") if w]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count) of a task's words, and the number of them all under the empty word."""
    counts: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own[b""] = sum(own.values())  # how many words there are, under a name that no word has
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(list(own)).cast(pa.string()),
                 pa.array(list(own.values()), pa.int64())], names=["lang", "word", "count"],
            )
        counts.clear()

    for batch in (part for whole in batches for part in sliced(whole)):
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            own = counts.setdefault(lang, Counter())
            own.update(tokens(text))
            own.pop(_BREAK, None)
            if len(own) > LOCAL_WORDS or len(counts) > 1000:
                yield from rows()
    yield from rows()
    give_back()


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(rows with a gapless `number` in that order, how many). No task holds more than its range."""
    placed = scratch.store(rows.orderBy(*order).withColumn("number", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftright("number", 33))
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())  # one row a partition
    begin, offsets = 0, []
    for part, size in sizes:
        offsets.append((part, begin))
        begin += size
    table = small_table(scratch.spark, offsets, "part bigint, begin bigint")
    number = F.col("begin") + F.col("number").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(table), "part").withColumn("number", number).drop("part", "begin"), begin


def _encode(words: dict[tuple[str, bytes], int], last: bool) -> Callable:
    """Put word numbers in the place of words: -1 for others, -2 where a piece or a text ends."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            earlier = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            rows = []
            for lang, text, before in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), earlier, strict=True):
                found = tokens(text)
                ids = np.fromiter((-2 if w == _BREAK else words.get((lang, w), -1) for w in found), np.int32, len(found))
                if before is not None:
                    ids = np.where(ids == -1, np.array(before, np.int32), ids)
                rows.append(np.append(ids, np.int32(-2)) if last else ids)
            if last:
                rows = _blocks(np.concatenate(rows) if rows else np.empty(0, np.int32))
            kept = [] if last else [batch.column(0), batch.column(1)]
            lists = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, lists], names=["lang", "text", "words"][-1 - len(kept) :])
        give_back()

    return encode


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    """The numbers in rows that end with a break, without breaks that follow a break."""
    known = ids >= 0
    ids = np.where(known, ids, -1)[known | np.concatenate(([False], known[:-1]))]
    ends = np.flatnonzero(ids < 0) + 1
    place = ends // ROW_WORDS
    cuts = ends[np.flatnonzero(place[1:] != place[:-1])]
    return [part for part in np.split(ids, cuts) if len(part)]


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The lists of a column one after the other. All end with a break, so no phrase goes from one to the next."""
    return batch.column(name).flatten().to_numpy()


def pair_keys(words: np.ndarray, units: np.ndarray, length: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the phrases of `length` words whose first and last length - 1 words are frequent."""
    if len(units) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(units) - length + 1
    at = np.flatnonzero((units[:n] >= 0) & (units[1 : n + 1] >= 0))
    return at, units[at].astype(np.int64) * vocabulary + words[at + length - 1]


class TiledCounts:
    """Counts of pairs (first, second): dense arrays for crowded tiles, sorted coordinates for the others."""

    def __init__(self, vocabulary: int):
        self.vocabulary = vocabulary
        self.across = -(-vocabulary // TILE)
        self.dense: dict[int, np.ndarray] = {}
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        first, second = np.divmod(keys, self.vocabulary)
        tile = (first // TILE) * self.across + second // TILE
        named, number, sizes = np.unique(tile, return_inverse=True, return_counts=True)
        crowded = (sizes >= DENSE_PAIRS) | np.isin(named, list(self.dense))
        order = np.argsort(-sizes, kind="stable")
        order = order[crowded[order]]
        for k in order.tolist():
            name = int(named[k])
            if name not in self.dense:
                if len(self.dense) >= DENSE_TILES:
                    crowded[k] = False
                    continue
                self.dense[name] = np.zeros(TILE * TILE, np.int64)
            own = number == k
            self.dense[name] += np.bincount((first[own] % TILE) * TILE + second[own] % TILE, minlength=TILE * TILE)
        rest, counts = np.unique(keys[~crowded[number]], return_counts=True)
        self.keys, self.counts = _merged(self.keys, self.counts, rest, counts)

    def flush(self, all_of_it: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has been counted, if there is much of it or at the end."""
        if all_of_it:
            for name, cells in self.dense.items():
                at = np.flatnonzero(cells)
                first, second = (name // self.across) * TILE + at // TILE, (name % self.across) * TILE + at % TILE
                yield first * self.vocabulary + second, cells[at]
            self.dense = {}
        if all_of_it or len(self.keys) > COORDINATES:
            yield self.keys, self.counts
            self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted coordinate lists as one."""
    if not len(keys):
        return more, n
    every, both = np.concatenate((keys, more)), np.concatenate((counts, n))
    order = np.argsort(every, kind="stable")
    every, both = every[order], both[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.add.reduceat(both, first)


def _count_pairs(length: int, vocabulary: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, waiting, held = TiledCounts(vocabulary), [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held
            if waiting:
                tiles.add(np.concatenate(waiting))
            waiting, held = [], 0
            for keys, counts in tiles.flush(last):
                for k in range(0, len(keys), PAIRS):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[k : k + PAIRS]), pa.array(counts[k : k + PAIRS])], names=["key", "count"]
                    )

        for batch in batches:
            units = _flat(batch, "units" if "units" in batch.schema.names else "words")
            _, keys = pair_keys(_flat(batch, "words"), units, length, vocabulary)
            for k in range(0, len(keys), PAIRS):
                waiting.append(keys[k : k + PAIRS])
                held += len(waiting[-1])
                if held >= PAIRS:
                    yield from out(False)
        yield from out(True)
        del tiles
        give_back()

    return count


def _renumber(keys: np.ndarray, numbers: np.ndarray, length: int, vocabulary: int) -> Callable:
    """Put numbers of phrases of `length` words beside the words: column `next`, -1 for no phrase of the slices so far."""

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            words = _flat(batch, "words")
            units = _flat(batch, "units") if "units" in names else words
            now = _flat(batch, "next").copy() if "next" in names else np.full(len(words), -1, np.int32)
            at, own = pair_keys(words, units, length, vocabulary)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[place] == own
            now[at[hit]] = numbers[place[hit]]
            ends = np.cumsum(np.concatenate(([0], batch.column("words").value_lengths().to_numpy())))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(now))
            kept = [c for c in names if c != "next"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists], names=[*kept, "next"])
        give_back()

    return renumber


def _slices(table: DataFrame, total: int, size: int, *columns: str) -> Iterator[list]:
    """The rows of a numbered table, at most `size` of them at once."""
    for low in range(0, total, size):
        yield table.where(F.col("number").between(low, low + size - 1)).select(*columns, "number").toArrow()


def _encoded(docs: DataFrame, words: DataFrame, total: int, scratch: Scratch, size: int) -> DataFrame:
    rows = docs
    for k, own in enumerate(_slices(words, total, size, "lang", "phrase")):
        last = (k + 1) * size >= total
        names = zip(own.column(0).to_pylist(), as_bytes(own.column(1).combine_chunks()), strict=True)
        numbers = dict(zip(names, own.column(2).to_pylist(), strict=True))
        sent = scratch.spark.sparkContext.broadcast(numbers)
        schema = "words array<int>" if last else "lang string, text string, words array<int>"
        rows = scratch.store(rows.mapInArrow(lambda b, s=sent, e=last: _encode(s.value, e)(b), schema), f"encoded-{k}")
        sent.unpersist()
        if k:
            scratch.drop(f"encoded-{k - 1}")
    return rows


def _next_units(rows: DataFrame, found: DataFrame, total: int, length: int, vocabulary: int, scratch: Scratch, size: int) -> DataFrame:
    for k, own in enumerate(_slices(found, total, size, "key")):
        keys, numbers = (own.column(c).to_numpy() for c in range(2))
        order = np.argsort(keys)
        sent = scratch.spark.sparkContext.broadcast((keys[order], numbers[order].astype(np.int32)))
        schema = ", ".join(f"{c} array<int>" for c in [c for c in rows.columns if c != "next"] + ["next"])

        def renumber(batches, s=sent):
            return _renumber(*s.value, length, vocabulary)(batches)

        rows = scratch.store(rows.mapInArrow(renumber, schema), f"units-{length}-{k}")
        sent.unpersist()
        if k:
            scratch.drop(f"units-{length}-{k - 1}")
    return rows.select("words", F.col("next").alias("units"))


def frequent_phrases(
    docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang",
    min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, slice_rows: int = SLICE,
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, n_words, count) of every phrase of up to max_words words that
    stands min_count times, and (lang, n), the number of words a language has.

    Phrases do not cross `.,;:!?`, line feeds, vertical tabs, form feeds and carriage returns. Numberings
    are sent to the tasks in slices of slice_rows, each a pass over the encoded words, so what is sent has a
    bound at every size. A numbering holds up to 2^31 entries.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counted = texts.mapInArrow(_word_counts, "lang string, word string, count bigint").groupBy(
        "lang", F.col("word").alias("phrase")
    ).agg(F.sum("count").alias("count"))
    counted = scratch.store(counted.where((F.col("count") >= min_count) | (F.col("phrase") == "")), "words")
    totals = scratch.store(counted.where("phrase = ''").select("lang", F.col("count").alias("n")), "totals")
    frequent = counted.where((F.col("count") >= min_count) & (F.col("phrase") != ""))
    ordered, total = numbered(frequent, [F.desc("count"), F.col("lang"), F.col("phrase")], scratch, "numbered-1")
    words = scratch.store(ordered.withColumn("n_words", F.lit(1)), "phrases-1")
    phrases = [words]
    if not total:
        return words.select("lang", "phrase", "n_words", "count"), totals
    vocabulary = total
    rows = _encoded(texts, words, total, scratch, slice_rows)
    names = [f"encoded-{-(-total // slice_rows) - 1}"]
    for length in range(2, max_words + 1):
        pairs = rows.mapInArrow(_count_pairs(length, vocabulary), "key bigint, count bigint")
        found = pairs.groupBy("key").agg(F.sum("count").alias("count")).where(F.col("count") >= min_count)
        ordered, total = numbered(found, [F.desc("count"), F.col("key")], scratch, f"numbered-{length}")
        if not total:
            break
        head = phrases[-1].select(F.col("number").alias("first"), "lang", F.col("phrase").alias("head"))
        tail = words.select(F.col("number").alias("second"), F.col("phrase").alias("tail"))
        named = (
            ordered.withColumn("first", F.floor(F.expr(f"key div {vocabulary}")))
            .withColumn("second", F.col("key") % vocabulary)
            .join(head, "first").join(tail, "second")
            .select("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "count", "number", "key", F.lit(length).alias("n_words"))
        )
        phrases.append(scratch.store(named, f"phrases-{length}"))
        if length < max_words:
            rows, read = _next_units(rows, phrases[-1], total, length, vocabulary, scratch, slice_rows), names
            names = [f"units-{length}-{-(-total // slice_rows) - 1}"]
            scratch.drop(f"numbered-{length}", *read)
    out = phrases[0].select("lang", "phrase", "n_words", "count")
    for own in phrases[1:]:
        out = out.unionByName(own.select("lang", "phrase", "n_words", "count"))
    return out, totals


def collocations(
    docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang",
    min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, slice_rows: int = SLICE,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of two words and more of each language.

    score is floor(1000 * a * n / (l * r)) at the cut into two parts where it is
    lowest (of equal scores, at the first), a, l and r being the counts of the
    phrase and of its parts, n the words of the language. A phrase that a longer
    frequent phrase holds whenever it stands is left out. Ranked by score and a,
    both falling, then by the phrase's bytes. Null texts are empty, a null language
    is `und`; rows are counted one by one, repeated or not; an empty table or one
    without frequent phrases gives an empty result, and other columns are not read.
    """
    counts, totals = frequent_phrases(docs, scratch, text_col, lang_col, min_count, max_words, slice_rows)
    candidates = counts.where("n_words > 1").withColumn("words", F.split("phrase", " "))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", "count", "k",
        F.concat_ws(" ", F.expr("slice(words, 1, k)")).alias("left"),
        F.concat_ws(" ", F.expr("slice(words, k + 1, n_words - k)")).alias("right"),
    )
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l"))
    other = counts.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r"))
    exact = "cast((1000bd * cast(count as decimal(18,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    best = (
        cut.join(part, ["lang", "left"]).join(other, ["lang", "right"]).join(totals, "lang")
        .groupBy("lang", "phrase", F.col("count").alias("a"), "n")
        .agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    )
    spans = candidates.where("n_words > 2").select(
        "lang", "count", "words", "n_words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size")
    ).select("lang", "count", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)).alias("at"))
    inside = spans.groupBy("lang", F.concat_ws(" ", F.expr("slice(words, at, size)")).alias("phrase")).agg(
        F.max("count").alias("held")
    )
    free = best.join(inside, ["lang", "phrase"], "left").where("held IS NULL OR held < a")
    place = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.col("phrase"))
    )
    return free.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
