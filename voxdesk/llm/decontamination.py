"""Benchmark passages found through a distributed positional inverted index.

A segment of the index is one row: the documents of a stretch of the corpus,
and for every term the positions at which it stands in them. Documents are whole
within a segment, so lists are intersected where they are stored and no posting
is shuffled. Test windows are sent to the segments in chunks of bounded size.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, as_bytes, fresh, give_back, word_ids

WINDOW = 10
#: Text bytes after which a segment is closed; a longer document is a segment of its own.
SEGMENT_BYTES = 2 << 20
SLICE_ROWS = 64
#: Test words sent to the executors at once.
CHUNK_WORDS = 1 << 20

SEGMENT_TYPE = (
    "segment string, docs array<bigint>, ends array<bigint>, terms array<binary>, counts array<bigint>, "
    "postings binary"
)
MATCH_TYPE = (
    "segment string, place int, id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, "
    "items array<string>"
)

#: Upper-case letters become lower-case ones; bytes outside words become blanks.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class Segment:
    """The index of some documents; positions count through all of them."""

    name: str
    docs: list
    ends: np.ndarray
    counts: dict[bytes, int]
    starts: dict[bytes, int]
    postings: np.ndarray

    def positions(self, term: bytes) -> np.ndarray:
        """Ascending positions of a term."""
        start = self.starts.get(term)
        if start is None:
            return self.postings[:0]
        return self.postings[start : start + self.counts[term]]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The document at each position, as an index into docs."""
        return np.searchsorted(self.ends, positions, side="right")


def pack(docs: list, texts: list[bytes | None]) -> dict:
    """A segment's row. Positions are stored term by term as differences, compressed."""
    words, ends = [], []
    for text in texts:
        words += words_of(text)
        ends.append(len(words))
    ids, distinct = word_ids(words)
    first = np.zeros(distinct, np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    terms = [words[p] for p in first]
    counts = np.bincount(ids, minlength=distinct)
    order = np.argsort(ids, kind="stable").astype(np.uint32)
    steps = np.diff(order, prepend=np.uint32(0)).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()  # equal bytes side by side compress better
    return {
        "docs": docs, "ends": ends, "terms": terms, "counts": counts,
        "postings": zstandard.ZstdCompressor(level=1).compress(planes),
    }


def unpack(row: dict, wanted: pa.Array | None = None) -> Segment:
    """A segment from its row, with the lists of the wanted terms or of all."""
    planes = zstandard.ZstdDecompressor().decompress(row["postings"])
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    order = np.cumsum(steps, dtype=np.uint32).astype(np.int64)
    terms, counts = row["terms"], row["counts"]
    starts = np.cumsum(counts) - counts
    if wanted is not None:
        has = np.flatnonzero(pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False))
        terms, counts, starts = terms.take(pa.array(has)), counts[has], starts[has]
    names = terms.to_pylist()
    return Segment(
        row["segment"], row["docs"], np.asarray(row["ends"], np.int64),
        dict(zip(names, counts.tolist(), strict=True)), dict(zip(names, starts.tolist(), strict=True)), order,
    )


def build_index(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The segments of all documents, written to the shared folder.

    A null or wordless text has no postings and still belongs to a segment.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, 0
        task = TaskContext.get().partitionId()
        # A few rows at a time, so that a batch's texts are not all held twice.
        pieces = (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS))
        for piece in pieces:
            for key, text in zip(piece.column(0).to_pylist(), as_bytes(piece.column(1)), strict=True):
                ids.append(key)
                texts.append(text)
                size += len(text or b"") + 1
                if size >= SEGMENT_BYTES:
                    yield _segment_batch(f"{task}-{made}", ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield _segment_batch(f"{task}-{made}", ids, texts)
        give_back()

    wanted = docs.select(F.col(id_col).cast("bigint"), F.col(text_col))
    return scratch.store(wanted.mapInArrow(rows, SEGMENT_TYPE), "index")


def _segment_batch(name: str, ids: list, texts: list) -> pa.RecordBatch:
    row = pack(ids, texts)
    kinds = {
        "docs": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()),
        "counts": pa.list_(pa.int64()), "postings": pa.binary(),
    }
    columns = [pa.array([name])] + [pa.array([row[k]], kind) for k, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(columns, names=["segment", *kinds])


def segments(batches: Iterator[pa.RecordBatch], wanted: pa.Array | None = None) -> Iterator[Segment]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in ("segment", "docs", "ends", "postings")}
            row["terms"] = batch.column("terms")[k].values.cast(pa.binary())
            row["counts"] = batch.column("counts")[k].values.to_numpy()
            yield unpack(row, wanted)
    give_back()


def item_windows(items: list[tuple], length: int = WINDOW) -> dict[tuple, list]:
    """Distinct windows of `length` consecutive words, with the items that have them.

    An item of fewer words, but not none, is one window.
    """
    out = defaultdict(list)
    for key, text in items:
        words = words_of(text)
        for start in range(max(1, len(words) - length + 1) if words else 0):
            window = tuple(words[start : start + length])
            if not out[window] or out[window][-1] != key:
                out[window].append(key)
    return dict(out)


def phrase_starts(segment: Segment, window: tuple, rarity: dict) -> np.ndarray:
    """Where the window's words stand in a row in one document.

    Lists are taken from the rarest word on, each moved back by the word's place
    in the window, until none or all words are left.
    """
    places = sorted(range(len(window)), key=lambda k: rarity.get(window[k], 0))
    starts = None
    for place in places:
        listed = segment.positions(window[place])
        if not len(listed):
            return listed
        if starts is None:
            starts = listed - place
            starts = starts[starts >= 0]
        else:
            at = np.minimum(np.searchsorted(listed, starts + place), len(listed) - 1)
            starts = starts[listed[at] == starts + place]
        if not len(starts):
            return starts
    return starts[segment.owner(starts) == segment.owner(starts + len(window) - 1)]


def proximity_starts(segment: Segment, window: tuple, rarity: dict, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest stretches that hold the window's words in order.

    A stretch has up to `slack` other words, and lies in one document. Candidates
    come from the list of the rarest word; from each, the words before it are
    looked up backwards and those behind it forwards, always the nearest one.
    """
    pivot = min(range(len(window)), key=lambda k: rarity.get(window[k], 0))
    start = segment.positions(window[pivot])
    end = start
    for place in range(pivot - 1, -1, -1):
        listed = segment.positions(window[place])
        at = np.searchsorted(listed, start) - 1
        keep = at >= 0
        start, end = listed[at[keep]], end[keep]
    for place in range(pivot + 1, len(window)):
        listed = segment.positions(window[place])
        at = np.searchsorted(listed, end, side="right")
        keep = at < len(listed)
        start, end = start[keep], listed[at[keep]]
    near = end - start < len(window) + slack
    start, end = start[near], end[near]
    same = segment.owner(start) == segment.owner(end)
    return start[same], end[same]


def _chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The test items, so many at a time that their text stays bounded."""
    chunk, words = [], 0
    for key, text in items.select(id_col, text_col).toLocalIterator():
        text = text.encode() if text else b""
        chunk.append(("null" if key is None else str(key), text))
        words += len(words_of(text))
        if words >= CHUNK_WORDS:
            yield chunk
            chunk, words = [], 0
    if chunk:
        yield chunk


def _rarity(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How often each of the terms stands in the corpus; terms that never do are left out."""
    wanted = index.sparkSession.sparkContext.broadcast(sorted(terms))

    def count(batches):
        known, total = pa.array(wanted.value, pa.binary()), np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            place = pc.index_in(batch.column("terms").flatten().cast(pa.binary()), value_set=known)
            has = place.is_valid().to_numpy(zero_copy_only=False)
            counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            np.add.at(total, place.drop_null().to_numpy(), counts[has])
        give_back()
        yield pa.RecordBatch.from_arrays([known, pa.array(total)], names=["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(count, "term binary, n bigint")
    found = counted.where("n > 0").groupBy("term").agg(F.sum("n")).collect()
    return {bytes(r[0]): r[1] for r in found}


def _match_segment(segment: Segment, by_rarest: dict, rarity: dict, slack: int | None) -> pa.RecordBatch:
    """A row for each document of the segment, with its matches of all windows."""
    hits = [([], [], set()) for _ in segment.docs]
    base = np.concatenate(([0], segment.ends))
    for term, listed in by_rarest.items():
        if term not in segment.starts:
            continue
        for window, keys in listed:
            if slack is None:
                start = phrase_starts(segment, window, rarity)
                end = start + len(window) - 1
            else:
                start, end = proximity_starts(segment, window, rarity, slack)
            for owner, a, b in zip(segment.owner(start).tolist(), start.tolist(), end.tolist(), strict=True):
                starts, ends, items = hits[owner]
                starts.append(a - int(base[owner]))
                ends.append(b - int(base[owner]) + 1)
                items.update(keys)
    n = len(segment.docs)
    columns = [
        pa.array([segment.name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(segment.docs, pa.int64()),
        pa.array(np.diff(base)), pa.array([h[0] for h in hits], pa.list_(pa.int64())),
        pa.array([h[1] for h in hits], pa.list_(pa.int64())),
        pa.array([sorted(h[2]) for h in hits], pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "place", "id", "n_words", "starts", "ends", "items"])


def find(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text",
         length: int = WINDOW, slack: int | None = None) -> DataFrame:
    """Exact matches of the items' windows in every indexed document, one row a document.

    starts and ends (excluded) are word positions of the matches in the document,
    items the ids, as strings, of the items with a matching window; all three are
    empty where nothing matches. With `slack` a match may have up to so many
    other words between the window's words (a proximity match). Items with a
    null id count under the name "null"; without items nothing matches.
    """
    spark = index.sparkSession
    parts = []
    for chunk in _chunks(items, item_id, item_text):
        windows = item_windows(chunk, length)
        rarity = _rarity(index, {t for w in windows for t in w})
        by_rarest = defaultdict(list)
        for window, keys in windows.items():
            rarest = min(window, key=lambda t: rarity.get(t, 0))
            if rarest in rarity:
                by_rarest[rarest].append((window, keys))
        sent = spark.sparkContext.broadcast((dict(by_rarest), rarity))

        def match(batches, sent=sent):
            asked = pa.array(sorted({t for listed in sent.value[0].values() for w, _ in listed for t in w}), pa.binary())
            for segment in segments(batches, asked):
                yield _match_segment(segment, *sent.value, slack)

        parts.append(index.mapInArrow(match, MATCH_TYPE))
    if not parts:
        def nothing(batches):
            for segment in segments(batches, pa.array([], pa.binary())):
                yield _match_segment(segment, {}, {}, slack)

        return index.mapInArrow(nothing, MATCH_TYPE)
    if len(parts) == 1:
        return parts[0]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    together = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")}
    return rows.groupBy("segment", "place").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        together["starts"], together["ends"], F.array_distinct(together["items"]).alias("items"),
    ).select(*rows.columns)


def _digest(starts: pa.Array, ends: pa.Array, items: pa.Array) -> pa.Array:
    hit, names, digests = [], [], []
    for a, b, keys in zip(starts.to_pylist(), ends.to_pylist(), items.to_pylist(), strict=True):
        covered, last = 0, 0
        for start, end in sorted(zip(a, b, strict=True)):
            covered += max(0, end - max(start, last))
            last = max(last, end)
        hit.append(covered)
        names.append(len(keys))
        digests.append(hashlib.sha256(",".join(sorted(keys)).encode()).hexdigest())
    return pa.StructArray.from_arrays([pa.array(hit, pa.int64()), pa.array(names, pa.int64()), pa.array(digests)],
                                      ["n_hit", "n_items", "items_sha256"])


def contamination(matches: DataFrame) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of find()."""
    digest = F.arrow_udf(_digest, "struct<n_hit: bigint, n_items: bigint, items_sha256: string>")
    return matches.select(
        "segment", "place", "id", "n_words", digest("starts", "ends", "items").alias("d")
    ).select("id", "n_words", "d.*", (F.col("d.n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, without any window of an item.

    Equal texts match alike, so rows are told apart by a number given on the way
    into the index, not by their ids, which may repeat or be null.
    """
    number = fresh(docs, "row_number")[0]
    numbered = scratch.store(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    index = build_index(numbered, scratch, number, text_col)
    dirty = scratch.store(
        find(index, items).where(F.size("starts") > 0).select(F.col("id").alias(number)), "dirty"
    )
    scratch.drop("index")
    return numbered.join(dirty, number, "left_anti").drop(number)
