"""Repeated word sequences, found with suffix trees over groups of suffixes.

Every window of SPAN words holds SPAN - PREFIX + 1 sequences of PREFIX words;
the one with the smallest hash is its anchor. Equal windows have equal anchors,
so suffixes are dealt out by the words of their anchor. A first pass counts
anchors, and only suffixes whose anchor stands in the corpus twice go on, with
their words. A stretch of neighbouring suffixes with one anchor travels as one
row. Each group of rows becomes a tree of its suffixes, grown by doubling the
depth; nodes of depth SPAN with two suffixes are the repeats. An anchor that is
too frequent for a group is lengthened to the whole window, and what is needed of
such windows, their first place, is aggregated.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, as_bytes, partitions_for, word_ids

SPAN = 20
PREFIX = 6
#: Stretches of suffixes that a group should hold, and an anchor's stretches beyond which it is lengthened.
GROUP_ROWS = 40_000
HOT_ROWS = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1

RUN_TYPE = "key bigint, id bigint, anchor bigint, low int, high int"


class WordHashes:
    """64-bit hashes of words, remembered while there are not too many."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive words."""
    n = len(hashes) - length + 1
    out = np.full(max(n, 0), length, np.uint64)
    for k in range(length if n > 0 else 0):
        out = (out ^ hashes[k : n + k]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def anchor_runs(words: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first, last) of each stretch of window starts that have one anchor."""
    if len(words) < SPAN:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = sequence_hashes(hashes(words), PREFIX)
    width = SPAN - PREFIX + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return grams[place[first]], first, last


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys, ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        for k, text in enumerate(as_bytes(batch.column(2))):
            anchor, first, last = anchor_runs(text.split() if text else [], hashes)
            parts.append((np.full(len(anchor), k), anchor, first, last))
        row, anchor, first, last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, int)] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[row]), pa.array(ids[row]), pa.array(anchor.view(np.int64)),
             pa.array(first, pa.int32()), pa.array(last, pa.int32())],
            names=["key", "id", "anchor", "low", "high"],
        )


def depth_classes(stream: np.ndarray, depth: int) -> np.ndarray:
    """For each position, a number that equal sequences of `depth` words from there share.

    The numbers at depth d are the nodes of the suffix tree at that depth; depth
    2d comes from two nodes of depth d. Negative words are unlike anything,
    themselves included.
    """
    rank, at = _alike(stream), 1
    while at < depth:
        step = min(at, depth - at)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        pair = rank * (len(rank) + 1) + after + 1
        pair[(rank < 0) | (after < 0)] = -1
        rank, at = _alike(pair), at + step
    return rank


def _alike(values: np.ndarray) -> np.ndarray:
    """Numbers of values that stand twice or more; -1 for all others."""
    _, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    return np.where((counts[number] > 1) & (values >= 0), number, -1)


def _tree_repeats(group: pa.Table) -> pa.Table:
    """(key, low, high): window starts of the group that an equal window comes before."""
    words, lengths = [], []
    for content in group.column("content").to_pylist():
        own = content.split(b" ")
        words += own
        words.append(b" ")  # no word: ends the stretch
        lengths.append(len(own) + 1)
    ids, _ = word_ids(words)
    ends = np.cumsum(lengths)
    ids[ends - 1] = -1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    low = group.column("low").to_numpy()
    start = np.arange(len(ids)) - (ends - lengths)[owner] + low[owner]
    rank = depth_classes(ids, SPAN)
    at = np.flatnonzero(rank >= 0)
    doc, key = group.column("id").to_numpy(), group.column("key").to_numpy()
    order = at[np.lexsort((start[at], key[owner[at]], doc[owner[at]], rank[at]))]
    leads = np.concatenate(([True], rank[order][1:] != rank[order][:-1])) if len(order) else np.empty(0, bool)
    # Rows of one document read twice repeat nothing: equal places count as one.
    first = order[np.maximum.accumulate(np.where(leads, np.arange(len(order)), 0))] if len(order) else order
    same = (key[owner[order]] == key[owner[first]]) & (start[order] == start[first])
    later = np.sort(order[~same])
    return _stretches(key[owner[later]], start[later], owner[later])


def _stretches(key: np.ndarray, start: np.ndarray, owner: np.ndarray) -> pa.Table:
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 1) | (np.diff(owner) != 0)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(start)])) - 1 if len(first) else first
    return pa.table({"key": key[first], "low": start[first].astype(np.int32), "high": start[last].astype(np.int32)})


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first half, second half of a 128-bit hash of a window's words, id, key, start)."""
    for batch in batches:
        rows = []
        keys, ids, lows, contents = (batch.column(n).to_pylist() for n in ("key", "id", "low", "content"))
        for key, doc, low, content in zip(keys, ids, lows, contents, strict=True):
            words = content.split(b" ")
            for k in range(len(words) - SPAN + 1):
                digest = np.frombuffer(xxhash.xxh128_digest(b" ".join(words[k : k + SPAN])), np.int64)
                rows.append((int(digest[0]), int(digest[1]), doc, key, low + k))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.int32()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
            names=["h1", "h2", "id", "key", "start"],
        )


def _packed(texts: pa.Array) -> pa.Array:
    """(number of words, digest of all words, words joined by a space and compressed)."""
    packer = zstandard.ZstdCompressor(level=1)
    counts, digests, packed = [], [], []
    for text in as_bytes(texts):
        words = text.split() if text else []
        joined = b" ".join(words)
        counts.append(len(words))
        digests.append(hashlib.sha256(joined).hexdigest())
        packed.append(packer.compress(joined) if len(words) >= SPAN else None)
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(packed, pa.binary())],
        ["n_words", "digest", "packed"],
    )


def _words(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b" ")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, hot, key, id, low, high, content) of each repeated stretch.

    Of stretches with equal words in one batch only the first goes on. The
    others come without content: each of their windows stands earlier.
    """
    for batch in batches:
        first: dict[tuple[int, bytes], tuple] = {}
        out = []
        columns = (batch.column(n).to_pylist() for n in ("key", "id", "packed", "runs"))
        for key, doc, packed, runs in zip(*columns, strict=True):
            words = _words(packed)
            for run in runs:
                content = b" ".join(words[run["low"] : run["high"] + SPAN])
                own, name = (doc, key, run["low"], run["high"], run["hot"]), (run["anchor"], content)
                other = first.setdefault(name, own)
                if own < other:
                    first[name], own, other = own, other, own
                if own > other:
                    out.append((run["anchor"], own[4], own[1], own[0], own[2], own[3], None))
        out += [(anchor, hot, key, doc, low, high, c) for (anchor, c), (doc, key, low, high, hot) in first.items()]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)],
            names=["anchor", "hot", "key", "id", "low", "high", "content"],
        )


def _removed(packed: pa.Array, spans: pa.Array) -> pa.Array:
    counts, digests, texts = [], [], []
    for body, listed in zip(packed.to_pylist(), spans.to_pylist(), strict=True):
        words = _words(body)
        gone = np.zeros(len(words) + 1, np.int64)
        for span in listed:
            gone[span["low"]] += 1
            gone[span["high"] + SPAN] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = b" ".join(w for w, out in zip(words, gone.tolist(), strict=True) if not out)
        counts.append(int(gone.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        texts.append(kept)
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
        ["n_removed", "digest", "kept"],
    )


def repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of the repeated windows.

    documents: key, id, n_words, digest, and packed words where a window may be
    repeated. spans: key, low, high; a window of SPAN words that starts at low to
    high stands earlier too: in a document with a smaller id or, in the same
    document, before. Rows with equal id and text are one document; rows with an
    equal id but different texts follow the hash of both. Null ids come last. A
    null or short text has no window.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    named = docs.select(
        F.xxhash64(F.col(id_col), text).alias("key"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"),
        F.col(id_col).alias("doc"), text.alias("text"),
    )
    runs = scratch.store(named.select("key", "id", "text").mapInArrow(_runs, RUN_TYPE), "runs")
    counts = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchor", (F.col("n") > HOT_ROWS).alias("hot")
    )
    twice = scratch.store(
        runs.join(counts, "anchor").groupBy("key")
        .agg(F.collect_set(F.struct("anchor", "hot", "low", "high")).alias("runs")), "repeated"
    )
    scratch.drop("runs")
    body = F.arrow_udf(_packed, "struct<n_words: bigint, digest: string, packed: binary>")(F.col("text"))
    packed = named.select("key", "id", "doc", body.alias("body")).select("key", "id", "doc", "body.*")
    joined = packed.join(twice, "key", "left").select(
        "key", "id", "doc", "n_words", "digest",
        F.when(F.col("runs").isNotNull(), F.col("packed")).alias("packed"), "runs",
    )
    documents = scratch.store(joined, "documents")
    contents = documents.where("runs IS NOT NULL").select("key", "id", "packed", "runs").mapInArrow(
        _contents, "anchor bigint, hot boolean, key bigint, id bigint, low int, high int, content binary"
    )
    found = scratch.store(contents, "stretches")
    copies = found.where("content IS NULL").select("key", "low", "high")
    stretches = found.where("content IS NOT NULL").drop("high")
    groups = partitions_for(spark, stretches.count(), GROUP_ROWS)
    usual = (
        stretches.where("NOT hot").withColumn("bucket", F.pmod("anchor", F.lit(groups)))
        .groupBy("bucket").applyInArrow(_tree_repeats, "key bigint, low int, high int")
    )
    windows = stretches.where("hot").mapInArrow(_hot_windows, "h1 bigint, h2 bigint, id bigint, key bigint, start int")
    place = F.struct("id", "key", "start")
    firsts = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    hot = windows.join(firsts, ["h1", "h2"]).where(place > F.col("first")).select(
        "key", F.col("start").alias("low"), F.col("start").alias("high")
    )
    return documents.drop("runs"), usual.unionByName(hot).unionByName(copies)


def without_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    with_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of each row of docs, and kept_text if asked for.

    Words covered by a repeated window (see repeats()) are removed; kept_sha256
    is the digest of the others joined by a space. An empty table gives an empty
    result.
    """
    documents, spans = repeats(docs, scratch, id_col, text_col)
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cut = F.arrow_udf(_removed, "struct<n_removed: bigint, digest: string, kept: binary>")
    hit = documents.where("packed IS NOT NULL").join(listed, "key", "left")
    changed = hit.where("spans IS NOT NULL").withColumn("cut", cut("packed", "spans")).select(
        F.col("doc").alias(id_col), "n_words", F.col("cut.n_removed").alias("n_removed"),
        F.col("cut.digest").alias("kept_sha256"), F.col("cut.kept").cast("string").alias("kept_text"),
    )
    whole = hit.where("spans IS NULL").unionByName(documents.where("packed IS NULL"), allowMissingColumns=True).select(
        F.col("doc").alias(id_col), "n_words", F.lit(0).cast("bigint").alias("n_removed"),
        F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"),
    )
    out = changed.unionByName(whole)
    return out if with_text else out.drop("kept_text")
