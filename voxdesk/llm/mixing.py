"""Mix sources to target weights from packed blocks of words.

The documents of a source, in an order given by their hashes, form one stream of
words that is cut into blocks of fixed length. A source fills so many slots of
the mix as its target asks for; each slot takes the block that a pseudorandom
permutation of the source's block numbers gives, one permutation after another,
so that no block is taken once more before all others were. How many of a
source's slots go to which output shard is drawn from a multinomial.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxdesk.llm.common import Scratch, as_bytes, fresh, partitions_for, small_table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
MAX_REPEATS = 3
SHARDS = 64
SEED = 10
#: Documents whose places in a stream one task works out.
BUCKET_ROWS = 20_000


@dataclass
class Source:
    name: str | None
    words: int
    target: float
    blocks: int
    slots: int
    #: Words that the last slot takes of its block.
    last: int


def targets(sizes: list[int], weights: list[float], most: float = MAX_REPEATS) -> list[float]:
    """Shares of the sum of all sizes by weight, none above `most` times its own size.

    What a share loses at its limit goes to the others by weight, until none is
    above its limit.
    """
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def plan_sources(sized: DataFrame, weights: dict | None = None, block: int = BLOCK_WORDS) -> list[Source]:
    """The sources by code point, null last, with their targets and slots.

    One row for each source goes through the driver; a corpus is mixed from a
    list of sources that somebody wrote down. Without given weights they weigh
    1, 2, 3, repeating.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    share = [weights[r["source"]] if weights else 1 + k % 3 for k, r in enumerate(rows)]
    out = []
    for r, target in zip(rows, targets([r["words"] for r in rows], share), strict=True):
        words, blocks = r["words"], -(-r["words"] // block)
        slots, last = _slots_for(len(out), words, blocks, target, block) if words else (0, block)
        out.append(Source(r["source"], words, target, blocks, slots, last))
    return out


def _slots_for(code: int, words: int, blocks: int, target: float, block: int) -> tuple[int, int]:
    """(slots, words of the last one) that take round(target) words of a source's blocks.

    Whole rounds take every block once. In the round begun then, the short last
    block of the stream stands somewhere among the slots, and the final slot takes
    what is left.
    """
    rounds = int(target // words)
    rest = round(target - rounds * words)
    if not rest:
        return rounds * blocks, block
    short = words - (blocks - 1) * block
    place = int(permuted(np.array([blocks - 1]), np.array([blocks]), _round_keys(np.array([code]), np.array([rounds])), back=True)[0])

    def taken(slots: int) -> int:
        return slots * block - (block - short if place < slots else 0)

    slots = -(-rest // block)
    slots += taken(slots) < rest
    return rounds * blocks + slots, rest - taken(slots - 1)


def _round_keys(code: np.ndarray, turn: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The key of the permutation that a source has in a round."""
    key = (code.astype(np.uint64) << np.uint64(20)) + turn.astype(np.uint64) + np.uint64(seed << 52)
    return key * np.uint64(0xD6E8FEB86659FD93)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..size-1 puts each index, or, going back, which index comes there.

    A Feistel network over the next even number of bits, applied again while the
    result lies outside.
    """
    half = np.uint64(1)
    bits = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (half << bits) - half
    out, key = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        if back:
            left, right = right, left
        for turn in range(3, -1, -1) if back else range(4):
            x = (right + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        if back:
            left, right = right, left
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def slots(spark, sources: list[Source], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(code, block, round, shard, slot, take): which block of which source fills each slot, and how many words of it.

    `code` is the source's place in the list. The driver draws shards numbers a
    source; the slots themselves are made by the tasks.
    """
    draw = np.random.default_rng(seed)
    plan = []
    for code, s in enumerate(sources):
        if s.slots:
            counts = draw.multinomial(s.slots, np.full(shards, 1 / shards))
            firsts = np.cumsum(counts) - counts
            plan += [
                (code, shard, int(a), int(a + n), s.blocks, s.slots - 1, s.last)
                for shard, (a, n) in enumerate(zip(firsts, counts, strict=True)) if n
            ]
    table = small_table(spark, plan, "code int, shard int, first bigint, last bigint, blocks bigint, final bigint, rest bigint")
    each = table.repartition(partitions_for(spark, len(plan), 1_000), "code", "shard").select(
        "code", "shard", "blocks", F.explode(F.sequence("first", F.col("last") - 1)).alias("k"), "final", "rest"
    )

    def choose(batches):
        for batch in batches:
            code, shard, blocks, k, final, rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            turn = k // blocks
            block = permuted(k % blocks, blocks, _round_keys(code, turn, seed))
            take = np.where(k == final, rest, BLOCK_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), pa.array(block), pa.array(turn), pa.array(shard), pa.array(k), pa.array(take)],
                names=["code", "block", "round", "shard", "slot", "take"],
            )

    return each.mapInArrow(choose, "code int, block bigint, round bigint, shard int, slot bigint, take bigint")


def sized_rows(docs: DataFrame, row: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, size, digest) of each row; a null text has size 0."""
    text = F.col(text_col)
    return docs.select(
        F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("digest"),
    )


def _coded(sized: DataFrame, sources: list[Source]) -> DataFrame:
    table = small_table(
        sized.sparkSession,
        [(s.name, k, s.words, s.target) for k, s in enumerate(sources)],
        "name string, code int, source_size bigint, target double",
    )
    # One row for each source of the plan.
    return sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).drop("name")


def starts(sized: DataFrame) -> DataFrame:
    """Add `start`, the row's first word in its source's stream.

    Rows follow a hash of (id, text), in buckets; the words before a bucket come
    from a table of one row for each source and bucket, so that a source with a
    third of all rows is worked out by as many tasks as it has buckets.
    """
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("id", "digest"), F.lit(buckets)).alias("bucket")
    rows = sized.select("*", bucket)
    words = rows.groupBy("code", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = words.select("code", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("base"))
    own = Window.partitionBy("code", "bucket").orderBy("id", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return local.join(words, ["code", "bucket"]).withColumn("start", F.col("base") + F.col("local")).drop(
        "base", "local", "bucket"
    )


def pieces(placed: DataFrame, chosen: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(row, round, first, last, shard, slot): the words of a row, last excluded, that a slot takes."""
    end = F.col("start") + F.col("size")
    spans = placed.where("size > 0").select(
        "row", "code", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"),
    )
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least(F.col("block") * block + F.col("take") - F.col("start"), F.col("size"))
    # The planner takes the slots for a small table, but they grow with the words.
    return spans.join(chosen.hint("merge"), ["code", "block"]).select(
        "row", "round", first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), "shard", "slot"
    ).where("last > first")


def taken_words(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: dict | None = None) -> DataFrame:
    """(id, size, source_size, target, taken) of each row of docs.

    taken counts the words of the row in the mix, repeats included: at most
    MAX_REPEATS times its size, and 0 for null and wordless texts. The null
    source is a source like any other. Repeated rows are rows of their own.
    An empty table gives an empty result. The mix follows from the rows and the
    seed alone.
    """
    row = fresh(docs, "row_number")[0]
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    sized = scratch.store(sized_rows(numbered, row, id_col, text_col, source_col), "sized")
    sources = plan_sources(sized, weights)
    placed = scratch.store(starts(_coded(sized, sources)), "placed")
    taken = (
        pieces(placed, slots(docs.sparkSession, sources))
        .groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    )
    return placed.join(taken, "row", "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, listed in zip(as_bytes(texts), spans.to_pylist(), strict=True):
        words = text.split()
        listed = sorted((s["first"], s["last"]) for s in listed)
        if sum(b - a for a, b in listed) == len(words):
            out.append(text)
        else:
            out.append(b" ".join(b" ".join(words[a:b]) for a, b in listed))
    return pa.array(out, pa.binary()).cast(pa.string())


def mixed_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as documents, with the columns of docs.

    Each permutation round that takes words of a document gives a row with its
    text, unchanged if all its words were taken, else the taken words in order,
    joined by a space. length_col, if there, is the new text's length. Documents
    of which nothing is taken are left out, among them null and wordless texts.
    """
    row, part = fresh(docs, "row_number", "part")
    numbered = scratch.store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sized = scratch.store(sized_rows(numbered, row, id_col, text_col, source_col), "sized")
    sources = plan_sources(sized)
    placed = scratch.store(starts(_coded(sized, sources)), "placed")
    # A row's pieces of one round are bounded by its own length.
    spans = (
        pieces(placed, slots(docs.sparkSession, sources))
        .groupBy(F.col("row").alias(row), "round")
        .agg(F.collect_list(F.struct("first", "last")).alias(part))
    )
    kind = dict(docs.dtypes)
    cut = F.arrow_udf(_cut, "string")(F.col(text_col), F.col(part))
    mixed = numbered.join(spans, row).withColumn(text_col, cut)
    if length_col in kind:
        mixed = mixed.withColumn(length_col, F.length(text_col).cast(kind[length_col]))
    return mixed.select(*docs.columns)
