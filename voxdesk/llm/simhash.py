"""SimHash near-duplicates, found with vantage-point trees over the fingerprints.

Two fingerprints within `bits` differing bits have a part of their bits, out of
`parts`, in which they differ in bits // parts at most. For each part a tree
splits the fingerprints by Hamming distance to vantage points. A leaf is a
shard. A fingerprint belongs to one leaf of each tree and also visits the leaves
that the triangle bound cannot exclude. Over parts the bound is a single bit
wide; over the whole fingerprint it would be four bits each way, which is two
thirds of random fingerprints at every node.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, each_text, give_back
from voxdesk.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: A trees' sample, in fingerprints.
SAMPLE = 16_384
#: Fingerprints a leaf should hold, the depth no tree exceeds, and what one task compares.
LEAF_ROWS = 4_096
MAX_DEPTH = 10
BLOCK_ROWS = 32_768
#: Fingerprint pairs compared at once.
CELLS = 1 << 21

_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    rows = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    rows[: len(hashes)] = hashes
    rows = rows.reshape(-1, 255)
    counts = np.empty(64, np.int64)
    for k in range(8):
        lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included; zero without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    bits = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_udf(size: int = SHINGLE_WORDS, seed: int = SEED):
    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t, size, seed) for t in each_text(texts)], np.uint64)
        give_back()
        return pa.array(values.view(np.int64))

    return of


@dataclass
class Tree:
    """A vantage-point tree over one part of the bits, its nodes in arrays.

    A node with radius -1 is a leaf, and its `inside` is the leaf's number.
    """

    shift: int
    mask: int
    slack: int
    point: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray

    def part(self, values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) >> np.uint64(self.shift)) & np.uint64(self.mask)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, leaf, home) of each leaf a value belongs to or has to visit.

        Of two leaves within reach of each other only the one with the larger
        number is visited, so each pair of values meets once.
        """
        part = self.part(values)
        found, stack = [], [(0, np.arange(len(part)), np.ones(len(part), bool))]
        while stack:
            node, at, home = stack.pop()
            if not len(at):
                continue
            if self.radius[node] < 0:
                found.append((at, np.full(len(at), self.inside[node]), home))
                continue
            far = np.bitwise_count(part[at] ^ self.point[node]).astype(np.int64)
            near = far <= self.radius[node]
            go_in = far - self.slack <= self.radius[node]
            go_out = far + self.slack > self.radius[node]
            stack.append((self.inside[node], at[go_in], (home & near)[go_in]))
            stack.append((self.outside[node], at[go_out], (home & ~near)[go_out]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        at, leaf, home = (np.concatenate(x) for x in zip(*found, strict=True))
        own = np.empty(len(part), np.int64)
        own[at[home]] = leaf[home]
        keep = home | (leaf > own[at])
        return at[keep], leaf[keep], home[keep]


def build_tree(sample: np.ndarray, shift: int, width: int, slack: int, depth: int) -> Tree:
    """A tree over `width` bits from `shift`, split at medians of the sample.

    Of up to 16 vantage points at a node the one whose boundary holds the fewest
    sampled values is taken. A node whose values no point can split is a leaf.
    """
    point, radius, inside, outside = [], [], [], []
    leaves = 0
    mask = (1 << width) - 1
    values = (sample.view(np.uint64) >> np.uint64(shift)) & np.uint64(mask)

    def grow(own: np.ndarray, left: int) -> int:
        nonlocal leaves
        node = len(point)
        for column, empty in ((point, 0), (radius, -1), (inside, leaves), (outside, 0)):
            column.append(empty)
        best = None
        if left and len(own) > 1:
            for candidate in own[:: max(1, len(own) // 16)][:16]:
                far = np.bitwise_count(own ^ candidate).astype(np.int64)
                middle = int(np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2])
                for cut in (middle, middle - 1):
                    near = int((far <= cut).sum())
                    if 0 < near < len(own):
                        edge = int((np.abs(far - cut - 0.5) < slack).sum())
                        cost = edge + abs(2 * near - len(own))
                        if best is None or cost < best[0]:
                            best = cost, candidate, cut, far <= cut
        if best is None:
            leaves += 1
            return node
        _, point[node], radius[node], near = best
        inside[node] = grow(own[near], left - 1)
        outside[node] = grow(own[~near], left - 1)
        return node

    grow(values, depth)
    return Tree(
        shift, mask, slack, np.array(point, np.uint64), np.array(radius, np.int64),
        np.array(inside, np.int64), np.array(outside, np.int64),
    )


def _pointers(labels: np.ndarray) -> np.ndarray:
    while True:
        shorter = labels[labels]
        if np.array_equal(shorter, labels):
            return labels
        labels = shorter


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; a set's label is its smallest position."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        labels = _pointers(labels)


def link_block(tree: Tree, values: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Labels that join values within `bits` of a home value.

    The tree goes on inside the block: a vantage point splits the home values at
    their median distance, and the others go where the triangle bound lets them.
    """
    whole, part = values.view(np.uint64), tree.part(values)
    labels = np.arange(len(values))
    stack = [(np.flatnonzero(home), np.arange(len(values)))]
    while stack:
        own, other = stack.pop()
        if not len(own) or not len(other):
            continue
        split = None
        if len(own) * len(other) > CELLS:
            for candidate in part[own[:: max(1, len(own) // 8)]][:8]:
                far = np.bitwise_count(part[own] ^ candidate).astype(np.int64)
                cut = int(np.median(far))
                cut -= (far <= cut).all()
                if (far <= cut).any():
                    split = candidate, cut, far <= cut
                    break
        if split:
            candidate, cut, near = split
            far = np.bitwise_count(part[other] ^ candidate).astype(np.int64)
            stack.append((own[near], other[far - tree.slack <= cut]))
            stack.append((own[~near], other[far + tree.slack > cut]))
            continue
        step = max(1, CELLS // len(other))
        for start in range(0, len(own), step):
            some = own[start : start + step]
            close = np.bitwise_count(whole[some][:, None] ^ whole[other][None, :]) <= bits
            i, j = np.nonzero(close)
            labels = _hook(labels, some[i], other[j])
    return labels


def fingerprint_links(
    fingerprints: DataFrame, scratch: Scratch, bits: int = MAX_BITS, parts: int = 4
) -> DataFrame:
    """(a, b) links that join the same fingerprints as all pairs within `bits` do.

    fingerprints has one column `fp` of distinct 64-bit values. The trees are
    grown on a sample of at most about SAMPLE values; every value is put into
    every tree. Of the links inside a shard a spanning star is returned, so a
    ball of near copies gives as many links as it has members. A shard too large
    for one task is compared in blocks of chunks of it.
    """
    spark = fingerprints.sparkSession
    rows = fingerprints.count()
    keep = min(1.0, SAMPLE / max(rows, 1))
    drawn = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(keep * (1 << 30))
    sample = np.sort(np.array([r[0] for r in fingerprints.where(drawn).collect()], np.int64))
    sample = np.random.default_rng(SEED).permutation(sample)
    depth = min(MAX_DEPTH, max(0, (rows // LEAF_ROWS).bit_length()))
    width = 64 // parts
    trees = [build_tree(sample, k * width, width, bits // parts, depth) for k in range(parts)]
    sent = spark.sparkContext.broadcast(trees)

    def route(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k, tree in enumerate(sent.value):
                at, leaf, home = tree.route(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k * 65_536 + leaf, pa.int32()), pa.array(values[at]), pa.array(home)],
                    names=["leaf", "fp", "home"],
                )

    routed = scratch.store(
        fingerprints.select("fp").mapInArrow(route, "leaf int, fp bigint, home boolean"), "routed"
    )
    sizes = routed.groupBy("leaf").count().select(
        "leaf", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("chunks")
    )
    # One row a leaf: at most parts * 2 ** MAX_DEPTH rows.
    routed = routed.join(F.broadcast(sizes), "leaf")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    blocks = routed.withColumn("own", own).withColumn("other", F.explode(every)).select(
        "leaf", "fp", "home", "own", "other"
    )
    # Block (i, j) compares the home values of chunk i with chunk j, j >= i for home values.
    as_home = blocks.where("home").select("leaf", "fp", F.lit(True).alias("home"),
                                          F.col("own").alias("i"), F.col("other").alias("j"))
    as_guest = blocks.where("NOT home OR other < own").select(
        "leaf", "fp", F.lit(False).alias("home"), F.col("other").alias("i"), F.col("own").alias("j")
    )

    def links(key, group):
        tree = sent.value[int(key[0]) // 65_536]
        values, home = group["fp"].to_numpy(), group["home"].to_numpy()
        labels = link_block(tree, values, home, bits)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": values[moved], "b": values[labels[moved]]})

    return (
        as_home.unionByName(as_guest)
        .groupBy("leaf", "i", "j")
        .applyInPandas(links, "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
) -> DataFrame:
    """A row (id_col, fp, component_id) for each row of docs.

    A null or blank text has no words and fingerprint zero, and is linked like
    any other. Rows with equal texts or equal fingerprints are linked. A
    component is named by its smallest id that is not null (null if there is
    none). An empty table gives an empty result; other columns are not read.
    """
    prints = scratch.store(
        docs.select(F.col(id_col).alias("id"), fingerprint_udf(size)(F.col(text_col)).alias("fp")),
        "fingerprints",
    )
    classes = scratch.store(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = fingerprint_links(classes.select("fp"), scratch, bits)
    joined = components(links, scratch)
    scratch.drop("routed")
    rooted = classes.join(joined, classes.fp == joined.u, "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
