"""Shards of equal bytes: a k-d tree over metadata, split at distributed weighted medians.

DataFrame functions only. What goes through the driver is one small histogram a
round: at most BINS rows for every node that is being split.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxdesk.llm.common import Scratch, fresh, if_small, small_table

BINS = 2_048
#: A cut is exact enough when the bin that holds it weighs this share of its node.
BALANCE = 0.001
#: Copies of one text stay together unless they weigh more than this share.
GROUP_BALANCE = 0.01

#: Columns of the points, all of them whole numbers from 0 below 2 ** 33.
DIMENSIONS = ("log_size", "density", "digest")
ORDER = ("digest", "row_hash")


@dataclass
class Cut:
    """What a node's rows are compared with: (widest dimension, digest, row hash) <= values go left."""

    node: int
    dimension: int
    values: tuple[int, int, int]


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more; 1 for null."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; that of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def points(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Weight, dimensions, tie-breaker and root node of each row.

    The dimensions are the logarithm of the size, the bytes a character takes
    (which tells scripts apart) and a digest of the text; equal texts have equal
    values in all of them.
    """
    text = F.col(text_col)
    size = text_size(text)
    chars = F.coalesce(F.length(text), F.lit(0)) + 1
    return [
        size.alias("weight"),
        F.floor(F.log2(size.cast("double")) * (1 << 26)).cast("bigint").alias("log_size"),
        F.floor(size / chars * (1 << 26)).cast("bigint").alias("density"),
        text_crc(text).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 32)).alias("row_hash"),
        F.lit(1).cast("bigint").alias("node"),
    ]


def _key(dimension: Column) -> Column:
    return F.element_at(F.array(*DIMENSIONS), dimension + 1)


def place(rows: DataFrame, levels: list[list[Cut]]) -> DataFrame:
    """Turn `node`, 1 at the root, into the leaf each row reaches through the cuts of all levels."""
    spark = rows.sparkSession
    for cuts in levels:
        table = small_table(
            spark,
            [(c.node, c.dimension, *c.values) for c in cuts],
            "node bigint, dimension int, cut0 bigint, cut1 bigint, cut2 bigint",
        )
        left = F.struct(_key(F.col("dimension")), *ORDER) <= F.struct("cut0", "cut1", "cut2")
        # One row for each node of the level: fewer than there are shards.
        rows = rows.join(F.broadcast(table), "node", "left").withColumn(
            "node", F.when(F.col("dimension").isNull(), F.col("node") * 2).otherwise(
                F.col("node") * 2 + F.when(left, 0).otherwise(1))
        ).drop("dimension", "cut0", "cut1", "cut2")
    return rows


def _cuts(rows: DataFrame, parts: dict[int, int]) -> list[Cut]:
    """A cut for each node, so that the left side gets its share of the node's weight.

    parts maps a node to the number of shards it is to hold. The widest dimension
    of a node, relative to the whole table, is cut. The cut is searched by
    histograms, finer each round, of all nodes at once: first along the
    dimension, then among rows of equal coordinate by digest, then by row hash.
    """
    ranges = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("weight").alias("weight"), *ranges).collect()}
    if not seen:
        return []
    whole = [
        max(r[f"high_{d}"] for r in seen.values()) - min(r[f"low_{d}"] for r in seen.values()) + 1
        for d in DIMENSIONS
    ]
    state = {}
    for node, count in parts.items():
        r = seen.get(node)
        if r is None or count < 2:
            continue
        widths = [(r[f"high_{d}"] - r[f"low_{d}"]) / w for d, w in zip(DIMENSIONS, whole, strict=True)]
        k = widths.index(max(widths))
        state[node] = {
            "dimension": k, "stage": 0, "fixed": [], "low": r[f"low_{DIMENSIONS[k]}"],
            "high": r[f"high_{DIMENSIONS[k]}"], "below": 0, "total": r["weight"],
            "goal": r["weight"] * (count // 2) / count,
        }
    done = []
    while state:
        table = small_table(
            rows.sparkSession,
            [
                (node, s["dimension"], s["stage"], *(s["fixed"] + [0, 0])[:2], s["low"], s["high"],
                 max(1, -(-(s["high"] - s["low"] + 1) // BINS)))
                for node, s in state.items()
            ],
            "node bigint, dimension int, stage int, fixed0 bigint, fixed1 bigint, low bigint, high bigint, width bigint",
        )
        key = F.element_at(F.array(_key(F.col("dimension")), *ORDER), F.col("stage") + 1)
        inside = (
            ((F.col("stage") < 1) | (_key(F.col("dimension")) == F.col("fixed0")))
            & ((F.col("stage") < 2) | (F.col("digest") == F.col("fixed1")))
            & key.between(F.col("low"), F.col("high"))
        )
        bins = (
            rows.join(F.broadcast(table), "node").where(inside)
            .groupBy("node", F.floor((key - F.col("low")) / F.col("width")).alias("bin"))
            .agg(F.sum("weight").alias("weight"))
            .collect()
        )
        for node in list(state):
            s = state[node]
            width = max(1, -(-(s["high"] - s["low"] + 1) // BINS))
            below, found = s["below"], None
            for r in sorted((r for r in bins if r["node"] == node), key=lambda r: r["bin"]):
                found = r["bin"], r["weight"]
                if below + r["weight"] >= s["goal"]:
                    break
                below += r["weight"]
            at, weight = found
            first = s["low"] + at * width
            last = min(s["high"], first + width - 1)
            enough = GROUP_BALANCE if s["stage"] == 1 and width == 1 else BALANCE
            if weight > enough * s["total"] and width > 1:
                s.update(low=first, high=last, below=below)
            elif weight > enough * s["total"] and s["stage"] < 2:
                s.update(stage=s["stage"] + 1, fixed=[*s["fixed"], first], low=0, high=(1 << 32) - 1, below=below)
            else:
                # Left of the bin or behind it, whichever is nearer to the goal.
                edge = last if below + weight - s["goal"] <= s["goal"] - below else first - 1
                tail = [edge] + [(1 << 33)] * (2 - s["stage"])
                if edge < s["low"] and not below:  # never leave one side empty
                    tail[0] = last
                done.append(Cut(node, s["dimension"], tuple(s["fixed"] + tail)))
                del state[node]
    return done


def learn(rows: DataFrame, shards: int) -> tuple[list[list[Cut]], dict[int, int]]:
    """(levels of cuts, shard number of each leaf node) for tables of points().

    A node that holds several shards is cut into halves of its shards, until
    each leaf is one. Fewer distinct rows than shards leave some shards empty.
    """
    levels, parts = [], {1: max(1, shards)}
    while max(parts.values()) > 1:
        cuts = _cuts(place(rows, levels), parts)
        levels.append(cuts)
        # A leaf, and an empty node, goes on as its own left child.
        parts = {
            child: n
            for node, count in parts.items()
            for child, n in ((2 * node, count // 2 if count > 1 else 1), (2 * node + 1, count - count // 2 if count > 1 else 0))
            if n
        }
    return levels, {node: k for k, node in enumerate(sorted(parts))}


def assign_points(table: DataFrame, shards: int) -> DataFrame:
    """Add `shard` to a stored table with the columns of points()."""
    levels, names = learn(table.select("weight", *DIMENSIONS, "row_hash", "node"), shards)
    known = small_table(table.sparkSession, list(names.items()), "node bigint, shard int")
    return place(table, levels).join(F.broadcast(known), "node").drop("node")


def with_slots(rows: DataFrame, shard: str, row: str, slot: str) -> DataFrame:
    """Add `slot`, numbers without gaps from 0 inside each shard.

    `row` is a stored monotonically_increasing_id: its upper bits are the task
    that wrote the row, so rows are numbered per (shard, task) and no task gets
    a whole shard. What each task starts from is a table of tasks times shards,
    broadcast only if it is small.
    """
    task = F.shiftright(F.col(row), 33)
    sizes = rows.groupBy(F.col(shard).alias("s"), task.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    starts = if_small(sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    own = Window.partitionBy(shard, task).orderBy(row)
    local = rows.withColumn(slot, F.row_number().over(own) - 1)
    joined = local.join(starts, (F.col(shard) == F.col("s")) & (task == F.col("t")))
    return joined.withColumn(slot, (F.col(slot) + F.col("start")).cast("bigint")).drop("s", "t", "n", "start")


def assign(docs: DataFrame, scratch: Scratch, shards: int | None = None, target_bytes: int | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with `shard` and `slot` (names made unique if taken).

    Give the number of shards, or the bytes a shard should have at most on
    average. Null and empty texts weigh 1. Rows that are equal in every respect
    may be cut apart only where their copies' weight demands it. An empty table
    gives an empty result.
    """
    shard, slot = fresh(docs, "shard", "slot")
    body = F.struct(*docs.columns).alias("body")
    table = scratch.store(
        docs.select(body, *points(docs, id_col, text_col), F.monotonically_increasing_id().alias("row")), "numbered"
    )
    if shards is None:
        total = table.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = assign_points(table, shards)
    return with_slots(placed, "shard", "row", "slot").select(
        "body.*", F.col("shard").alias(shard), F.col("slot").alias(slot)
    )
