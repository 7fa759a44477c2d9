"""Connected components over a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbourhood."""
    both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        links.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(u, v) for every node u that has a link, but the smallest of its component; v is that smallest.

    links has two columns of one orderable type, a pair of linked nodes a row.
    Repeated links, both directions and links of a node to itself are allowed;
    rows with a null are dropped. Without links the result is empty. Large and
    small stars alternate until nothing changes. Only minima are grouped, so a
    node with a third of all links costs no task more than its share.
    """
    a, b = links.columns
    current = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    current = scratch.store(current, f"{name}-0")
    seen, step = _state(current), 0
    while seen[0]:
        step += 1
        current = scratch.store(_small_star(_large_star(current)).distinct(), f"{name}-{step}")
        before, seen = seen, _state(current)
        scratch.drop(f"{name}-{step - 1}")
        if seen == before:
            break
    return current


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
