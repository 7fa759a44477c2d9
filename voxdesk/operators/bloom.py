"""Bloom filters: which rows can have no partner in a large table."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each hash it holds, and in all; PROBES bits are set by each hash.
BITS_PER_HASH, MAX_BITS, PROBES = 10, 1 << 29, 7


def _probe(hashes: Column, bits: int, k: int) -> Column:
    """The bit that a hash sets at the k-th probe; bits is a power of two."""
    return F.xxhash64(hashes, F.lit(k)).bitwiseAND(bits - 1)


def of_hashes(rows: DataFrame, hashes: Column) -> np.ndarray:
    """The filter of all hashes as an array of words.

    Bits are set word by word in one grouping, and the driver gets the words that
    are not zero: at most MAX_BITS bits, however many rows there are. A filter at
    that bound lets more rows through, and loses none.
    """
    wanted = max(64, rows.count() * BITS_PER_HASH)
    bits = min(MAX_BITS, 1 << (wanted - 1).bit_length())
    probes = F.array(*[_probe(hashes, bits, k) for k in range(PROBES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))
    words = (
        rows.select(F.explode(probes).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(bit).alias("value"))
    )
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return out


def might_hold(words: np.ndarray, hashes: Column) -> Column:
    """False where a hash is certainly not in the filter."""
    bits = len(words) * 64

    @F.arrow_udf("boolean")
    def of(*probes: pa.Array) -> pa.Array:
        held = np.ones(len(probes[0]), bool)
        for probe in probes:
            at = probe.to_numpy()
            held &= (words[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(held)

    return of(*[_probe(hashes, bits, k) for k in range(PROBES)])
