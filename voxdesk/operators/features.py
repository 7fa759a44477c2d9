"""Vocabularies, TF-IDF weights and integer sequences as tables.

A document is one row, so its terms are weighed and numbered inside that row and
counted with those of the rows beside it: no text is shuffled, and only
vocabularies of a given size go out to the tasks.

Arrays are exploded with the outer form and nulls dropped after it. The plain
form adds a filter on the array's size below the explode, which would clean and
tokenise every text a second time.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.text import pad, seq_tokens, tokenize, with_ngrams
from voxdesk.operators.sizing import small_side
from voxdesk.session import ensure_checkpoint_dir, ship_package

#: Bytes of an Arrow batch whose n-grams are counted at once, and rows of counts handed back at once.
PIECE_BYTES = 12 << 20
OUT_ROWS = 100_000


def grams(df: DataFrame, *keep: str) -> DataFrame:
    """All word n-grams of each text as an array column, repeats included."""
    low, high = V.NGRAM_RANGE
    tokens = df.select(*keep, tokenize(F.col("text")).alias("__tokens"))
    return tokens.select(*keep, with_ngrams(F.col("__tokens"), low, high).alias("grams"))


def _batch_counts(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, n, docs): the distinct n-grams of some token lists, how often they stand there, in how many lists."""
    low, high = V.NGRAM_RANGE
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    words = lists.flatten().dictionary_encode()
    known, codes = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names, ids, terms, n, docs = known, codes, [], [], []
    for size in range(1, high + 1):
        if size > 1:
            # An n-gram is the (n-1)-gram at its place followed by the n-th word.
            inside = doc[size - 1 :] == doc[: len(doc) - size + 1]
            starts, ends = ids[:-1], codes[size - 1 :]
            pairs, dense = np.unique(starts[inside] * max(1, len(known)) + ends[inside], return_inverse=True)
            ids = np.full(len(starts), -1, np.int64)
            ids[inside] = dense
            parts = names.take(pa.array(pairs // max(1, len(known)))), known.take(pa.array(pairs % max(1, len(known))))
            names = pc.binary_join_element_wise(*parts, " ")
        if not len(names):
            break
        if size >= low:
            at = np.flatnonzero(ids >= 0)
            own = np.sort(doc[at] * len(names) + ids[at])
            own = own[np.diff(own, prepend=-1) > 0] % len(names)  # once a list
            terms.append(names)
            n.append(np.bincount(ids[at], minlength=len(names)))
            docs.append(np.bincount(own, minlength=len(names)))
    if not terms:
        return pa.array([], pa.string()), np.array([], np.int64), np.array([], np.int64)
    return pa.concat_arrays(terms), np.concatenate(n), np.concatenate(docs)


def _marks(df: DataFrame, by: str | None = None) -> DataFrame:
    """(by, term, n, d): how often an n-gram stands in some rows of a task, and in how many of them.

    The rows are those of a piece of an Arrow batch that have one value of `by`, an int column.
    """
    ship_package(df.sparkSession)
    group = F.col(by).cast("int") if by else F.lit(0)
    # One string a text goes to Python, with a blank between words, which hold none.
    words = F.array_join(tokenize(F.col("text")), " ")
    tokens = df.select(group.alias("__group"), words.alias("__words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in pc.unique(batch.column(0)):
                rows = pc.is_null(batch.column(0)) if not value.is_valid else pc.equal(batch.column(0), value)
                for texts in _pieces(batch.column(1).filter(pc.fill_null(rows, False))):
                    terms, n, docs = _batch_counts(pc.split_pattern(texts, " "))
                    for at in range(0, len(terms), OUT_ROWS):
                        part = terms.slice(at, OUT_ROWS)
                        same = pa.array([value.as_py()] * len(part), pa.int32())
                        columns = [same, part, pa.array(n[at : at + OUT_ROWS]), pa.array(docs[at : at + OUT_ROWS])]
                        yield pa.RecordBatch.from_arrays(columns, names=["group", "term", "n", "d"])

    counted = tokens.mapInArrow(run, "group int, term string, n bigint, d bigint")
    return counted.withColumnRenamed("group", by) if by else counted.drop("group")


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts that have words, in order, up to PIECE_BYTES bytes at a time and one text at least."""
    texts = texts.filter(pc.fill_null(pc.not_equal(texts, ""), False))
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    before, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + PIECE_BYTES, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def ngram_counts(df: DataFrame) -> DataFrame:
    """Corpus count and document count per n-gram, combined before the one shuffle by term."""
    return _marks(df).groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("docs"))


@dataclass(frozen=True)
class FoldCounts:
    """What all rows hold, and what each fold does: (term, n, docs, n_in, docs_in), documents, documents_in."""

    terms: DataFrame
    documents: int
    documents_in: list[int]


def fold_counts(df: DataFrame, folds: int) -> FoldCounts:
    """Counts of n-grams with a share for each fold, from one pass over the texts; df has an int column fold."""
    own = [F.col("fold") == k for k in range(folds)]
    shares = {
        f"{name}_in": F.array(*[F.sum(F.when(mine, F.col(c)).otherwise(0)) for mine in own])
        for name, c in (("n", "n"), ("docs", "d"))
    }
    counted = _marks(df, "fold").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("docs"), *[c.alias(name) for name, c in shares.items()]
    )
    ensure_checkpoint_dir(df.sparkSession)
    sizes = df.agg(F.count("*"), *[F.count(F.when(mine, 1)) for mine in own]).first()
    return FoldCounts(counted.checkpoint(), sizes[0], list(sizes[1:]))


def vocabularies_without(counts: FoldCounts, fold: int, sizes: list[int]) -> tuple[list[DataFrame], int]:
    """ngram_vocabulary() of the rows outside a fold for each size, by subtraction, and how many rows these are.

    A smaller vocabulary is the head of the largest, whose counts are searched once.
    """
    left = counts.terms.select(
        "term", (F.col("n") - F.col("n_in")[fold]).alias("n"), (F.col("docs") - F.col("docs_in")[fold]).alias("docs")
    ).where("n > 0")
    top = _most_frequent(left, max(sizes), "term").checkpoint()
    heads = [_numbered(top.orderBy(F.col("n").desc(), "term").limit(k)) for k in sizes]
    return heads, counts.documents - counts.documents_in[fold]


def _most_frequent(counts: DataFrame, k: int, term: str) -> DataFrame:
    """The k rows of greatest n, ties by term.

    A table of rows per count tells the count of the k-th row; only rows of that
    count or more are sorted, where a plain limit would merge k rows of each
    partition in one task. Rows of equal counts are few words of one rank, or, in
    a corpus of few repeats, sorted by all tasks.
    """
    ensure_checkpoint_dir(counts.sparkSession)
    counts = counts.checkpoint()
    ranks = counts.groupBy("n").agg(F.count("*").alias("rows"))
    up_to = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # One row per distinct count: at most about the square root of all words.
    before = F.coalesce(F.sum("rows").over(up_to), F.lit(0))
    least = ranks.select("n", before.alias("before")).where(F.col("before") < k).agg(F.min("n").alias("n"))
    frequent = counts.where(F.col("n") >= least.scalar())
    return frequent.orderBy(F.col("n").desc(), term).limit(k)


def ngram_vocabulary(df: DataFrame, k: int = V.TFIDF_TERMS) -> DataFrame:
    """The k most frequent n-grams, numbered in term order.

    The window sees at most k rows.
    """
    return _numbered(_most_frequent(ngram_counts(df), k, "term"))


def _numbered(top: DataFrame) -> DataFrame:
    return top.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


def weighing_stages(vocabulary: list[Row], documents: int, terms: str, out: str) -> list:
    """Model stages from a column of terms to L2-normalised TF-IDF vectors.

    vocabulary holds (term, docs) in idx order. Terms are counted within a row.
    """
    idf = [math.log((1 + documents) / (1 + row["docs"])) + 1 for row in vocabulary]
    return _weighing([r["term"] for r in vocabulary], idf, terms, out)


def _weighing(vocabulary: list[str], idf: list[float], terms: str, out: str) -> list:
    return [
        CountVectorizerModel.from_vocabulary(vocabulary, inputCol=terms, outputCol="__tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf"),
        Normalizer(p=2.0, inputCol="__tfidf", outputCol=out),
    ]


def tfidf_weights(df: DataFrame, k: int = V.TFIDF_TERMS, id_col: str = "doc_id") -> DataFrame:
    """L2-normalised tf * (ln((1 + N) / (1 + df)) + 1) per document and term.

    Every row is a document, also one that repeats an id; null and empty texts
    count as documents without terms. At most k rows reach the driver.
    """
    table = small_side(ngram_vocabulary(df, k))
    vocabulary = table.orderBy("idx").select("term", "docs").collect()
    if not vocabulary:
        empty = f"{id_col} {dict(df.dtypes)[id_col]}, term string, weight double"
        return df.sparkSession.createDataFrame([], empty)
    documents = df.count()
    idf = [math.log((1 + documents) / (1 + row["docs"])) + 1 for row in vocabulary]
    weights = gram_weights(grams(df, id_col), [r["term"] for r in vocabulary], idf, id_col)
    return weights.join(table.select("idx", "term"), "idx").select(id_col, "term", "weight")


def gram_weights(listed: DataFrame, vocabulary: list[str], idf: list[float], id_col: str) -> DataFrame:
    """(id_col, idx, weight): L2-normalised tf * idf of the known grams of each row of (id_col, grams)."""
    terms = listed.withColumn("grams", F.coalesce("grams", F.array().cast("array<string>")))
    found = F.unwrap_udt(F.col("__weights"))
    weights = PipelineModel(_weighing(vocabulary, idf, "grams", "__weights")).transform(terms).select(
        id_col, F.explode_outer(F.arrays_zip(found["indices"].alias("at"), found["values"].alias("weight"))).alias("w")
    )
    return weights.where("w IS NOT NULL").select(id_col, F.col("w.at").alias("idx"), "w.weight")


def token_index(df: DataFrame, cap: int = V.SEQUENCE_WORDS) -> DataFrame:
    """Word numbers by frequency; 1 stands for unknown words, all stay below cap.

    The window sees fewer than cap rows.
    """
    counts = (
        df.select(F.explode_outer(seq_tokens(F.col("text"))).alias("word"))
        .where(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    top = _most_frequent(counts, cap - 2, "word")
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "word"))
    known = top.select("word", "n", (place + V.OOV_INDEX).alias("idx"))
    unknown = df.sparkSession.range(1).select(
        F.lit(V.OOV_TOKEN).alias("word"), F.lit(0).cast("long").alias("n"), F.lit(V.OOV_INDEX).alias("idx")
    )
    return known.unionByName(unknown)


def encode_sequences(df: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, seq): the word numbers of each text in order; unknown words are 1.

    Null and empty texts have an empty sequence. The index, of a given size, goes
    to the tasks, where all words of an Arrow batch are looked up at once.
    """
    rows = index.where(F.col("word") != V.OOV_TOKEN).select("word", "idx").collect()
    words = [r["word"] for r in rows]
    # What stands behind the known words is the number of an unknown one.
    numbers = [*(r["idx"] for r in rows), V.OOV_INDEX]

    @F.arrow_udf("array<int>")
    def numbered(lists: pa.Array) -> pa.Array:
        found = pc.index_in(lists.flatten(), value_set=pa.array(words, pa.string()))
        places = pc.fill_null(found, len(words))
        sizes = pa.array([0]).cast(pa.int32()) if not len(lists) else pc.list_value_length(lists)
        ends = pc.cumulative_sum(sizes)
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        return pa.ListArray.from_arrays(starts[: len(lists) + 1], pa.array(numbers, pa.int32()).take(places))

    tokens = F.coalesce(seq_tokens(F.col("text")), F.array().cast("array<string>"))
    return df.select(id_col, numbered(tokens).alias("seq"))


def padded(sequences: DataFrame, length: int, side: str) -> DataFrame:
    return sequences.withColumn("seq", pad(F.col("seq"), length, side))
