"""Near-equal lines removed by an exact set-similarity join, in DataFrame functions alone.

A line is its set of words. Words are ordered from rare to common; two sets with
a Jaccard similarity of SIMILAR must share a word in their first few, so only
such pairs are compared. Which of two words counts as rarer decides how many
pairs are compared and never which pairs are found.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxdesk.llm.common import Scratch, if_small

#: Least Jaccard similarity, as a fraction.
SIMILAR = (4, 5)
#: Lines of fewer distinct words are never removed; with 1 every line with a word is judged.
MIN_WORDS = 1
BLANKS = "\t\x0b\f\r"
#: Word counts are kept for so many buckets of words, on a logarithmic scale of so many steps a doubling.
BUCKETS = 65_536
STEPS = 4
#: Lines whose place or wide signature is sent to every task at once.
BROADCAST_ROWS = 400_000
#: Signatures of 64 bits that together are a wide one; a power of two.
LANES = 4
#: Words of a sketch.
SKETCH_WORDS = 3
_LAST = (1 << 63) - 1


def _plain(text: Column) -> Column:
    """Lower case, with spaces for other blanks but line ends."""
    text = F.lower(text)
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def word_set(line: Column) -> Column:
    """Hashes of the distinct words of a line in plain form, in order."""
    # Splitting at one character needs no regular expression.
    words = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(words, F.xxhash64(F.lit(""))))


def _lines(named: DataFrame) -> DataFrame:
    """(key, id, line_no, line): all lines in plain form."""
    # The outer form: the plain one makes the optimiser split every text twice.
    plain = named.select("key", "id", _plain(F.col("text")).alias("text"))
    lines = plain.select("key", "id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where("line_no IS NOT NULL")


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(texts: DataFrame) -> list[int]:
    """For each bucket of words how common they are, from 0 to 127.

    Every word of every text is counted. BUCKETS rows at most reach the driver,
    and BUCKETS small numbers go out to the tasks.
    """
    text = F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" "))
    words = texts.select(F.explode_outer(F.split(text, " ")).alias("word")).where("word != ''")
    out = [0] * BUCKETS
    for r in words.groupBy(_bucket(F.xxhash64("word")).alias("bucket")).count().collect():
        out[r["bucket"]] = min(127, int(STEPS * math.log2(r["count"] + 1)))
    return out


def by_rarity(words: Column, common: list[int]) -> Column:
    """The words in order: those of rare buckets first, then by hash."""
    steps = F.split(F.lit(",".join(map(str, common))), ",").cast("array<tinyint>")

    def key(word: Column) -> Column:
        low = word.bitwiseAND(F.lit((1 << 56) - 1))
        return low.bitwiseOR(F.shiftleft(F.get(steps, _bucket(word)).cast("bigint"), 56))

    return F.sort_array(F.transform(words, key))


def signature(words: Column) -> Column:
    """64 bits, each telling whether an odd number of the words fall on it.

    Two sets' signatures differ in no more bits than the sets differ in words.
    """
    one = F.lit(1).cast("bigint")
    bit = lambda w: F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda sum_, w: sum_.bitwiseXOR(bit(w)))


def wide_signature(words: Column) -> list[Column]:
    """The signatures of the words of each lane; a word's hash names its lane."""

    def of(lane: int) -> Column:
        return signature(F.filter(words, lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(LANES - 1)) == lane))

    return [of(k) for k in range(LANES)]


def sketches(words: Column, n: Column, below: Column) -> Column:
    """Four hashes of the word set, each of which two sets with similarity s share about once in s^-3.

    Each is of the three words whose hashes are nearest to an end of the order,
    or nearest to zero on one side; `below` of the n words are below zero.
    """
    parts = [(F.lit(1), 0), (F.greatest(n - 2, F.lit(1)), 1), (F.greatest(below - 2, F.lit(1)), 2), (F.greatest(F.least(below + 1, n), F.lit(1)), 3)]
    return F.array(*(F.xxhash64(F.lit(k), F.slice(words, begin, SKETCH_WORDS)) for begin, k in parts))


def _at_least(part: Column) -> Column:
    """The smallest whole number that is SIMILAR times part or more."""
    top, bottom = SIMILAR
    return F.floor((part * top + (bottom - 1)) / bottom).cast("int")


def _shared_at_least(a: Column, b: Column) -> Column:
    """Words that two sets of these sizes must share to be similar."""
    top, bottom = SIMILAR
    return F.ceil((a + b) * top / (top + bottom)).cast("int")


def line_classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str,
                 min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(named rows, lines, classes): lines with equal word sets are one class.

    A class has the first of its lines by (id, key, line number), the number of
    its lines, the number of words, their sketches and the prefix of words a
    similar set must share one of.
    """
    text = F.col(text_col)
    named = docs.select(
        F.xxhash64(F.col(id_col), text).alias("key"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("id"),
        F.col(id_col).alias("doc"), text.alias("text"),
    )
    # No filter on the sets before they are stored: it would make the optimiser build them twice.
    sets = _lines(named).select("key", "id", "line_no", word_set(F.col("line")).alias("words"))
    ranked = sets.select(
        "key", "id", "line_no", "words", F.size("words").alias("n"), F.size(F.filter("words", lambda w: w < 0)).alias("below"),
        by_rarity(F.col("words"), rarity(named.select("text"))).alias("ranked"),
    )
    words, n, below = F.col("words"), F.col("n"), F.col("below")
    # For candidates 32 bits of a word do; the verification compares all 64.
    prefix = F.transform(F.slice("ranked", 1, n - _at_least(n) + 1), lambda w: F.hash(w))
    lines = scratch.store(
        ranked.select(
            "key", "id", "line_no", "n", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"),
            signature(F.slice(words, 1, below)).alias("bits"), signature(F.slice(words, below + 1, n - below)).alias("more"),
            sketches(words, n, below).alias("sketches"), prefix.alias("prefix"),
        ), "lines",
    ).where(F.col("n") >= min_words)
    classes = (
        lines.groupBy("h1", "h2")
        .agg(F.min(F.struct("id", "key", "line_no")).alias("first"), F.count("*").alias("members"),
             *(F.first(c).alias(c) for c in ("n", "bits", "more", "sketches", "prefix")))
        .withColumn("class", F.monotonically_increasing_id())
    )
    return named, lines, scratch.store(classes, "classes")


def _apart(one: str, other: str) -> Column:
    """Bits in which two signatures differ, of columns with these endings."""
    return sum((F.bit_count(F.col(f"{c}{one}").bitwiseXOR(F.col(f"{c}{other}"))) for c in ("bits", "more")), F.lit(0))


def leader_pairs(classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): of the classes that share a sketch, each with one whose line is early.

    Sizes and signatures leave out pairs that cannot be similar.
    """
    rows = classes.select("class", F.col("first.id").alias("id"), F.explode("sketches").alias("sketch"))
    leaders = rows.groupBy("sketch").agg(F.min_by("class", "id").alias("a"), F.count("*").alias("rows"))
    pairs = rows.join(leaders.where("rows > 1").select("sketch", "a"), "sketch").where("class != a")
    pairs = pairs.select("a", F.col("class").alias("b")).distinct()
    for side in ("a", "b"):
        own = (F.col(c).alias(f"{c}_{side}") for c in ("n", "bits", "more"))
        pairs = pairs.join(classes.select(F.col("class").alias(side), *own), side)
    na, nb = F.col("n_a"), F.col("n_b")
    fits = (na >= _at_least(nb)) & (nb >= _at_least(na)) & (_apart("_a", "_b") <= na + nb - 2 * _shared_at_least(na, nb))
    return pairs.where(fits).select("a", "b", na.alias("na"), nb.alias("nb"))


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, na, nb): classes that share a prefix word and pass the other filters; a is no larger.

    Classes come with `done`: an earlier similar class is known. Pairs of two such
    are left out, so a group of near copies gives no pair for each two of it.
    The length filter leaves pairs whose sizes allow the similarity, and the
    signatures those that may differ in few enough words. The position filter
    takes the shared word for the first one: enough words must stand behind it in
    both sets. Both sides are the same rows, so they are dealt out once.
    """
    columns = ("class", "done", "n", "bits", "more", "place")
    words = classes.select("class", "done", "n", "bits", "more", F.posexplode("prefix").alias("place", "word"))
    a = words.select("word", *(F.col(c).alias(f"{c}_a") for c in columns))
    b = words.select("word", *(F.col(c).alias(f"{c}_b") for c in columns))
    na, nb, pa, pb = (F.col(c) for c in ("n_a", "n_b", "place_a", "place_b"))
    first = (na < nb) | ((na == nb) & (F.col("class_a") < F.col("class_b")))
    top, bottom = SIMILAR
    # In whole numbers: what _at_least and _shared_at_least say, at less cost a pair.
    sizes = na * bottom >= nb * top
    position = F.least(na - pa, nb - pb) * (top + bottom) >= (na + nb) * top
    near = _apart("_a", "_b") * (top + bottom) <= (na + nb) * (bottom - top)
    open_ = ~(F.col("done_a") & F.col("done_b"))
    pairs = a.join(b, "word").where(sizes & first & position & open_ & near)
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _near_pairs(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that the wide signatures leave; word sets are joined to these alone."""
    names = [f"s{k}" for k in range(LANES)]
    lanes = [c.alias(n) for n, c in zip(names, wide_signature(F.col("words")), strict=True)]
    wide = if_small(scratch.store(sets.select("class", *lanes), "wide"), BROADCAST_ROWS)
    for side in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("class").alias(side), *(F.col(n).alias(f"{n}{side}") for n in names)), side)
    apart = sum((F.bit_count(F.col(f"{n}a").bitwiseXOR(F.col(f"{n}b"))) for n in names), F.lit(0))
    na, nb = F.col("na"), F.col("nb")
    return pairs.where(apart <= na + nb - 2 * _shared_at_least(na, nb)).select("a", "b", "na", "nb")


def later_classes(pairs: DataFrame, named: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(class): of each pair whose sets have a Jaccard similarity of SIMILAR or more, the later one."""
    pairs = scratch.store(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    places = scratch.store(
        classes.join(wanted, "class").select("class", F.col("first.key").alias("key"), F.col("first.line_no").alias("line_no"), "first"),
        "places",
    )
    own = scratch.store(
        _lines(named).join(if_small(places.drop("first"), BROADCAST_ROWS), ["key", "line_no"])
        .select("class", word_set(F.col("line")).alias("words")).dropDuplicates(["class"]), "own",
    )
    near = scratch.store(_near_pairs(pairs, own, scratch), "near")
    full = own.join(places.select("class", "first"), "class").select("class", "words", "first")
    both = near.join(full.toDF("a", "wa", "fa"), "a").join(full.toDF("b", "wb", "fb"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    top, bottom = SIMILAR
    similar = both.where(shared * bottom >= (F.col("na") + F.col("nb") - shared) * top)
    later = similar.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("class")).distinct()
    return later


def matched_classes(named: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(class) of all classes to which an earlier class has a Jaccard similarity of SIMILAR or more.

    Most near copies are found with one early class of a shared sketch, a pair
    for each; the join on prefixes finds all others.
    """
    done = scratch.store(later_classes(leader_pairs(classes), named, classes, scratch), "done")
    scratch.drop("pairs", "places", "own", "wide", "near")
    marked = classes.join(if_small(done.withColumn("done", F.lit(True))), "class", "left")
    marked = marked.withColumn("done", F.coalesce("done", F.lit(False)))
    found = scratch.store(later_classes(candidates(marked), named, classes, scratch), "found")
    scratch.drop("pairs", "places", "own", "wide", "near")
    return done.union(found)


def removed_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(named rows, removed): key and the sorted numbers of the lines that an earlier similar line makes redundant.

    Lines are split at \\n and numbered from 0. Earlier is the line of the smaller
    id (null last), or the smaller line number in the same document; rows of one
    id follow a hash of id and text, and rows equal in both are one document.
    Lines of fewer than min_words distinct words, and all lines of null or empty
    texts, stay. Every line is judged on the input, not on what is left.
    """
    named, lines, classes = line_classes(docs, scratch, id_col, text_col, min_words)
    matched = matched_classes(named, classes, scratch).distinct().withColumn("matched", F.lit(True))
    judged = classes.select("class", "h1", "h2", "first", "members").join(if_small(matched), "class", "left")
    judged = judged.where("members > 1 OR matched").select("h1", "h2", "first", "matched")
    own = F.struct("id", "key", "line_no")
    gone = lines.select("key", "id", "line_no", "h1", "h2").join(judged, ["h1", "h2"]).where(
        F.col("matched") | (own > F.col("first"))
    )
    listed = gone.groupBy("key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    return named, listed


def line_counts(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """(id_col, n_lines, n_removed, removed_lines) of each row of docs; the line numbers are comma-joined."""
    named, removed = removed_lines(docs, scratch, id_col, text_col, min_words)
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = named.select("key", "doc", F.coalesce(ends + 1, F.lit(0)).cast("bigint").alias("n_lines"))
    return sizes.join(removed, "key", "left").select(
        F.col("doc").alias(id_col), "n_lines",
        F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def drop_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, other columns unchanged, their texts without the removed lines."""
    _, removed = removed_lines(docs, scratch, id_col, text_col, min_words)
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    body = docs.select(F.struct(*docs.columns).alias("body"), key.alias("key"), F.col(text_col).alias("text"))
    kept = F.filter(
        F.split("text", "\n"), lambda line, k: ~F.coalesce(F.array_contains(F.col("removed"), k), F.lit(False))
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = body.join(removed, "key", "left").withColumn("text", text)
    return joined.select(
        *(F.col("text").alias(c) if c == text_col else F.col(f"body.{c}").alias(c) for c in docs.columns)
    )
