"""Registered queries of the operators on training text, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.llm import (
    decontamination,
    language,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    phrases,
    quality,
    runs,
    sharding,
    simhash,
    substrings,
    warc,
)
from voxdesk.llm.common import Scratch


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    scratch = Scratch(spark, "decontamination")
    index = decontamination.build_index(read(spark, folder, "documents"), scratch, "doc_id", "text")
    found = decontamination.contamination(decontamination.find(index, read(spark, folder, "benchmark")))
    return found.withColumnRenamed("id", "doc_id")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document that a similar earlier line makes redundant."""
    return line_dedup.line_counts(read(spark, folder, "documents"), Scratch(spark, "lines"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    bundles = warc.write_bundles(read(spark, folder, "pages"), Scratch(spark, "warc"))
    return warc.read_bundles(bundles)


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence statements of every document."""
    docs = read(spark, folder, "documents")
    return licenses.summary(licenses.scan(docs, licenses.learn(docs)))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    scratch = Scratch(spark, "simhash")
    found = simhash.near_duplicates(read(spark, folder, "documents"), scratch)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    scratch = Scratch(spark, "quality")
    scored, _, threshold = quality.rate(
        read(spark, folder, "documents"), read(spark, folder, "labels"), scratch
    )
    return quality.verdict(scored, threshold).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "score",
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; the models never see the held-out fold."""
    docs = read(spark, folder, "documents")
    models = language.learn(docs, Scratch(spark, "language"), "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % language.FOLDS
    return language.identify(docs, models).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 20-word windows."""
    return substrings.without_repeats(read(spark, folder, "documents"), Scratch(spark, "substrings"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, the shards' bytes near equal."""
    scratch = Scratch(spark, "sharding")
    docs = read(spark, folder, "documents").select("doc_id", "text")
    digest = docs.select(
        "doc_id", *sharding.points(docs, "doc_id", "text"), F.monotonically_increasing_id().alias("row")
    )
    placed = sharding.assign_points(scratch.store(digest, "points"), 8)
    return sharding.with_slots(placed, "shard", "row", "slot").select(
        "doc_id", F.col("weight").alias("size"), F.col("digest").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    taken = mixing.taken_words(read(spark, folder, "documents"), Scratch(spark, "mixing"))
    return taken.withColumnRenamed("id", "doc_id")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs whose texts repeat a stretch of words if crc32(doc_id) ends in 0, as the contract of op11 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    begin = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    placed = begin.withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn(
        "p", F.floor((n - F.col("a")) / (F.lit(3) + g % 8)).cast("int") + 1
    )
    rest = n - F.col("a")
    unit = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    repeated = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(unit), F.lit(1), rest))
    text = F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return placed.withColumn("text", text).drop("h", "w", "a", "p")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document."""
    docs = with_planted_periods(read(spark, folder, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs)
    best = F.aggregate(
        "runs", F.lit(None).cast(runs.RUN),
        lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b),
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256", "n_words",
    )


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The collocations of every language."""
    return phrases.collocations(read(spark, folder, "documents"), Scratch(spark, "phrases"))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document among those of similar word shingles."""
    return near_dedup.near_duplicates(read(spark, folder, "documents"), Scratch(spark, "near"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_minhash": op13_minhash,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = f"""
WITH item AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[k:k + 9] END AS w
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT len(w) AS n FROM windows
), doc AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), spans AS (
    SELECT doc_id, n, k, w[k:k + n - 1] AS part
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, sizes WHERE len(w) >= n)
), hits AS (
    SELECT s.doc_id, s.n, s.k, x.item_id FROM spans s JOIN windows x ON s.part = x.w
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS = "coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [])"

_SUBSTRINGS = f"""
WITH doc AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
    SELECT doc_id, k, w[k:k + 19] AS part
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc WHERE len(w) >= 20)
), later AS (
    SELECT doc_id, k FROM (
        SELECT doc_id, k, row_number() OVER (PARTITION BY part ORDER BY doc_id, k) AS place FROM windows
    ) WHERE place > 1
), gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(k, k + 20)) AS p FROM later)
), word AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_BASE32 = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))

_WARC = f"""
WITH page AS (
    SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), digest AS (
    SELECT payload, min(page_id) AS first, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits
    FROM page GROUP BY payload
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32),
           lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + {_BASE32} AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, url AS target_uri, true AS payload_ok
FROM page JOIN digest USING (payload)
"""

_LINES = """
WITH line AS (
    SELECT doc_id, i - 1 AS line_no, list_distinct(regexp_extract_all(lower(l[i]), '[^\\x20\\x09-\\x0D]+')) AS w
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), class AS (
    SELECT list_sort(w) AS w, len(w) AS n, min((doc_id, line_no)) AS first, row_number() OVER () AS class
    FROM line WHERE len(w) >= 1 GROUP BY list_sort(w), len(w)
), word AS (
    SELECT class, n, first, unnest(w) AS word FROM class
), linked AS (
    SELECT b.class FROM word a JOIN word b USING (word)
    WHERE a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
    GROUP BY a.class, b.class, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), gone AS (
    SELECT doc_id, line_no FROM line JOIN class ON list_sort(line.w) = class.w
    WHERE len(line.w) >= 1 AND ((doc_id, line_no) > first OR class IN (SELECT class FROM linked))
), listed AS (
    SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS names
    FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(names, '') AS removed_lines
FROM documents LEFT JOIN listed USING (doc_id)
"""

_PHRASES = f"""
WITH piece AS (
    SELECT lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS part
        FROM documents)
), gram AS (
    SELECT lang, len, array_to_string(w[k:k + len - 1], ' ') AS phrase FROM (
        SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS k
        FROM piece, (SELECT unnest(range(1, 6)) AS len) WHERE len(w) >= len)
), counted AS (
    SELECT lang, len, phrase, count(*) AS a FROM gram GROUP BY lang, len, phrase HAVING count(*) >= 100
), total AS (
    SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM piece GROUP BY lang
), candidate AS (
    SELECT lang, len, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE len > 1
), cut AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:len], ' ') AS y
    FROM (SELECT *, unnest(range(1, len)) AS k FROM candidate)
), scored AS (
    SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, k,
           (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
    FROM cut c JOIN counted x ON c.lang = x.lang AND c.x = x.phrase
    JOIN counted y ON c.lang = y.lang AND c.y = y.phrase JOIN total t ON c.lang = t.lang
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT DISTINCT b.lang, b.phrase FROM candidate b JOIN candidate o
    ON b.lang = o.lang AND o.len > b.len AND 100 * o.a >= 100 * b.a
    AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best ANTI JOIN longer USING (lang, phrase)
QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op12_collocations": _PHRASES,
    "op8_substring_dedup": _SUBSTRINGS,
    "op1_decontamination": _DECONTAMINATION,
    "op2_line_dedup": _LINES,
    "op3_warc": _WARC,
}
