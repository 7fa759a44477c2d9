"""The given tables seen as message, label, pair and score tables."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLASSES = 10


def class_sums(vector: Column) -> Column:
    """A score for each class k: the sum of all components at positions k, k + 10, k + 20 and so on."""

    def own(k: Column) -> Column:
        parts = F.filter(vector, lambda _, i: i % CLASSES == k)
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x.cast("double"))

    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), own)


class Tables:
    """Views over one folder of parquet tables; every view reads whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def read_texts(self, name: str) -> DataFrame:
        """A text table, spread if its scan has fewer partitions than cores.

        Text work is bound by CPU. A big table has partitions enough and is left
        as it lies.
        """
        rows = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

    def messages(self) -> DataFrame:
        return self.read("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
            F.col("role").alias("author_id"),
            (F.col("role") == "user").alias("inbound"),
            "text",
        )

    def messages_with_nulls(self) -> DataFrame:
        """System turns lose direction and author; each first turn adds three messages without text."""
        system = F.col("author_id") == "system"
        whole = self.messages().select(
            "message_id",
            F.when(~system, F.col("author_id")).alias("author_id"),
            F.when(~system, F.col("inbound")).alias("inbound"),
            "text",
        )
        first = self.messages().where(F.col("message_id") % 1000 == 0)
        blanks = F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \t\u00a0"))
        added = first.select("message_id", "author_id", "inbound", F.posexplode(blanks).alias("pos", "text"))
        return whole.unionByName(
            added.select((-F.col("message_id") * 3 - F.col("pos") - 1).alias("message_id"), "author_id", "inbound", "text")
        )

    def volume(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("message_id"),
            F.col("o_custkey").cast("string").alias("author_id"),
            (F.col("o_orderstatus") != "F").alias("inbound"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        )

    def created_at_text(self) -> DataFrame:
        """Order dates in the message form; pending orders hold junk instead."""
        text = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss '+0000' yyyy")
        return self.read("orders").select(
            F.col("o_orderkey").alias("message_id"),
            F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("pending "), text))
            .otherwise(text)
            .alias("created_at"),
        )

    def noisy_text(self) -> DataFrame:
        pages = self.read("pages").select(F.col("page_id").alias("doc_id"), "url")
        return self.read_texts("documents").join(pages, "doc_id", "left").select(
            "doc_id", F.concat_ws(" ", "text", "url").alias("text")
        )

    def documents(self) -> DataFrame:
        return self.read_texts("documents").select("doc_id", "text")

    def labeled(self) -> DataFrame:
        severity = 2 * F.col("toxic") + F.col("quality")
        return self.read_texts("documents").join(self.read("labels"), "doc_id").select(
            "doc_id", "text", F.col("lang").alias("intent"), severity.alias("severity")
        )

    def _with_predictions(self) -> DataFrame:
        """Orders with two predictions of their priority.

        The price model names the price band; the status model is right on
        closed orders and follows the price model elsewhere.
        """
        bands = F.array(*[F.lit(p) for p in PRIORITIES])
        band = F.least(F.floor(F.col("o_totalprice") / 100000).cast("int"), F.lit(4)) + 1
        by_price = F.element_at(bands, band)
        by_status = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("y_true"),
            F.coalesce(by_status, by_price).alias("by_status"),
            by_price.alias("by_price"),
        )

    def pairs(self) -> DataFrame:
        return self._with_predictions().select("id", "y_true", F.col("by_status").alias("y_pred"))

    def pairs_by_model(self) -> DataFrame:
        return self._with_predictions().withColumnsRenamed(
            {"by_status": "status", "by_price": "price"}
        ).unpivot(["id", "y_true"], ["status", "price"], "model", "y_pred")

    def pairs_binary(self) -> DataFrame:
        return self.read("documents").join(self.read("labels"), "doc_id").select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y_true"),
            (F.col("n_chars") > 800).cast("int").alias("y_pred"),
        )

    def scores_binary(self) -> DataFrame:
        return self.read("documents").join(self.read("labels"), "doc_id").select(
            F.col("n_chars").cast("double").alias("score"),
            (F.col("quality") == 1).alias("positive"),
        )

    def scores(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("label").alias("truth"),
            F.posexplode(class_sums(F.col("embedding"))).alias("class", "score"),
        )

    def ratings(self) -> DataFrame:
        """Assistant turns rated by their length; six stands outside the scale."""
        steps = F.floor(F.length("text") / 300).cast("int")
        return self.read("conversations").where(F.col("role") == "assistant").select(
            "conv_id",
            "turn",
            F.col("text").alias("generated_reply"),
            (F.lit(1) + F.least(F.lit(5), steps)).alias("rating"),
            F.concat(F.lit("r"), F.col("turn").cast("string")).alias("rater_id"),
        )

    def responses(self) -> DataFrame:
        """Label answers in several forms, by event type."""
        whole = F.floor("value").cast("bigint").cast("string")
        kind = F.col("event_type")
        answer = (
            F.when(kind == "view", F.concat(F.lit("Intent: View\nSeverity (0-3): "), whole))
            .when(kind == "click", F.concat(F.lit("  Click_Issue \r\n\n"), whole))
            .when(kind == "signup", F.lit("signup"))
            .when(kind == "purchase", F.concat(F.lit("intent:\nnone\nlevel -"), whole))
            .otherwise(F.when(F.col("value") < 50, " \n ").otherwise(F.concat(F.lit("error\n0"), whole)))
        )
        return self.read("events").select("event_id", answer.alias("answer"))

    def calls(self) -> DataFrame:
        """Events as calls: errors fail, those over 300 because of a quota."""
        failed = F.when(F.col("value") > 300, "HTTP 429 RESOURCE_EXHAUSTED").otherwise("timeout")
        return self.read("events").select(
            "event_id",
            F.col("props").alias("answer"),
            F.when(F.col("event_type") == "error", failed).alias("error"),
        )

    def label_candidates(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id"), F.col("event_type").alias("label"), F.col("value").alias("score")
        )

    def severity_candidates(self) -> DataFrame:
        """Price bands 0 to 4 as candidate severities per customer."""
        band = F.floor(F.col("o_totalprice") / 100000).cast("int").cast("string")
        return self.read("orders").select(
            F.col("o_custkey").alias("customer"), band.alias("label"), F.col("o_totalprice").alias("score")
        )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
