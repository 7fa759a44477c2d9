"""A fitted text classifier as tables, and scoring as a sparse matrix product.

The tables hold all there is to know of a fit: the vocabulary with its idf, the
coefficients, the intercepts and the loss of each iteration. Scoring joins the
TF-IDF weights of the documents with the coefficients, sums by document and
class, and applies softmax within a document's row. Saved tables score as the
model did, whatever reads them.
"""

import os
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, OneVsRestModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk.operators.features import grams, gram_weights
from voxdesk.operators.sizing import small_side

TABLES = {
    "vocabulary": "idx int, term string, idf double",
    "coefficients": "class int, idx int, weight double",
    "classes": "class int, label string, intercept double, form string",
    "curve": "epoch int, metric string, value double",
}


@dataclass(frozen=True)
class ModelTables:
    """vocabulary, coefficients, classes and curve of one fitted task, as in TABLES.

    form is 'softmax' or, for one classifier a class, 'one_vs_rest', which has no
    probabilities. Coefficients of zero are left out.
    """

    vocabulary: DataFrame
    coefficients: DataFrame
    classes: DataFrame
    curve: DataFrame


def _margins(fitted) -> tuple[list, list, str, list]:
    """(coefficient rows, intercepts, form, losses) with a row for each class."""
    if isinstance(fitted, OneVsRestModel):
        rows = [m.coefficients.toArray() for m in fitted.models]
        return rows, [m.intercept for m in fitted.models], "one_vs_rest", []
    losses = list(fitted.summary.objectiveHistory) if fitted.hasSummary else []
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(matrix) == 1 and fitted.numClasses == 2:  # the margin of the second class over the first
        return [0 * matrix[0], matrix[0]], [0.0, float(intercepts[0])], "softmax", losses
    return list(matrix), intercepts.tolist(), "softmax", losses


def model_tables(spark: SparkSession, model: PipelineModel) -> ModelTables:
    """The tables of a fitted task. Their size is that of the model, which the driver holds."""
    counted = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    idf = next(s for s in model.stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel | OneVsRestModel))
    rows, intercepts, form, losses = _margins(fitted)
    labels = model.stages[-1].getLabels()
    made = {
        "vocabulary": [(i, t, float(w)) for i, (t, w) in enumerate(zip(counted.vocabulary, idf, strict=True))],
        "coefficients": [(k, int(i), float(row[i])) for k, row in enumerate(rows) for i in row.nonzero()[0]],
        "classes": [(k, label, float(b), form) for k, (label, b) in enumerate(zip(labels, intercepts, strict=True))],
        "curve": [(k, "loss", float(v)) for k, v in enumerate(losses)],
    }
    return ModelTables(**{name: spark.createDataFrame(made[name], TABLES[name]) for name in TABLES})


def save_tables(tables: ModelTables, path: str) -> None:
    for name in TABLES:
        getattr(tables, name).write.mode("errorifexists").parquet(os.path.join(path, name))


def load_tables(spark: SparkSession, path: str) -> ModelTables:
    return ModelTables(**{name: spark.read.schema(kind).parquet(os.path.join(path, name)) for name, kind in TABLES.items()})


def scores_by_join(tables: ModelTables, df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, class, label, margin, score) of every row of df and class.

    df holds id_col, which tells rows apart, and cleaned `text`. A text without known
    terms, and a null one, has the intercepts as margins. score is null for
    one_vs_rest.
    """
    vocabulary = tables.vocabulary.orderBy("idx").select("term", "idf").collect()  # of a given size
    weights = gram_weights(grams(df, id_col), [r["term"] for r in vocabulary], [r["idf"] for r in vocabulary], id_col)
    products = weights.join(small_side(tables.coefficients.withColumnRenamed("weight", "coefficient")), "idx")
    sums = products.groupBy(id_col, "class").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("sum"))
    classes = [F.struct(F.lit(r["class"]).alias("class"), F.lit(r["label"]).alias("label"), F.lit(r["intercept"]).alias("b"))
               for r in tables.classes.orderBy("class").collect()]
    probable = tables.classes.where("form = 'softmax'").limit(1).count() == 1
    every = df.select(id_col, F.inline(F.array(*classes)))
    margins = every.join(sums, [id_col, "class"], "left").withColumn("margin", F.col("b") + F.coalesce("sum", F.lit(0.0)))
    listed = margins.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("class", "label", "margin"))).alias("m"))
    top = F.array_max(F.transform("m", lambda x: x.margin))
    parts = listed.withColumn("top", top).withColumn(
        "total", F.aggregate("m", F.lit(0.0), lambda total, x: total + F.exp(x.margin - F.col("top")))
    )
    out = parts.select(id_col, "top", "total", F.inline("m"))
    score = F.exp(F.col("margin") - F.col("top")) / F.col("total") if probable else F.lit(None).cast("double")
    return out.select(id_col, "class", "label", "margin", score.alias("score"))


def predict_by_join(tables: ModelTables, df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, label) of the greatest margin; of equal margins the first class."""
    best = F.max(F.struct("margin", (-F.col("class")).alias("before"), "label"))
    return scores_by_join(tables, df, id_col).groupBy(id_col).agg(best.alias("best")).select(id_col, F.col("best.label").alias("label"))
