"""The labelling job and the augmentation of rare classes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.functions.prompts import augmentation_prompt, label_prompt
from voxdesk.functions.text import is_blank
from voxdesk.operators.asking import (
    Model,
    Scorer,
    ask,
    cut_at_first_quota,
    explode_samples,
    parse_labels,
    score_labels,
    top_label,
    top_severity,
)
from voxdesk.operators.corpus import class_deficits
from voxdesk.operators.joins import unlabelled
from voxdesk.operators.ledger import Call, CallLedger
from voxdesk.operators.sizing import small_side
from voxdesk.operators.splits import sample_n
from voxdesk.session import ensure_checkpoint_dir


def label_messages(
    messages: DataFrame,
    labeler: Model,
    n: int = V.ONLINE_SAMPLE,
    existing: DataFrame | None = None,
    on_error: str = "drop",
    seed=V.SEED,
    id_col: str = "message_id",
    parallelism: int | None = None,
    ledger: CallLedger | None = None,
) -> DataFrame:
    """Sample messages, have them labelled, and keep what can be used.

    Texts that existing labels hold are left out first. on_error 'drop' removes
    failed rows and everything after the first quota error in sample order, and
    the waves of calls behind it are not made; 'default' takes only labels of
    the offline sets and gives all other rows the offline fallback labels. With
    'drop' calls are kept in a ledger; a given one shares its calls and its stop
    with other jobs, and a run on its folder takes up what was left.
    """
    if on_error not in ("drop", "default"):
        raise ValueError(f"on_error must be 'drop' or 'default', not {on_error!r}")
    sample = _sample(messages, existing, n, seed, id_col)
    prompt = label_prompt(F.col("text"))
    if on_error == "drop":
        ledger = ledger or CallLedger(messages.sparkSession, seed=seed, parallelism=parallelism)
        answered = ledger.ask(sample, [Call("label", labeler, prompt, also=("text",))], id_col)
        return parse_labels(answered, "label_answer").where(
            (F.col("label_status") == "ok") & F.col("intent").isNotNull()
        ).select(id_col, "text", "intent", "severity")
    # Answers are written once: a lost executor must not repeat paid calls that finished.
    answered = ask(sample.withColumn("prompt", prompt), labeler, parallelism=parallelism).checkpoint()
    parsed = parse_labels(answered)
    intent, severity = F.col("intent"), F.col("severity")
    scale = [int(s) for s in V.OFFLINE_SEVERITIES]
    return parsed.select(
        id_col,
        "text",
        F.when(intent.isin(V.OFFLINE_INTENTS), intent).otherwise(V.DEFAULT_INTENT).alias("intent"),
        F.when(severity.isin(scale), severity).otherwise(V.OFFLINE_DEFAULT_SEVERITY).alias("severity"),
    )


def _sample(messages: DataFrame, existing: DataFrame | None, n: int, seed, id_col: str) -> DataFrame:
    """(id_col, text) of n messages whose texts no existing label holds."""
    ensure_checkpoint_dir(messages.sparkSession)
    fresh = messages if existing is None else unlabelled(messages, existing, id_col=id_col)
    # Sampling reads its input several times. From written ids that is cheap,
    # while the anti join over the texts runs once.
    ids = fresh.select(id_col).checkpoint()
    chosen = small_side(sample_n(ids, n, seed, id_col))
    return messages.select(id_col, "text").join(chosen, id_col, "left_semi")


def label_by_scores(
    messages: DataFrame,
    scorer: Scorer,
    n: int = V.OFFLINE_SAMPLE,
    existing: DataFrame | None = None,
    seed=V.SEED,
    id_col: str = "message_id",
    parallelism: int | None = None,
) -> DataFrame:
    """The offline labelling job: sampled messages with the best-scored intent and severity.

    A scorer rates candidate labels for a text. It is asked twice a message, for
    the intents with the text, for the severities with the text, a blank and a
    description of the scale. A text for which either call fails gets both
    default labels; a best label outside the sets, or none, gets its default.
    """
    sample = _sample(messages, existing, n, seed, id_col)
    described = F.concat(F.col("text"), F.lit(" " + V.SEVERITY_SCALE))
    asked = {"intents": (F.col("text"), V.OFFLINE_INTENTS), "severities": (described, V.OFFLINE_SEVERITIES)}
    scored = score_labels(sample, scorer, asked, parallelism).checkpoint()
    ids = scored.select(id_col, (F.col("intents_error").isNull() & F.col("severities_error").isNull()).alias("__fine"))
    candidates = {task: scored.select(id_col, F.inline_outer(task)).where("label IS NOT NULL") for task in asked}
    intent = top_label(ids, candidates["intents"], id_col, V.OFFLINE_INTENTS)
    severity = top_severity(ids, candidates["severities"], id_col)
    joined = scored.select(id_col, "text").join(ids, id_col).join(intent, id_col).join(severity, id_col)
    return joined.select(
        id_col,
        "text",
        F.when(F.col("__fine"), F.col("intent")).otherwise(V.DEFAULT_INTENT).alias("intent"),
        F.when(F.col("__fine"), F.col("severity")).otherwise(V.OFFLINE_DEFAULT_SEVERITY).alias("severity"),
    )


def augment(
    labeled: DataFrame,
    generator: Model,
    labeler: Model,
    minimum: int = V.MIN_PER_CLASS,
    parallelism: int | None = None,
) -> DataFrame:
    """Append generated rows for classes below the minimum, flagged as synthetic.

    Every generated text is labelled again, so its intent may differ from the
    class it was asked for. Classes are taken from large to small, ties by name;
    nothing after the first quota error of either model is kept.
    """
    ensure_checkpoint_dir(labeled.sparkSession)
    prompts = class_deficits(labeled, "intent", minimum).select(
        F.col("intent").alias("wanted"),
        F.struct((-F.col("count")).alias("size"), "intent").alias("turn"),
        "needed",
        augmentation_prompt(F.col("intent"), F.col("needed")).alias("prompt"),
    )
    generated = ask(
        prompts, generator, parallelism=parallelism, stop_on_quota=True, order=F.col("turn")
    ).checkpoint()
    kept = cut_at_first_quota(generated, F.col("turn")).where(F.col("status") == "ok")
    samples = (
        explode_samples(kept, "answer", F.col("needed"))
        .where(~is_blank(F.col("sample")))
        .select("turn", "pos", F.col("sample").alias("text"))
        .withColumn("prompt", label_prompt(F.col("text")))
    )
    place = F.struct("turn", "pos")
    answered = ask(samples, labeler, parallelism=parallelism, stop_on_quota=True, order=place).checkpoint()
    before = cut_at_first_quota(answered, place)
    usable = (
        parse_labels(before.where(F.col("status") == "ok"))
        .where(F.col("intent").isNotNull())
        .select("text", "intent", "severity", F.lit(True).alias("is_synthetic"))
    )
    real = labeled.select("text", "intent", "severity", F.lit(False).alias("is_synthetic"))
    return real.unionByName(usable)
