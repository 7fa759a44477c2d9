"""Calls to text models that are paid for once and stop together.

A ledger is a committed table of calls under a shared folder. Rows are called in
waves, in the order of a seeded hash; each wave is written before the next one
starts, and within a wave one kind of call is written before the next kind. The
first quota error of any kind ends all calls of the run: later waves, later
kinds, later frames. A run that is started again on the same folder reads the
calls made before and repeats none of them.

Waves double in size, so a frame of any size has a few dozen of them, and the
first is small: a quota that is used up already costs few calls.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxdesk import fixed_values as V
from voxdesk.operators.asking import Model, ask
from voxdesk.operators.ranking import hash_key
from voxdesk.operators.sizing import small_side
from voxdesk.session import ensure_checkpoint_dir, shared_dir
from voxdesk.sources.commits import CommittedTable

FIRST_WAVE = 1_000
#: Hex digits of the hash that deal rows out to waves.
WAVE_DIGITS = 6
#: Shares of fewer bits have one level: a four-thousandth of all rows.
LEVEL_BITS = 12
#: Characters of a key up to which it is kept as it is: those of a digest.
KEY_CHARS = 64

CALLS = (
    "kind string, call_key string, digest string, run string, wave int, turn int, place string, answer string, "
    "error string, status string"
)
STOPS = "run string, frame int, wave int, turn int, place string"


@dataclass(frozen=True)
class Call:
    """One kind of call: its model, the prompt (null: not asked), and columns the model sees beside `prompt`."""

    kind: str
    model: Model
    prompt: Column
    also: tuple[str, ...] = ()


def wave_of(place: Column, rows: int, first: int = FIRST_WAVE) -> Column:
    """The wave of a row: 0 for about the first `first` rows in hash order, and twice as many up to each next wave."""
    share = F.conv(F.substring(place, 1, WAVE_DIGITS), 16, 10).cast("bigint")
    # The bit length of how many first waves go before the row.
    before = F.shiftright(share * F.lit(max(1, -(-rows // first))).cast("bigint"), 4 * WAVE_DIGITS)
    return F.when(before == 0, 0).otherwise(F.length(F.bin(before))).cast("int")


def level_of(place: Column) -> Column:
    """The bit length of a row's share of the hash, from LEVEL_BITS on: rows of a wave have a level or two."""
    share = F.conv(F.substring(place, 1, WAVE_DIGITS), 16, 10).cast("bigint")
    above = F.shiftright(share, LEVEL_BITS)
    return F.when(above == 0, 0).otherwise(F.length(F.bin(above))).cast("int")


def levels_of_wave(wave: int, rows: int, first: int = FIRST_WAVE) -> tuple[int, int]:
    """The lowest and highest level that rows of a wave can have."""
    size, of = 1 << 4 * WAVE_DIGITS, max(1, -(-rows // first))
    low = -(-(1 << wave - 1) * size // of) if wave else 0
    high = min(size - 1, -(-(1 << wave) * size // of) - 1)
    return (low >> LEVEL_BITS).bit_length(), (high >> LEVEL_BITS).bit_length()


def _short(key: Column) -> Column:
    """A key, or the digest of one that is longer, so that no text is kept with each call."""
    return F.when(F.length(key) > KEY_CHARS, F.sha2(key, 256)).otherwise(key)


def _keyed(made: DataFrame) -> DataFrame:
    """Calls with short keys; ledgers written earlier hold long ones as well."""
    return made.withColumn("call_key", _short(F.col("call_key")))


class CallLedger:
    """The calls of one run on a folder; several frames and kinds may use it one after the other.

    `stopped` tells whether a quota error has ended the run's calls. A frame that
    was left unfinished by another run is continued by asking again with the same
    keys and prompts. `token` names the run; repeated with the same token, a run
    takes up its own state, its quota error included.
    """

    def __init__(
        self, spark: SparkSession, folder: str | None = None, seed=V.SEED, first_wave: int = FIRST_WAVE,
        parallelism: int | None = None, token: str | None = None,
    ):
        ensure_checkpoint_dir(spark)
        self.spark, self.seed, self.first_wave, self.parallelism = spark, seed, first_wave, parallelism
        self.folder = folder or shared_dir(spark, "calls")
        self.run = token or uuid.uuid4().hex
        self.table = CommittedTable(spark, f"{self.folder}/calls", CALLS)
        self.stops = CommittedTable(spark, f"{self.folder}/stops", STOPS)
        self.frames = 0

    def _stop(self) -> tuple | None:
        """(frame, wave, turn, place) of the run's first quota error; one row."""
        row = self.stops.read().where(F.col("run") == self.run).first()
        return row and (row["frame"], row["wave"], row["turn"], row["place"])

    @property
    def stopped(self) -> bool:
        return self._stop() is not None

    def made(self) -> DataFrame:
        """All calls that were made, of all runs; a call that ended in a quota error counts as not made."""
        return self.table.read().where("status != 'quota'")

    def ask(self, df: DataFrame, calls: list[Call], *key: str) -> DataFrame:
        """df with columns <kind>_answer, <kind>_error and <kind>_status for each kind.

        `key` names the columns that tell rows apart; rows with equal keys and
        prompts share a call. A status is 'ok', 'error' or 'quota', null where the
        prompt is null. In the order of waves, kinds and hashes, rows from the
        first quota error on have the status 'quota', also those that other
        callers had answered by then; these answers wait in the ledger for the
        next run. Calls that fail otherwise are not repeated.
        """
        frame, self.frames = self.frames, self.frames + 1
        # Rows of equal keys are in one wave, so only calls made before this frame can have been theirs.
        before = list(self.table.commits())
        named, rows = self._written(df, calls, key)
        named = named.withColumn("__wave", wave_of(F.col("__place"), rows, self.first_wave))
        last = named.agg(F.max("__wave")).first()[0]
        for wave in range(0 if last is None else last + 1):
            own = F.col("__level").between(*levels_of_wave(wave, rows, self.first_wave)) & (F.col("__wave") == wave)
            for turn, call in enumerate(calls):
                if self.stopped:
                    break
                self._call_wave(named.where(own), call, frame, wave, turn, before)
        return self._answered(named, calls, frame, df.columns)

    def _written(self, df: DataFrame, calls: list[Call], key: tuple) -> tuple[DataFrame, int]:
        """Rows and the digests of their keys and prompts, written once before anything is paid for, and how many rows these are.

        They lie in folders by level, so that a wave reads its own rows and not those of all waves. Prompts are made
        again from these rows where they are used.
        """
        place = hash_key(self.seed, *key)
        own = F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
        digests = {"__key": _short(own)} | {f"__{c.kind}_digest": F.sha2(c.prompt, 256) for c in calls}
        named = df.withColumns({"__place": place, "__level": level_of(place), "__row": F.monotonically_increasing_id()} | digests)
        path = shared_dir(self.spark, "asked")
        named.write.partitionBy("__level").parquet(path)
        written = self.spark.read.schema(named.schema).parquet(path)
        return written, written.count()

    def _left_out(self, wanted: DataFrame, kind: str, before: list[str]) -> DataFrame:
        """(__row) of the wanted (__row, call_key, digest) that share a call with an earlier row or were answered before."""
        same = wanted.groupBy("call_key", "digest").agg(F.min("__row").alias("first"), F.count(F.lit(1)).alias("n"))
        repeated = wanted.join(same.where("n > 1"), ["call_key", "digest"]).where("__row != first").select("__row")
        if not before:
            return repeated
        done = _keyed(self.table.read(before).where("status != 'quota'")).where(F.col("kind") == kind)
        known = wanted.join(done, ["call_key", "digest"], "left_semi").select("__row")
        return repeated.unionByName(known)

    def _call_wave(self, own: DataFrame, call: Call, frame: int, wave: int, turn: int, before: list[str]) -> None:
        token = f"{self.run}-{frame}-{wave}-{turn}"
        if token not in self.table.commits():
            digest = F.col(f"__{call.kind}_digest")
            asked = own.where(digest.isNotNull())
            wanted = asked.select("__row", F.col("__key").alias("call_key"), digest.alias("digest"))
            # The texts stay where they are unless many rows are left out.
            left_out = small_side(self._left_out(wanted, call.kind, before))
            todo = asked.join(left_out, "__row", "left_anti").select(
                F.col("__key").alias("call_key"), digest.alias("digest"), "__place", call.prompt.alias("prompt"), *call.also
            )
            cores = self.spark.sparkContext.defaultParallelism
            spread = self.parallelism or (cores if own.rdd.getNumPartitions() < cores else None)
            answered = ask(todo, call.model, parallelism=spread, stop_on_quota=True, order=F.col("__place"))
            given = {"kind": call.kind, "run": self.run, "wave": wave, "turn": turn}
            self.table.append(
                answered.withColumns({c: F.lit(v) for c, v in given.items()}).withColumn("place", F.col("__place")), token
            )
        first = self.table.read([token]).where("status = 'quota'").agg(F.min("place").alias("place"))
        found = first.where("place IS NOT NULL").select(
            F.lit(self.run).alias("run"), F.lit(frame).alias("frame"), F.lit(wave).alias("wave"),
            F.lit(turn).alias("turn"), "place",
        )
        if not found.isEmpty():
            self.stops.append(found, f"{self.run}")

    def _answered(self, named: DataFrame, calls: list[Call], frame: int, columns: list[str]) -> DataFrame:
        stop = self._stop()
        made = _keyed(self.made())
        out = named
        for turn, call in enumerate(calls):
            digest = F.col(f"__{call.kind}_digest")
            own = made.where(F.col("kind") == call.kind).select(
                "call_key", "digest", F.col("answer").alias("__answer"), F.col("error").alias("__error"), F.col("status").alias("__status")
            )
            # Answers find their rows by digests alone; all kinds meet the texts by one column, in one shuffle.
            asked = named.where(digest.isNotNull()).select("__row", F.col("__key").alias("call_key"), digest.alias("digest"))
            out = out.join(asked.join(own, ["call_key", "digest"]).drop("call_key", "digest"), "__row", "left")
            before = F.lit(True)
            if stop:
                here = F.struct(F.lit(frame), F.col("__wave"), F.lit(turn), F.col("__place"))
                before = here < F.struct(*[F.lit(v) for v in stop])
            kept = before & F.col("__status").isNotNull()
            out = out.withColumns({
                f"{call.kind}_answer": F.when(kept, F.col("__answer")),
                f"{call.kind}_error": F.when(kept, F.col("__error")),
                f"{call.kind}_status": F.when(digest.isNotNull(), F.when(kept, F.col("__status")).otherwise("quota")),
            }).drop("__answer", "__error", "__status")
        added = [f"{c.kind}_{part}" for c in calls for part in ("answer", "error", "status")]
        return out.select(*columns, *added)

