"""The event log as a stream: ordered replay, status roll-up, idempotent requests, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaykit.operators.summary import PROBLEM_STATUSES

#: Payload fields that leave the engine (longer strings are cut), and statuses of trials that are not done.
PAYLOAD_FIELDS = (
    "status", "trial_status", "verdict", "grader", "case", "candidate", "repeat", "attempt", "stage", "reason",
    "counts", "planned", "terminal", "kind", "hash", "grading_run_id", "outcome", "message", "retryable",
)
OPEN_STATUSES = ("pending", "running")
PAYLOAD_LENGTH = 200


def read_log(spark: SparkSession, path: str, schema: str | StructType, *, files_per_trigger: int = 100) -> DataFrame:
    """The append-only log as a stream of new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def after(events: DataFrame, run: str, seq: int, *, run_column: str = "run_id", seq_column: str = "seq") -> DataFrame:
    """Events of a run past a sequence number; works on batches and streams, and reaches the scan as a filter."""
    return events.where((F.col(run_column) == run) & (F.col(seq_column) > seq))


def allowed_payload(payload: Column) -> Column:
    kept = F.map_filter(payload, lambda k, v: k.isin(*PAYLOAD_FIELDS))
    return F.transform_values(kept, lambda k, v: F.left(v, F.lit(PAYLOAD_LENGTH)))


COUNTERS = ("open", "errors", "asked", "trials", "events")


def _status(open_: Column, asked: Column, errors: Column) -> Column:
    """A run is open while a trial of it is; then cancelled if that was asked for, with errors if a trial has a problem or a
    grade failed, else completed."""
    return F.when(open_ > 0, "open").when(asked > 0, "cancelled").when(errors > 0, "completed_with_errors").otherwise("completed")


def trial_states(log: DataFrame) -> DataFrame:
    """The latest row of each trial (by seq), how many rows it has and how many of them asked to cancel. Rows without a trial
    are about the run itself."""
    last = F.max_by(F.struct("status", "grade_error"), "seq").alias("last")
    g = log.groupBy("run_id", "trial_id").agg(last, F.count_if("cancelled").alias("asked"), F.count("*").alias("events"), F.max("seq").alias("last_seq"))
    return g.select("run_id", "trial_id", "last.*", "asked", "events", "last_seq")


def rollup(log: DataFrame) -> DataFrame:
    """Status of each run from the latest status of its trials.

    ``log``: run_id, seq, trial_id, status, grade_error and cancelled (boolean). Without trial_id every row is a trial of its
    own, and the roll-up works on a stream too, in update mode. A stream of rows that replace earlier ones of their trial
    goes through ``follow_runs``.
    """
    failed = F.coalesce(F.col("status").isin(*PROBLEM_STATUSES), F.lit(False)) | F.coalesce("grade_error", F.lit(False))
    if "trial_id" in log.columns:
        log, asked, events = trial_states(log), F.sum("asked"), F.sum("events")
        last_seq = F.max("last_seq")
        of_trial = F.col("trial_id").isNotNull()
    else:
        asked, events, last_seq, of_trial = F.count_if("cancelled"), F.count("*"), F.max("seq"), F.lit(True)
    g = log.groupBy("run_id").agg(
        F.count_if(of_trial & F.col("status").isin(*OPEN_STATUSES)).alias("open"), F.count_if(of_trial & failed).alias("errors"),
        asked.alias("asked"), events.alias("events"), last_seq.alias("last_seq"),
    )
    return g.select("run_id", _status(F.col("open"), F.col("asked"), F.col("errors")).alias("status"), "events", "last_seq")


CHANGES = "run_id string, open long, errors long, asked long, trials long, events long, last_seq long"


def run_changes(log: DataFrame) -> DataFrame:
    """What each trial's newer rows change in its run's counters: a stream in update mode whose state is one small row a
    trial. A row that replaces an earlier one takes back what that one added, so counters go down as well as up; a row
    that comes late, behind a newer one of its trial, only counts as an event."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        run, trial = key
        seq, was_open, was_bad = state.get if state.exists else (-1, 0, 0)
        is_open, is_bad, known, events, asked, last = was_open, was_bad, state.exists, 0, 0, -1
        for df in frames:
            events, asked, last = events + len(df), asked + int(df["cancelled"].fillna(False).sum()), max(last, int(df["seq"].max()))
            row = df.loc[df["seq"].idxmax()]
            if int(row["seq"]) > seq and trial is not None:
                seq, is_open = int(row["seq"]), int(row["status"] in OPEN_STATUSES)
                is_bad = int(row["status"] in PROBLEM_STATUSES or row["grade_error"] is True or row["grade_error"] == True)  # noqa: E712
        state.update((seq, is_open, is_bad))
        added = [run, is_open - was_open, is_bad - was_bad, asked, int(not known and trial is not None), events, last]
        yield pd.DataFrame([added], columns=["run_id", *COUNTERS, "last_seq"])

    rows = log.select("run_id", "trial_id", "seq", "status", "grade_error", "cancelled")
    return rows.groupBy("run_id", "trial_id").applyInPandasWithState(step, CHANGES, "seq long, open int, bad int", "update", GroupStateTimeout.NoTimeout)


def follow_runs(log: DataFrame, path: str):
    """A writer (``DataStreamWriter``) that keeps the changes of each batch under ``path``; a batch that is done again replaces its
    own. Start it with a checkpointLocation. ``run_counters`` reads the sums."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_seq").alias("last_seq"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_changes(log).writeStream.outputMode("update").foreachBatch(keep)


def run_counters(spark: SparkSession, path: str) -> DataFrame:
    """Status of each run from the changes that ``follow_runs`` has kept so far."""
    g = spark.read.parquet(path).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_seq").alias("last_seq"))
    return g.select("run_id", _status(F.col("open"), F.col("asked"), F.col("errors")).alias("status"), "events", "last_seq")


def once(events: DataFrame, key: str, *, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the time that duplicates may be late; state beyond it is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, *, every: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events and mean value by type and tumbling window (an addition of this engine)."""
    g = events.withWatermark(time, late).groupBy(F.window(time, every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
