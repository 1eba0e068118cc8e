"""Prediction log on Structured Streaming.

R1: ``readStream`` → score → ``foreachBatch`` append into a Parquet table
partitioned by (task, stream_id, batch_id). The stream id is the query id that the
checkpoint keeps, so batch ids that begin again at 0 in another checkpoint meet other
partitions. Re-running a micro-batch after a failure overwrites exactly its own
partition (dynamic partition overwrite), so the sink is idempotent and the checkpoint
gives exactly-once output.

The window is not operator state: it is derived from the sink (the latest
``maxlen`` rows per task, R2), so it survives restarts and executor loss.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.domain import LOG_MAXLEN
from cohortlens.operators.ordered import top_k_per_key
from cohortlens.sources.tables import path_exists

BOOKKEEPING = ("_score", "_ts", "logged_at", "stream_id", "batch_id", "row_seq", "task")
RESET_SCHEMA = "task string, stream_id string, reset_batch_id long, reset_at timestamp"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The query id in a checkpoint: kept over restarts, new for every new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def start_scoring_stream(spark: SparkSession, source: str, schema: T.StructType,
                         scorer: Callable[[DataFrame], DataFrame], task: str, sink: str,
                         checkpoint: str, available_now: bool = True, fmt: str = "parquet",
                         glob: str | None = None, sequence: str | None = None):
    """Score every new file of ``source``; append rows + ``_score`` + ``_ts`` to ``sink``.

    ``sequence`` names a source column that orders the rows of a batch; without one they keep scan order.
    ``scorer`` maps a DataFrame to one with a ``_score`` column (for example
    ``lambda df: scoring.score(df, model, task_obj)``).
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(source)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        out = scorer(df).withColumns({
            "_ts": F.date_trunc("second", F.current_timestamp()),
            "logged_at": F.current_timestamp(),
            "stream_id": F.lit(stream_id(spark, checkpoint)),
            "batch_id": F.lit(batch_id).cast("long"),
            "row_seq": F.col(sequence).cast("long") if sequence else F.monotonically_increasing_id(),
            "task": F.lit(task)})
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("task", "stream_id", "batch_id").parquet(sink))

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _resets(spark: SparkSession, sink: str) -> DataFrame:
    if path_exists(spark, sink + "_resets"):
        return spark.read.parquet(sink + "_resets")
    return spark.createDataFrame([], RESET_SCHEMA)


def log_rows(spark: SparkSession, sink: str) -> DataFrame:
    """Rows of the log that are after the latest reset of their task (R4 semantics)."""
    rows = spark.read.parquet(sink)
    r = _resets(spark, sink).groupBy("task", "stream_id").agg(F.max("reset_batch_id").alias("__reset"))
    # marks are per stream: rows of a stream that began after a clear are never behind its mark
    j = rows.join(r, ["task", "stream_id"], "left")
    return j.where(F.col("__reset").isNull() | (F.col("batch_id") > F.col("__reset"))).drop("__reset")


def window(spark: SparkSession, sink: str, maxlen: int = LOG_MAXLEN) -> DataFrame:
    """R2 + O4: the latest ``maxlen`` rows per task, newest last within the window order."""
    rows = log_rows(spark, sink)
    newest = [F.desc(c) for c in ("logged_at", "stream_id", "batch_id", "row_seq")]
    return top_k_per_key(rows, ["task"], newest, maxlen, "__rank",
                         salt=["stream_id", "batch_id", "row_seq"]).drop("__rank")


def counts(spark: SparkSession, sink: str, maxlen: int = LOG_MAXLEN) -> DataFrame:
    """Rows in the window per task = least(count, maxlen)."""
    return log_rows(spark, sink).groupBy("task").agg(F.least(F.count(F.lit(1)), F.lit(maxlen)).alias("n"))


def clear(spark: SparkSession, sink: str, task: str | None = None) -> None:
    """Append a mark for each stream of the task (its last batch id); readers skip rows at or before it."""
    rows = spark.read.parquet(sink)
    if task is not None:
        rows = rows.where(F.col("task") == task)
    marks = rows.groupBy("task", "stream_id").agg(F.max("batch_id").alias("reset_batch_id")).withColumn(
        "reset_at", F.current_timestamp())
    marks.write.mode("append").parquet(sink + "_resets")


def features_of(window_df: DataFrame) -> DataFrame:
    """The logged feature columns without bookkeeping columns."""
    return window_df.drop(*BOOKKEEPING)


def window_drift(spark: SparkSession, sink: str, task: str, reference: DataFrame, features: list[str],
                 reference_scores: DataFrame | None = None, maxlen: int = LOG_MAXLEN) -> dict[str, DataFrame]:
    """Drift report of the live window of ``task`` against ``reference``."""
    from cohortlens.operators.drift import drift_report
    w = window(spark, sink, maxlen).where(F.col("task") == task)
    cur_scores = w.select(F.col("_score").alias("score"))
    return drift_report(reference, features_of(w), features, reference_scores=reference_scores,
                        current_scores=cur_scores if reference_scores is not None else None)
