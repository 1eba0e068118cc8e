"""Versioned model registry and run history as Parquet tables.

Layout under ``root``::

    artifacts/<task>/<version>/        everything of one version, in a folder that one save alone owns:
        model                          PipelineModel directory
        _rows/models                   one row: scalars, parameters, details
        _rows/leaderboard              long rows (task, version, model, metric, mean, std, ...)
        _rows/tuning                   trial rows (task, version, number, value, state, params, duration)
    commits/<task>/<number>            one line of JSON for each published version; the highest number is ``latest``
    runs/, run_params/, run_metrics/   experiment history

A version is published by creating the commit file with the next number, which must not exist yet (compare and swap: who comes
second takes the number after it). Readers start from the commits, so a version is seen whole or not at all, and concurrent saves never
write to one folder. A lost executor only redoes its own task. ``root`` should be a shared, durable folder.
"""

from __future__ import annotations

import json
import math
import platform
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

import pyspark
from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.tables import path_exists

MODELS_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("model_name", T.StringType()), T.StructField("family", T.StringType()),
    T.StructField("params", T.StringType()), T.StructField("metrics", T.StringType()),
    T.StructField("threshold", T.DoubleType()), T.StructField("conformal_q", T.DoubleType()),
    T.StructField("cv_score", T.DoubleType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("spark_version", T.StringType()), T.StructField("python_version", T.StringType()),
    T.StructField("complete", T.BooleanType()), T.StructField("details", T.StringType()),
])


def version_stamp(ts: datetime | None = None) -> str:
    """Sortable ``YYYYMMDD-HHMMSS`` version string (UTC)."""
    return (ts or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")


def finite_scalars(metrics: Mapping[str, Any]) -> dict[str, float]:
    """keep finite numeric metrics only (no bool / NaN / inf / strings / lists)."""
    out = {}
    for k, v in metrics.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            continue
        if math.isfinite(float(v)):
            out[k] = float(v)
    return out


def finite_metric_rows(df: DataFrame, value: str = "value") -> DataFrame:
    """F1 on a typed metric table."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent 16-hex-character fingerprint of a table's content.

    ``sum`` of per-row 64-bit hashes as a decimal (no overflow) plus the row
    count, hashed once more. Not bit-equal to a row-order-dependent hash, by design.
    """
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("s"))
    return agg.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")),
                                         256), 1, 16).alias("fingerprint"))


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _p(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        path = self._p(name)
        if path_exists(self.spark, path):
            return self.spark.read.parquet(path)
        if schema is None:
            raise FileNotFoundError(path)
        return self.spark.createDataFrame([], schema)

    # ---------------------------------------------------------------- publishing
    def _created(self, name: str, content: str) -> bool:
        """Create a file that must not exist; false if another process has it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._p(name))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in str(exc.java_exception) or "already exists" in str(exc.java_exception):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        # file systems without an exclusive create let the last writer win: what is there tells who that was
        back = fs.open(path)
        try:
            return bytes(back.readAllBytes()).decode() == content
        finally:
            back.close()

    def _own_version(self, task: str, version: str) -> str:
        """A version whose folder no other save writes to: the stamp, or the stamp and a number."""
        token, n, name = uuid.uuid4().hex, 1, version
        while not self._created(f"artifacts/{task}/{name}/_owner", token):
            n += 1
            name = f"{version}-{n}"
        return name

    def _publish(self, task: str, version: str) -> int:
        """Append the version to the commits of its task; returns its number."""
        while True:
            last = self.commits().where(F.col("task") == task).agg(F.max("number")).first()[0]
            number = (last or 0) + 1
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            line = json.dumps({"task": task, "version": version, "number": number, "updated_at": now.isoformat(sep=" "), "by": uuid.uuid4().hex})
            if self._created(f"commits/{task}/{number:012d}", line):
                return number

    def commits(self) -> DataFrame:
        """(task, version, number, updated_at) of every published version."""
        schema = "task string, version string, number long, updated_at timestamp"
        if not path_exists(self.spark, self._p("commits")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).json(self._p("commits"))

    def _published(self, name: str, schema: str | T.StructType | None = None) -> DataFrame:
        """The rows ``name`` of all published versions."""
        done = self.commits().select("task", "version").distinct().collect()  # one row a version
        paths = [p for r in done if path_exists(self.spark, p := self._p(f"artifacts/{r['task']}/{r['version']}/_rows/{name}"))]
        if paths:
            return self.spark.read.parquet(*paths)
        if schema is None:
            raise FileNotFoundError(self._p(f"artifacts/*/*/_rows/{name}"))
        return self.spark.createDataFrame([], schema)

    # ---------------------------------------------------------------- S10
    def save(self, task: str, model: PipelineModel, *, model_name: str, family: str,
             params: Mapping[str, Any], metrics: Mapping[str, Any], leaderboard: DataFrame | None = None,
             tuning: DataFrame | None = None, threshold: float | None = None, conformal_q: float | None = None,
             cv_score: float | None = None, fingerprint_value: str | None = None,
             version: str | None = None, details: Mapping[str, Any] | None = None,
             tables: Mapping[str, DataFrame] | None = None) -> str:
        """One version of a task: the model, its scalars, ``details`` (features, row counts, interval
        level and bounds, mitigation attribute ...) and ``tables`` by name (group thresholds, fairness, importance ...).

        Returns the version, which has a number after the stamp where the stamp is taken. Nothing is visible before all is written.
        """
        version = self._own_version(task, version or version_stamp())
        base = self._p(f"artifacts/{task}/{version}")
        for name, df in (tables or {}).items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
        path = f"{base}/model"
        model.write().overwrite().save(path)
        row = (task, version, model_name, family, json.dumps(dict(params), sort_keys=True, default=str),
               json.dumps(dict(metrics), sort_keys=True, default=str), threshold, conformal_q, cv_score,
               fingerprint_value, path, datetime.now(timezone.utc).replace(tzinfo=None), pyspark.__version__,
               platform.python_version(), True, json.dumps(dict(details or {}), sort_keys=True, default=str))
        self.spark.createDataFrame([row], MODELS_SCHEMA).write.parquet(f"{base}/_rows/models")
        if leaderboard is not None:
            mcols = [c[:-5] for c in leaderboard.columns if c.endswith("_mean")]
            long = leaderboard.select(
                "model", "family", F.col("rank").cast("int").alias("rank"), "fit_seconds",
                F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"),
                                             F.col(f"{m}_std").alias("std")) for m in mcols])).alias("m"))
            (long.select(F.lit(task).alias("task"), F.lit(version).alias("version"), "model", "family", "rank",
                         "m.metric", "m.mean", "m.std", "fit_seconds").write.parquet(f"{base}/_rows/leaderboard"))
        if tuning is not None:
            (tuning.select(F.lit(task).alias("task"), F.lit(version).alias("version"), "*").write.parquet(f"{base}/_rows/tuning"))
        self._publish(task, version)
        return version

    # ---------------------------------------------------------------- S11-S14
    def models(self) -> DataFrame:
        return self._published("models", MODELS_SCHEMA)

    def versions(self, task: str) -> DataFrame:
        """Published versions of a task, sorted."""
        return self.models().where((F.col("task") == task) & F.col("complete")).select("version").orderBy("version")

    def latest_versions(self) -> DataFrame:
        """S13 + S14: the version of each task's last commit."""
        return self.commits().groupBy("task").agg(F.max_by("version", "number").alias("version"))

    def latest_version(self, task: str) -> str | None:
        r = self.latest_versions().where(F.col("task") == task).first()
        return r["version"] if r else None

    def load(self, task: str, version: str | None = None) -> tuple[PipelineModel, dict[str, Any]]:
        """Load by task and optional version; clear error when nothing is registered."""
        version = version or self.latest_version(task)
        if version is None:
            raise FileNotFoundError(f"No trained model for task '{task}' under {self.root}; train one first.")
        row = self.models().where((F.col("task") == task) & (F.col("version") == version)).first()
        if row is None:
            raise FileNotFoundError(f"Version {version} of task '{task}' not found")
        return PipelineModel.load(row["path"]), {**row.asDict(), "details": json.loads(row["details"] or "{}")}

    def table(self, task: str, name: str, version: str | None = None) -> DataFrame | None:
        """A table that was saved with a version (the latest by default); none if it has no such table."""
        path = self._p(f"artifacts/{task}/{version or self.latest_version(task)}/{name}")
        return self.spark.read.parquet(path) if path_exists(self.spark, path) else None

    def fairness(self, task: str, version: str | None = None) -> DataFrame | None:
        """The stored subgroup audit of a model."""
        return self.table(task, "fairness", version)

    def importance(self, task: str, version: str | None = None) -> DataFrame | None:
        """The stored feature importance of a model, largest first."""
        found = self.table(task, "importance", version)
        return found if found is None else found.orderBy(F.desc("importance"))

    # ---------------------------------------------------------------- S15, S16, S22
    def leaderboard(self, task: str, version: str | None = None) -> DataFrame:
        """Leaderboard rows of a version (latest by default), wide by metric."""
        version = version or self.latest_version(task)
        lb = self._published("leaderboard").where((F.col("task") == task) & (F.col("version") == version))
        return (lb.groupBy("model", "family", "rank", "fit_seconds").pivot("metric")
                .agg(F.first("mean")).orderBy("rank"))

    def info(self) -> DataFrame:
        """Scalar metrics of every model version in long form (metric JSON → map)."""
        m = self.models().select("task", "version", "model_name", "threshold", "cv_score",
                                 F.from_json("metrics", "map<string,double>").alias("m"))
        return m.select("task", "version", "model_name", "threshold", "cv_score",
                        F.explode_outer("m").alias("metric", "value"))

    def compare_latest(self, metrics: list[str]) -> DataFrame:
        """Latest version per task with its model, CV score and selected hold-out metrics."""
        lat = self.latest_versions()
        inf = self.info().where(F.col("metric").isin(metrics))
        piv = inf.groupBy("task", "version", "model_name", "cv_score").pivot("metric", metrics).agg(F.first("value"))
        return lat.join(piv, ["task", "version"], "left")

    # ---------------------------------------------------------------- S17, S18
    def log_run(self, run_id: str, task: str, params: Mapping[str, Any], metrics: Mapping[str, Any],
                tags: Mapping[str, str] | None = None, steps: Mapping[str, list[float]] | None = None) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(run_id, task, now, json.dumps(dict(tags or {})))],
                                   "run_id string, task string, started_at timestamp, tags string") \
            .write.mode("append").parquet(self._p("runs"))
        self.spark.createDataFrame([(run_id, k, str(v)) for k, v in params.items()] or [],
                                   "run_id string, key string, value string") \
            .write.mode("append").parquet(self._p("run_params"))
        rows = [(run_id, k, 0, v) for k, v in finite_scalars(metrics).items()]
        for k, series in (steps or {}).items():
            rows += [(run_id, k, i, float(v)) for i, v in enumerate(series) if math.isfinite(float(v))]
        self.spark.createDataFrame(rows, "run_id string, key string, step int, value double") \
            .write.mode("append").parquet(self._p("run_metrics"))

    def search_runs(self, task: str | None = None, max_results: int = 50) -> DataFrame:
        """Newest first, limited; metric columns except ``leaderboard.*``; ``cv_metric`` is
        the name of the first non-null ``cv_*`` metric and ``cv_score`` its value."""
        runs = self._read("runs", "run_id string, task string, started_at timestamp, tags string")
        if task:
            runs = runs.where(F.col("task") == task)
        runs = runs.orderBy(F.desc("started_at")).limit(max_results)
        met = self._read("run_metrics", "run_id string, key string, step int, value double").where(
            ~F.col("key").startswith("leaderboard."))
        last = met.groupBy("run_id", "key").agg(F.max_by("value", "step").alias("value"))
        keys = [r["key"] for r in last.select("key").distinct().orderBy("key").collect()]  # metric names only
        wide = last.groupBy("run_id").pivot("key", keys).agg(F.first("value")) if keys else \
            last.select("run_id").distinct()
        out = runs.join(wide, "run_id", "left")
        cv = [k for k in keys if k.startswith("cv_")]
        if cv:
            out = out.withColumns({
                "cv_metric": F.coalesce(*[F.when(F.col(f"`{k}`").isNotNull(), F.lit(k)) for k in cv]),
                "cv_score": F.coalesce(*[F.col(f"`{k}`") for k in cv])})
        return out.orderBy(F.desc("started_at"))


def model_card_rows(metrics: DataFrame, leaderboard: DataFrame, importance: DataFrame | None,
                    gaps: DataFrame | None, before_after: DataFrame | None) -> DataFrame:
    """Model-card content as one long table (section, key, value)."""
    parts = [metrics.select(F.lit("metrics").alias("section"), F.col("metric").alias("key"),
                            F.col("value").cast("string").alias("value"))]
    parts.append(leaderboard.select(F.lit("leaderboard").alias("section"), F.col("model").alias("key"),
                                    F.to_json(F.struct(*[c for c in leaderboard.columns if c != "model"])).alias("value")))
    if importance is not None:
        top = importance.orderBy(F.desc(importance.columns[1])).limit(10)
        parts.append(top.select(F.lit("top_features").alias("section"), F.col(importance.columns[0]).alias("key"),
                                F.col(importance.columns[1]).cast("string").alias("value")))
    if gaps is not None:
        parts.append(gaps.select(F.lit("fairness_gaps").alias("section"), F.col("attribute").alias("key"),
                                 F.to_json(F.struct(*[c for c in gaps.columns if c != "attribute"])).alias("value")))
    if before_after is not None:
        parts.append(before_after.select(F.lit("mitigation").alias("section"),
                                         F.concat_ws("=", "attribute", "grp").alias("key"),
                                         F.to_json(F.struct(*[c for c in before_after.columns
                                                              if c not in ("attribute", "grp")])).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order_col))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")
