"""Intermediate tables in the folder that the cluster shares, and small distributed helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cohortlens.session import ensure_checkpoint_dir


#: bytes of an Arrow batch at most: with Spark's own bound (64 MB) a worker and its JVM hold tens of MB of texts at once,
#: and keep much of it for the stages that follow
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a session (what ``--py-files`` does on submit), and bound the
    session's Arrow batches by ``BATCH_BYTES``."""
    sc = spark.sparkContext
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default; a caller's own setting stays
        spark.conf.set(name, str(BATCH_BYTES))
    if getattr(sc, "_cohortlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="cohortlens-py-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._cohortlens_shipped = True


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``; ``drop`` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: later steps start here, also after a lost executor."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        (df.coalesce(parts) if parts else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark delete the shuffle files of ended jobs: it does when the driver's JVM collects garbage, which a driver with little
        to do seldom does."""
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so extra columns can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in cols.items()])


def beside(rows: DataFrame, column: str, more: str) -> StructType:
    """The schema of ``column`` of ``rows``, whatever names its type holds, followed by the columns in ``more`` (DDL)."""
    return StructType([StructField(column, rows.schema[column].dataType), *StructType.fromDDL(more).fields])


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(node, comp) of each node in ``edges(a, b)``: comp is the smallest node it is connected with.

    Minimum labels pass along the edges and then jump to their own label's label, so stars
    and chains settle in few rounds. Each round is two joins and a map-side combined minimum;
    rounds are written as tables. Only the count of changed labels reaches the driver.
    """
    both = tmp.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tmp.put(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        told = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen")))
        near = labels.join(told, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = tmp.put(near.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")))
        changed = new.filter("old <> comp").limit(1).count()
        tmp.drop(labels)
        labels = new
        if not changed:
            tmp.drop(both)
            return labels.select("node", "comp")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
