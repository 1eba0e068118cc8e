"""Table scans and sinks.

Scans are plain ``spark.read`` calls: Catalyst prunes columns and pushes
filters into the Parquet reader, so callers should ``select`` early and let
the optimizer do the rest.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.functions.domain import CATEGORICAL_COLUMNS, SCORE_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Raw student table as shipped (headers already normalised).
STUDENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in SCORE_COLUMNS]
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with a helpful error when the file is missing.

    Headers are kept as written; use ``clean.normalise_columns`` afterwards.
    With ``schema`` given, no inference pass is made over the data.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    try:
        return reader.csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(
                f"Dataset not found at {path}. Put the raw student table (CSV with a header row) there."
            ) from exc
        raise


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Snapshot / export sink (S4, S5). CSV exports keep a header row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its file system (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
