"""Inputs derived from the driver's TPC-H-style tables.

The engine's operators take column names, so any table works. These views
give the student-outcome operators realistic inputs whose size grows with
the scale factor:

* ``students``: one row per order (unique ``student_id``),
* ``students_dirty``: the same with injected cleaning problems,
* ``scored``: per line item, a binary / regression / multiclass scored table,
* ``split_by_time``: reference vs current halves for drift,
* ``audit_docs``: documents joined to their labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.domain import ETHNICITIES, PARENTAL_EDUCATION
from cohortlens.operators.joins import join_dimension
from cohortlens.sources.tables import read_table


def _pick(values: tuple[str, ...], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region → the eight raw student columns."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions
    geo = join_dimension(
        read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"),
        read_table(spark, sf_dir, "region").select("r_regionkey"),
        F.col("n_regionkey") == F.col("r_regionkey"),
        max_rows=1000,
    )
    cust = join_dimension(c, geo, F.col("c_nationkey") == F.col("n_nationkey"), max_rows=100_000)
    # orders ⋈ customer is a large-large equi join: let the planner pick
    # (sort-merge / AQE broadcast when customer turns out small).
    j = o.join(cust, o["o_custkey"] == cust["c_custkey"])
    key = F.col("o_orderkey")
    free = F.col("o_orderstatus") == "F"
    completed = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    base = (F.lit(40) + (key * 7919) % 41 + F.when(free, 0).otherwise(6)
            + F.when(completed, 5).otherwise(0))
    return j.select(
        key.alias("student_id"),
        F.when(key % 2 == 0, "female").otherwise("male").alias("gender"),
        _pick(ETHNICITIES, F.col("r_regionkey")).alias("race_ethnicity"),
        _pick(PARENTAL_EDUCATION, F.col("o_custkey") % 6).alias("parental_level_of_education"),
        F.when(free, "free/reduced").otherwise("standard").alias("lunch"),
        F.when(completed, "completed").otherwise("none").alias("test_preparation_course"),
        F.least(F.lit(100), base + (key * 31) % 17).cast("double").alias("math_score"),
        F.least(F.lit(100), base + (key * 57) % 13).cast("double").alias("reading_score"),
        F.least(F.lit(100), base + (key * 73) % 11).cast("double").alias("writing_score"),
    )


def students_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Students with messy case/blanks, unknown categories, out-of-range scores and duplicates."""
    s = students(spark, sf_dir)
    k = F.col("student_id")
    dirty = s.withColumns({
        "gender": F.when(k % 101 == 0, F.lit("unknown"))
                   .when(k % 7 == 0, F.concat(F.upper("gender"), F.lit("  ")))
                   .otherwise(F.col("gender")),
        "math_score": F.when(k % 103 == 0, F.lit(140.0)).otherwise(F.col("math_score")),
    })
    return dirty.unionByName(dirty.where(k % 50 == 0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line item: binary label + probability, regression and 3-class scores."""
    li = read_table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return li.select(
        y.alias("y"),
        ((F.col("l_extendedprice") / F.lit(105000.0)) * F.lit(0.7)
         + F.when(y == 1, F.lit(0.2)).otherwise(F.lit(0.0))).alias("proba"),
        (F.col("l_quantity") / F.lit(50.0)).alias("proba_tied"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_linenumber").cast("string").alias("line_no"),
        F.col("l_extendedprice").alias("y_reg"),
        (F.col("l_quantity") * F.lit(2100.0)).alias("pred_reg"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
         .otherwise(2).alias("y_cls"),
        (F.col("l_linenumber") % 3).alias("pred_cls"),
        *_class_probs(),
        F.col("l_shipdate"),
    )


def _class_probs():
    """Three class probabilities (A / N / R) from discount, tax and quantity."""
    a = F.col("l_discount") + F.lit(0.01)
    n = F.col("l_tax") + F.lit(0.01)
    r = F.col("l_quantity") / F.lit(500.0)
    tot = (a + n) + r
    return [(a / tot).alias("prob_a"), (n / tot).alias("prob_n"), (r / tot).alias("prob_r")]


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def lineitem_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    cut = F.lit("1998-07-01 00:00:00").cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


def audit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels: y = quality, score from n_chars, attributes lang / source."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    return j.select(
        "doc_id", "lang", "source",
        F.col("quality").alias("y"),
        F.col("toxic"),
        (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("n_chars").cast("double") / F.lit(5000.0))).alias("proba"),
    )
