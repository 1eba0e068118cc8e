import math

from pyspark.sql import functions as F

from cohortlens.operators import features as X

COLS = ["gender", "race_ethnicity", "parental_level_of_education", "lunch", "test_preparation_course",
        "math_score", "reading_score", "writing_score"]


def test_engineer_row(spark):
    df = spark.createDataFrame([("female", "group B", "bachelor's degree", "standard", "none", 72.0, 72.0, 74.0),
                                ("male", "group A", "phd", "standard", "none", 39.0, 80.0, 60.0)], COLS)
    r = {x.gender: x for x in X.engineer(df).collect()}
    f = r["female"]
    assert f.total_score == 218 and f.average_score == 72.67 and f.score_std == 1.15
    assert (f.min_score, f.max_score, f.score_range) == (72, 74, 2)
    assert (f.pass_math, f.n_passed, f.all_passed) == (1, 3, 1)
    assert f.performance_level == "medium" and f.at_risk == 0 and f.parental_education_rank == 4
    m = r["male"]
    assert m.pass_math == 0 and m.n_passed == 2 and m.all_passed == 0
    assert m.average_score == 59.67 and m.at_risk == 1 and m.performance_level == "low"
    assert m.parental_education_rank is None


def test_engineer_rounds_before_cutoffs_and_skips_nulls(spark):
    # mean 59.996... rounds to 60.0 → medium, not at risk
    df = spark.createDataFrame([("female", "group B", "high school", "standard", "none", 59.99, 60.0, 60.0),
                                ("female", "group B", "high school", "standard", "none", 80.0, None, None)], COLS)
    rows = X.engineer(df).orderBy("math_score").collect()
    assert rows[0].average_score == 60.0 and rows[0].performance_level == "medium" and rows[0].at_risk == 0
    assert rows[1].total_score == 80 and rows[1].average_score == 80 and rows[1].score_std is None
    assert rows[1].pass_reading == 0 and rows[1].performance_level == "high"


def test_half_even_rounding(spark):
    from cohortlens.functions.expr import round_half_even
    vals = [0.125, 0.135, 2.675, 1.005, 72.665]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(round_half_even("x", 2)).collect()]
    import numpy as np
    assert got == [float(np.round(v, 2)) for v in vals]


def test_build_xy_multiclass_codes(spark):
    df = spark.createDataFrame([("low",), ("high",), ("weird",)], "performance_level string")
    df = df.select(*[F.lit("x").alias(c) for c in X.CATEGORICAL_COLUMNS],
                   *[F.lit(1.0).alias(c) for c in ("math_score", "reading_score", "writing_score")],
                   "performance_level")
    codes = [r.label for r in X.build_xy(X.TASKS["performance_level"], df).collect()]
    assert codes == [0.0, 2.0, -1.0]
    assert not math.isnan(codes[0])
