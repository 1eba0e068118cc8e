import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean as C
from cohortlens.operators.validate import SchemaError, assert_valid, violations

RAW_HEADERS = ["gender", "race/ethnicity", "parental level of education", "lunch", "test preparation course",
               "math score", "reading score", "writing score"]
ROW = ("female", "group B", "bachelor's degree", "standard", "none", 72.0, 72.0, 74.0)


def test_normalise_columns(spark):
    df = spark.createDataFrame([ROW], RAW_HEADERS)
    assert C.normalise_columns(df).columns == [
        "gender", "race_ethnicity", "parental_level_of_education", "lunch", "test_preparation_course",
        "math_score", "reading_score", "writing_score"]
    df2 = spark.createDataFrame([(1,)], ["  Some Weird--Name! "])
    assert C.normalise_columns(df2).columns == ["some_weird_name"]


def _students(spark, rows):
    return C.normalise_columns(spark.createDataFrame(rows, RAW_HEADERS))


def test_clean_trims_lowers_and_drops_duplicates(spark):
    rows = [ROW] * 3 + [("  MALE  ", "GROUP c", "High School ", "Standard", "None", 50.0, 60.0, 70.0)]
    out = C.clean(_students(spark, rows)).collect()
    assert len(out) == 2
    male = [r for r in out if r.gender == "male"][0]
    assert male.race_ethnicity == "group C" and male.parental_level_of_education == "high school"
    rep = C.duplicate_report(_students(spark, rows)).first()
    assert (rep.n_before, rep.n_after, rep.n_dropped) == (4, 2, 2)


def test_validate_collects_all_problems(spark):
    rows = [ROW, ("robot", "group B", "bachelor's degree", "standard", "none", 140.0, 72.0, 74.0)]
    df = _students(spark, rows).drop("lunch")
    with pytest.raises(SchemaError) as err:
        assert_valid(df)
    msg = str(err.value)
    assert "missing column 'lunch'" in msg and "robot" in msg and "values > 100" in msg


def test_validate_scores_optional(spark):
    df = _students(spark, [ROW]).drop("math_score", "reading_score", "writing_score")
    with pytest.raises(SchemaError):
        assert_valid(df)
    assert assert_valid(df, require_scores=False) is df


def test_violation_table_counts(spark):
    rows = [ROW, ("x", "group B", "bachelor's degree", "standard", "none", -1.0, None, 74.0),
            ("x", "group B", "bachelor's degree", "standard", "none", 5.0, 5.0, 5.0)]
    v = {(r.column_name, r.problem, r.detail): r.n for r in violations(_students(spark, rows)).collect()}
    assert v[("gender", "unknown_category", "x")] == 2
    assert v[("math_score", "below_min", "0")] == 1
    assert v[("reading_score", "missing_values", None)] == 1


def test_non_numeric_score_column(spark):
    df = _students(spark, [ROW]).withColumn("math_score", F.lit("abc"))
    v = {(r.column_name, r.problem) for r in violations(df).collect()}
    assert ("math_score", "not_numeric") in v
