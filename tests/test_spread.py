"""Model queries work on all cores, however few partitions their tables have."""

import pytest

from cohortlens.operators import features as X
from cohortlens.plans import catalog_ml as C
from cohortlens.sources import derived as D


def test_rows_of_one_row_group_are_dealt_over_all_cores(spark, monkeypatch):
    rows = [(i, "female", "group A", "high school", "standard", "none", 50.0 + i % 50, 60.0, 70.0) for i in range(600)]
    cols = ["student_id", "gender", "race_ethnicity", "parental_level_of_education", "lunch", "test_preparation_course", "math_score", "reading_score", "writing_score"]
    one = spark.createDataFrame(rows, cols).coalesce(1)
    monkeypatch.setattr(D, "students", lambda *_: one)
    monkeypatch.setattr(C, "SPREAD_ROWS", 20)
    seen = []
    real = C.make_pipeline
    monkeypatch.setattr(C, "make_pipeline", lambda data, *a: seen.append(data) or real(data, *a))
    model = C._fitted(spark, "", "at_risk", "baseline")
    sizes = seen[0].rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 600 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 300
    assert model.transform(C._spread(spark, "").select("student_id", *X.TASKS["at_risk"].inputs)).count() == 600
