import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import end_to_end as EE
from cohortlens.operators import features as X
from cohortlens.operators.training import KEY, TrainConfig
from cohortlens.operators.validate import SchemaError
from cohortlens.sources import derived as D
from cohortlens.sources.registry import ModelRegistry

SF = "/root/testdata/sf0.001"


def test_load_clean_and_engineered(spark):
    raw = D.students(spark, SF).limit(50).withColumnsRenamed({"race_ethnicity": " Race/Ethnicity ", "math_score": "Math Score"})
    raw = raw.withColumn("lunch", F.upper("lunch")).unionByName(raw.withColumn("lunch", F.upper("lunch")))
    eng = EE.load_engineered(raw)
    assert eng.count() == 50 and {"race_ethnicity", "math_score", "at_risk"} <= set(eng.columns)
    with pytest.raises(SchemaError, match="unknown categories"):
        EE.load_clean(raw.withColumn("lunch", F.lit("picnic")))


def test_train_save_load_score(spark):
    eng = X.engineer(D.students(spark, SF)).limit(500).persist()
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="registry-"))
    cfg = TrainConfig(cv_folds=2, cv_repeats=1, n_trials=0, candidates=("baseline", "logistic_regression", "ridge"))
    task = X.TASKS["at_risk"]
    out = EE.run_pipeline(spark, eng, task, reg, cfg, version="20260101-000000")
    assert out.trained.best_candidate == "logistic_regression" and 0 <= out.holdout["roc_auc"] <= 1 and out.holdout["n_test"] == 100
    rows = eng.select(KEY, *task.inputs).limit(40)
    from cohortlens.operators.scoring import score
    fresh = score(rows, out.trained.model, task, threshold=out.trained.threshold, group_thresholds=out.trained.group_thresholds,
                  attribute="lunch", version=out.version)
    stored = EE.score_registered(reg, task, rows)
    cols = [KEY, "probability", "at_risk", "mitigated", "risk_band"]
    assert sorted(map(str, fresh.select(*cols).collect())) == sorted(map(str, stored.select(*cols).collect()))
    assert reg.fairness("at_risk").count() > 0 and reg.importance("at_risk").count() == len(task.inputs)
    _, meta = reg.load("at_risk")
    assert meta["details"]["features"] == list(task.inputs) and meta["details"]["n_train"] == 400
    math = X.TASKS["math_score"]
    o = EE.run_pipeline(spark, eng, math, reg, cfg, version="20260101-000001")
    r = EE.score_registered(reg, math, eng.select(KEY, *math.inputs).limit(5)).collect()
    assert all(x.lower <= x.prediction <= x.upper and x.upper - x.lower <= 2 * o.trained.conformal_q + 1e-9 for x in r)
    assert any(k.startswith("interval_") for k in o.holdout)
    assert {x.task for x in reg.latest_versions().collect()} == {"at_risk", "math_score"}
