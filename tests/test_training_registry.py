import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import attribution as AT
from cohortlens.operators import features as X
from cohortlens.operators import scoring as S
from cohortlens.operators.split import fixed_sample
from cohortlens.operators.training import KEY, TrainConfig, train_task
from cohortlens.sources import derived as D
from cohortlens.sources.registry import ModelRegistry, finite_scalars, fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    eng = X.engineer(D.students(spark, SF)).persist()
    cfg = TrainConfig(cv_folds=3, cv_repeats=1, n_trials=1, parallelism=4,
                      candidates=("baseline", "logistic_regression"))
    return eng, train_task(X.TASKS["at_risk"], eng, cfg)


def test_train_task_binary(spark, trained):
    eng, res = trained
    assert res.best_candidate == "logistic_regression"
    assert res.leaderboard.count() == 2
    assert 0.0 < res.threshold <= 1.0
    cal = {r.grp: r for r in res.group_thresholds.collect()}
    assert set(cal) == {"free/reduced", "standard"}
    for r in cal.values():
        assert r.recall >= 0.8


def test_scoring_records_and_unknown_category(spark, trained):
    eng, res = trained
    task = X.TASKS["at_risk"]
    rows = eng.select(KEY, *task.inputs).limit(5).withColumn(
        "gender", F.when(F.col(KEY) % 2 == 0, F.lit("other")).otherwise(F.col("gender")))
    out = S.score(rows, res.model, task, threshold=res.threshold, group_thresholds=res.group_thresholds,
                  attribute="lunch", version="v1").collect()
    assert len(out) == 5
    for r in out:
        assert 0.0 <= r.probability <= 1.0 and r.risk_band in {"low", "moderate", "high", "critical"}
        assert r.mitigated.attribute == "lunch" and r.model_version == "v1"


def test_request_frame_checks(spark):
    df = spark.createDataFrame([(" female ", None)], "gender string, math_score double")
    with pytest.raises(ValueError, match="Missing required fields"):
        S.request_frame(df, ["gender", "lunch"], validate=False)
    assert S.request_frame(df, ["gender"], validate=False).columns == ["gender"]


def test_linear_equals_coalition_shapley(spark, trained):
    eng, res = trained
    task = X.TASKS["at_risk"]
    rows = eng.select(KEY, *task.inputs).limit(3)
    bg = fixed_sample(eng, KEY, 10, 0)
    sv = {(r[KEY], r.feature): r.shap_value for r in AT.shapley_values(res.model, task, rows, bg, KEY).collect()}
    assert len(sv) == 15
    # efficiency: Shapley values sum to f(x) - E_bg f
    from pyspark.ml.functions import vector_to_array
    out = res.model.transform(rows).select(KEY, vector_to_array("probability")[1].alias("p")).collect()
    base = res.model.transform(bg.select(*task.inputs)).select(
        F.avg(vector_to_array("probability")[1])).first()[0]
    for r in out:
        assert sum(v for (k, _), v in sv.items() if k == r[KEY]) == pytest.approx(r.p - base, abs=1e-9)


def test_registry_round_trip(spark, trained):
    eng, res = trained
    reg = ModelRegistry(spark, tempfile.mkdtemp(prefix="registry-"))
    fp = fingerprint(eng).first().fingerprint
    v = reg.save("at_risk", res.model, model_name=res.best_candidate, family="linear", params=res.best_params,
                 metrics={"roc_auc": 0.7, "bad": float("nan")}, leaderboard=res.leaderboard, tuning=res.tuning,
                 threshold=res.threshold, cv_score=res.cv_score, fingerprint_value=fp, version="20260101-000000")
    assert reg.latest_version("at_risk") == v
    model, meta = reg.load("at_risk")
    assert meta["threshold"] == res.threshold
    assert model.transform(eng.limit(3)).count() == 3
    assert reg.leaderboard("at_risk").count() == 2
    with pytest.raises(FileNotFoundError):
        reg.load("math_score")
    reg.log_run("r1", "at_risk", {"C": 1.0}, {"cv_roc_auc": 0.7, "leaderboard.x": 1.0, "nan": float("nan")})
    runs = reg.search_runs("at_risk").collect()
    assert runs[0].cv_metric == "cv_roc_auc" and runs[0].cv_score == 0.7
    assert finite_scalars({"a": 1, "b": 2.5, "c": float("nan"), "d": "x", "e": True, "f": [1],
                           "g": float("inf")}) == {"a": 1.0, "b": 2.5}


def test_knn_matches_brute_force(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from cohortlens.operators.modeling import KNNEstimator
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(60, 2))
    ys = (pts[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(p), float(y)) for p, y in zip(pts, ys)], ["features", "label"])
    m = KNNEstimator(k=5, kind="binary").fit(df)
    got = m.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()
    for i, r in enumerate(got):
        d = ((pts - pts[i]) ** 2).sum(1)
        assert r.p == pytest.approx(ys[np.argsort(d, kind="stable")[:5]].mean())


def test_knn_duplicated_points_pro_rata_and_regression(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from cohortlens.operators.modeling import KNNEstimator
    rng = np.random.default_rng(1)
    uniq = rng.normal(size=(25, 3))
    reps = rng.integers(1, 4, size=25)
    pts = np.repeat(uniq, reps, axis=0)  # duplicated training points
    ys = rng.integers(0, 2, size=len(pts)).astype(float)
    df = spark.createDataFrame([(Vectors.dense(p), float(y)) for p, y in zip(pts, ys)], ["features", "label"])
    queries = spark.createDataFrame([(i, Vectors.dense(u)) for i, u in enumerate(uniq)], ["qid", "features"])

    def brute(q, k):
        # whole prototypes in distance order, the last one within reach pro rata
        d = ((uniq - q) ** 2).sum(1)
        taken, tot_y = 0.0, 0.0
        for j in np.argsort(d, kind="stable"):
            rows = ys[np.all(pts == uniq[j], axis=1)]
            t = min(len(rows), k - taken)
            if t <= 0:
                break
            tot_y += t * rows.mean()
            taken += t
        return tot_y / taken

    k = 7
    prob = {r.qid: r.p for r in KNNEstimator(k=k, kind="binary").fit(df).transform(queries)
            .select("qid", vector_to_array("probability")[1].alias("p")).collect()}
    pred = {r.qid: r.prediction for r in KNNEstimator(k=k, kind="regression").fit(df).transform(queries)
            .select("qid", "prediction").collect()}
    for i, q in enumerate(uniq):
        assert prob[i] == pytest.approx(brute(q, k))
        assert pred[i] == pytest.approx(brute(q, k))


def test_audit_drift_and_profile_sink(spark, trained):
    from pyspark.ml.functions import vector_to_array
    from cohortlens.operators import fairness as G
    from cohortlens.operators import profiling as A
    eng, res = trained
    task = X.TASKS["at_risk"]
    scored = res.model.transform(eng).withColumn("p1", vector_to_array("probability")[1])
    a = G.audit(scored, "at_risk", "binary", ["gender", "lunch"], score="p1", threshold=res.threshold,
                group_thresholds=res.group_thresholds, mitigation_attribute="lunch")
    assert a["groups"].count() == 4 and a["mitigated"]["before_after"].count() == 4
    assert a["mitigated"]["overall_after"].first().recall >= 0.0
    cur = eng.where("lunch = 'free/reduced'").select(*task.inputs)
    rep = S.drift_for_task(res.model, task, eng, cur)
    assert rep["header"].first().status == "alert" and rep["scores"].count() == 1
    path = tempfile.mkdtemp(prefix="profile-")
    A.write_profile(A.profile(eng), path)
    assert spark.read.parquet(f"{path}/describe").count() == 3
    assert spark.read.text(f"{path}/profile_json").first().value.startswith("{")


def test_failing_candidate_is_a_row_of_the_board(spark, monkeypatch):
    from cohortlens.operators import training as TR
    eng = X.engineer(D.students(spark, SF)).limit(400)
    task = X.TASKS["at_risk"]
    real = TR.cross_validate

    def failing(t, folds, cand, *rest):
        if cand.name == "baseline":
            raise ValueError("no fit")
        return real(t, folds, cand, *rest)

    monkeypatch.setattr(TR, "cross_validate", failing)
    cfg = TR.TrainConfig(cv_folds=2, cv_repeats=1, n_trials=0, candidates=("baseline", "logistic_regression"))
    board, primary = TR.leaderboard(task, TR.prepare(task, eng), cfg)
    rows = {r.model: r for r in board.collect()}
    assert rows["baseline"].state == "FAIL" and "no fit" in rows["baseline"].error
    assert rows["logistic_regression"].state == "COMPLETE" and set(primary) == {"logistic_regression"}


def test_multiclass_attribution(spark):
    from pyspark.ml.functions import vector_to_array
    from cohortlens.operators.modeling import candidates, make_pipeline
    from cohortlens.operators.training import prepare
    eng = X.engineer(D.students(spark, SF)).limit(600).persist()
    task = X.TASKS["performance_level"]
    data = prepare(task, eng)
    zoo = {c.name: c for c in candidates("multiclass", 3)}
    ctx = {"n": 600.0, "y_std": 1.0, "seed": 1}
    model = make_pipeline(data, list(task.inputs), zoo["logistic_regression"], {}, ctx).fit(data)
    rows, bg = eng.select(KEY, *task.inputs).orderBy(KEY).limit(4), fixed_sample(eng, KEY, 5, 0)
    sv = AT.shapley_values(model, task, rows, bg, KEY).collect()
    out = model.transform(rows).select(KEY, vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("c")).collect()
    base = model.transform(bg.select(*task.inputs)).select(*[F.avg(vector_to_array("probability")[i]) for i in range(3)]).first()
    for r in out:  # efficiency, for the class predicted for the row itself
        assert sum(v.shap_value for v in sv if v[KEY] == r[KEY]) == pytest.approx(r.p[r.c] - base[r.c], abs=1e-9)
    bundle = AT.explain_bundle(model, task, rows, bg, KEY)
    assert bundle["kind"] == "linear"
    stage = model.stages[-1].coefficientMatrix.toArray()
    x = model.transform(rows).select(vector_to_array("features").alias("x")).collect()
    m = model.transform(bg).select(vector_to_array("features").alias("x")).collect()
    mu = [sum(r.x[i] for r in m) / len(m) for i in range(len(m[0].x))]
    want = sum(abs(stage[c][i] * (r.x[i] - mu[i])) for r in x for i in range(len(mu)) for c in range(3)) / (3 * len(x))
    assert sum(r.importance for r in bundle["global"].collect()) == pytest.approx(want, rel=1e-9)


def test_rbf_model_is_not_explained_as_linear(spark):
    from cohortlens.operators.modeling import candidates, make_pipeline
    from cohortlens.operators.training import prepare
    eng = X.engineer(D.students(spark, SF)).limit(300).persist()
    task = X.TASKS["at_risk"]
    data = prepare(task, eng)
    cand = {c.name: c for c in candidates("binary")}["svm_rbf"]
    model = make_pipeline(data, list(task.inputs), cand, {}, {"n": 300.0, "y_std": 1.0, "seed": 1}).fit(data)
    bundle = AT.explain_bundle(model, task, eng.select(KEY, *task.inputs).limit(3), fixed_sample(eng, KEY, 4, 0), KEY)
    assert bundle["kind"] == "coalition"
    assert bundle["contributions"].where("source is null or contribution is null").count() == 0
