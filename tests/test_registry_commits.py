"""Published versions: concurrent saves, taken numbers, versions that were not finished."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from cohortlens.sources.registry import ModelRegistry



def model():
    return PipelineModel(stages=[SQLTransformer(statement="SELECT *, 1.0 AS prediction FROM __THIS__")])


def save(reg, version, task="t", **kw):
    return reg.save(task, model(), model_name="m", family="f", params={}, metrics={"a": 1.0}, version=version, **kw)


def test_concurrent_saves_of_one_stamp_are_both_listed(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path))
    with ThreadPoolExecutor(4) as ex:
        got = list(ex.map(lambda i: save(reg, "20250101-000000", cv_score=float(i)), range(4)))
    assert sorted(got) == ["20250101-000000", *[f"20250101-000000-{n}" for n in (2, 3, 4)]]
    assert [r.version for r in reg.versions("t").collect()] == sorted(got)
    assert sorted(r.number for r in reg.commits().collect()) == [1, 2, 3, 4]
    assert reg.latest_version("t") == max(reg.commits().collect(), key=lambda r: r.number).version
    scores = {r.version: r.cv_score for r in reg.models().collect()}
    assert sorted(scores.values()) == [0.0, 1.0, 2.0, 3.0]
    assert reg.load("t", got[2])[1]["cv_score"] == scores[got[2]] == 2.0


def test_a_taken_number_is_not_overwritten(spark, tmp_path, monkeypatch):
    reg = ModelRegistry(spark, str(tmp_path))
    first = save(reg, "20250101-000000")
    stale = reg.commits().limit(0)
    real, calls = ModelRegistry.commits, []

    def behind(self):  # the first look misses the commit of another process
        calls.append(1)
        return stale if len(calls) == 1 else real(self)

    monkeypatch.setattr(ModelRegistry, "commits", behind)
    second = save(reg, "20240101-000000")
    monkeypatch.setattr(ModelRegistry, "commits", real)
    assert {r.number: r.version for r in reg.commits().collect()} == {1: first, 2: second}
    assert reg.latest_version("t") == second  # the last published, not the largest stamp


def test_an_unfinished_version_is_not_seen(spark, tmp_path, monkeypatch):
    reg = ModelRegistry(spark, str(tmp_path))
    assert reg.models().count() == 0 and reg.latest_version("t") is None
    with pytest.raises(FileNotFoundError):
        reg.load("t")
    first = save(reg, "20250101-000000")
    monkeypatch.setattr(ModelRegistry, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        save(reg, "20250102-000000")
    monkeypatch.undo()
    assert [r.version for r in reg.versions("t").collect()] == [first] and reg.latest_version("t") == first
    other = save(reg, "20250102-000000")  # its folder belongs to the lost save
    assert other == "20250102-000000-2" and reg.latest_version("t") == other
    save(reg, "20250101-000000", task="u")
    assert {r.task: r.version for r in reg.latest_versions().collect()} == {"t": other, "u": "20250101-000000"}
