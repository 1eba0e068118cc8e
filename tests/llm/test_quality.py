"""Quality rules: counts against plain Python, the oracle SQL, thresholds that follow the group."""

import random
import re
from collections import Counter

import duckdb
import pytest

from cohortlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))


def corpus():
    rng = random.Random(8)
    vocab = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60, 120))]
        if i % 10 == 7:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w[:40]) + "\n" + " ".join(w[40:]), rng.choice(["en", "de"]), f"s{i % 3}"))
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, "a b c\na b c\n \na\x0bb c", "en", None), (103, "a a a a", None, "s1"), (104, "été | x y z" * 30, "en", "s0"),
             (105, " ".join(rng.choice(vocab) for _ in range(30_000)), "en", "s0"), (106, "x y", "en", "s0"), (106, "x y", "en", "s0"), (107, "same line of text here\n" * 40, "de", "s1")]
    return rows


@pytest.mark.parametrize("least", [200, 5])
def test_counts_and_verdicts(spark, least, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in quality.judge(df.selectExpr("*", "1 as n", "2 as bucket"), min_rows=least).collect())
    assert [r[:6] for r in got] == sorted((i, *counts(t)) for i, t, _, _ in rows)
    for r in got:
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1]) and not (r[6] and r[7])
    kept = {r[0]: r[7] for r in got}
    assert all(kept[i] == (i % 10 != 7) for i in range(60)) and kept[105]
    monkeypatch.setattr(quality, "MIN_ROWS", least)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    # an empty column of objects has no type in pandas; the oracle reads Parquet in the driver
    oracle = sorted(con.sql(quality._oracle()).fetchall(), key=str)
    assert oracle == sorted(got, key=str)


def test_native_plan_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    out = quality.judge(df)
    assert out.count() == 0
    plan = quality.text_counts(df, "doc_id", "text", "lang", "source")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sketch_bucket_error_and_merge(spark):
    got = spark.range(0, 200_000, 7).withColumnRenamed("id", "v").withColumn("b", quality._bucket("v")).filter("b > v or (v - b) * 128 > v").count()
    assert got == 0
