"""Sharding: differencing on known cases, laws of the result, several levels."""

import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import shards


def test_difference_is_the_method():
    # the textbook case: 8 7 6 5 4 in two parts leaves a difference of 2
    parts = [np.array([x, 0]) for x in (8, 7, 6, 5, 4)]
    sums, place = shards.difference(parts)
    assert sums.tolist() == [16, 14]
    load = [0, 0]
    for p, at in zip((8, 7, 6, 5, 4), place):
        load[at[0]] += p
    assert load == sums.tolist()
    rng = random.Random(4)
    parts = [np.sort(np.array([rng.randrange(1000) for _ in range(6)]))[::-1] for _ in range(50)]
    sums, place = shards.difference(parts)
    load = np.zeros(6, int)
    for p, at in zip(parts, place):
        assert sorted(at.tolist()) == list(range(6))
        load[at] += p
    assert load.tolist() == sums.tolist() and sums[0] - sums[-1] <= 30


@pytest.mark.parametrize(("bucket", "fan_in"), [(20_000, 256), (15, 3)])
def test_laws(spark, bucket, fan_in, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET", bucket)
    monkeypatch.setattr(shards, "FAN_IN", fan_in)
    rng = random.Random(9)
    rows = [(i, "é" * rng.randrange(200)) for i in range(400)] + [(1000 + i, "the same text") for i in range(120)]
    rows += [(2000, None), (2001, None), (2002, ""), (5, rows[5][1]), (3000, "x" * 30_000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "'k' as key")
    out = shards.shard(df, shards=7).collect()
    assert sorted((r.doc_id or -1) for r in out) == sorted((i or -1) if i is not None else -1 for i, _ in rows)
    text = {}
    for i, t in rows:
        text[i] = t
    load, where = {}, {}
    for r in out:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load.setdefault(r.shard, []).append(r)
        assert where.setdefault(text[r.doc_id], r.shard) == r.shard
    assert set(load) <= set(range(7))
    for s in load.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    sums = sorted(sum(r.size for r in s) for s in load.values())
    assert sums[-1] == 30_016  # the group that exceeds the mean has its shard for itself
    assert sums[-2] - sums[0] <= (60 if bucket > 100 else 2000)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shards.shard(df).count() == 0
