"""Suffix-array dedup against a set of all earlier windows."""

import hashlib
import random

import pytest

from cohortlens.llm import suffix_dedup


def brute(rows, length=100):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p: p + length], (i, p)) != (i, p):
                gone[p: p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé fgh\n") for _ in range(n))
    line, passage = text(70), text(260)
    rows = [(i, text(rng.randrange(300))) for i in range(20)]
    rows += [(30 + i, text(80) + passage[rng.randrange(60): 200 + rng.randrange(60)] + text(40)) for i in range(25)]
    rows += [(60 + i, text(90) + line + text(90)) for i in range(20)]
    rows += [(90 + i, rows[3 + i][1]) for i in range(4)]
    rows += [(100, "ab" * 400), (101, "x" * 5000), (102, "x" * 99), (103, "x" * 100), (104, ""), (105, None), (106, (text(50) + "!") * 6), (107, "\0" * 150)]
    rows += [(110, text(40_000)), (111, passage + passage)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [4096, 2])
def test_digest_matches_brute_force(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == brute(corpus)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t)], "doc_id long, text string")
    got = sorted((r[0] or 0, r[2]) for r in suffix_dedup.suffix_dedup(df).collect())
    n = len(t.encode())
    assert got == [(0, 0), (5, 0), (5, 0), (7, n)]
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
