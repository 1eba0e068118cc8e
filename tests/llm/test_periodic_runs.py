"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import re
import time
import zlib

from cohortlens.llm import periodic_runs

EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                part = words[i: j + q]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (n, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def texts(rng, n):
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 8)):
            few = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            w += few * rng.randrange(1, 9) + few[: rng.randrange(len(few) + 1)]
            if rng.random() < 0.4:
                w.append(f"w{rng.randrange(5)}")
        out.append(rng.choice([" ", "\n", "\t  "]).join(w))
    return out


def check(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, `text.x y` string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(i, *expected(i, t)) for i, t, _ in rows], key=str)


def test_random_repeats_and_edge_cases(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t, None) for i, t in enumerate(texts(rng, 500))]
    some = ["", None, " \n ", "a", "a " * 6, "a " * 5, "x y z " * 4, "é ü " * 9, "a b " * 7, "A a " * 4]
    rows += [(1000 + i, t, "z") for i, t in enumerate(some)] + [(None, "b " * 9, None), (7, rows[7][1], None), (None, None, None)]
    check(spark, rows, tmp_path)


def test_repeats_over_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 6000")
    got = {r[0]: tuple(r[1:]) for r in periodic_runs.query(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_every_run_needs_its_dictionary_level(monkeypatch):
    """Without next occurrences nothing is proposed: the dictionary is what finds the runs."""
    import numpy as np
    words = np.array([1, 2, 3] * 6, np.int64)
    doc = np.zeros(len(words), np.int64)
    assert periodic_runs.stretches(words, doc) == [(0, 18, 3)]
    monkeypatch.setattr(periodic_runs, "successors", lambda name, *rest: np.zeros(len(name), np.int64))
    assert periodic_runs.stretches(words, doc) == []


def test_empty_table(spark, tmp_path):
    check(spark, [], tmp_path)


def test_very_long_text():
    import numpy as np
    rng = np.random.default_rng(1)
    words = np.concatenate([rng.integers(0, 10**6, 300_000), np.tile(rng.integers(0, 10**6, 1000), 300), np.zeros(300_000, np.int64)])
    t = time.time()
    found = periodic_runs.stretches(words, np.zeros(len(words), np.int64))
    assert (300_000, 300_000, 1000) in found and (600_000, 300_000, 1) in [(a + (n - 300_000), 300_000, q) for a, n, q in found if q == 1]
    assert time.time() - t < 60
    assert hashlib.sha256(b"").hexdigest() == EMPTY
