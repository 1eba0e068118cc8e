"""Near words, forms and roots against brute force over all pairs of words, and the query against its SQL."""

import random
import re
import time
import zlib
from collections import Counter

import pytest

from cohortlens.llm import spelling
from cohortlens.llm.tables import Scratch


def one_apart(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


def brute(words, times=10):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def got(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, spelling.variants(df).collect()))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(4)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abcà") for _ in range(rng.randrange(7, 13)))
        words[base] = rng.choice([3, 50, 5000, 10**6])
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(w))
                what = rng.randrange(3)
                if what == 0:
                    w[at] = rng.choice("abcàz")
                elif what == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, rng.choice("abcàz"))
            words.setdefault("".join(w), rng.choice([2, 3, 30, 300, 3000]))
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaabaaaa": 2000, "zzzzzzzz": 5, "é" * 9: 2, "é" * 10: 1}
    return words


def test_all_near_words(spark, vocabulary):
    assert got(spark, vocabulary) == brute(vocabulary)


def test_whole_alphabet_at_one_place(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    words = {f"prefix{c}suffix": 2 + i for i, c in enumerate(letters)} | {"prefixsuffix": 10**5, "prefixxsuffixx": 7}
    assert got(spark, words) == brute(words)


def test_numbers_are_those_of_one_trie(spark, vocabulary):
    """Equal prefixes have equal numbers and others do not, over any number of partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 7, 300):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = spark.createDataFrame([(w, n) for w, n in vocabulary.items()], "word string, n long")
            number, places = {}, []
            for r in spelling.numbered(df, "word", Scratch(spark)).collect():
                places.append((r["place"], r["word"]))
                assert len(r["path"]) == len(r["word"]) + 1
                for i, x in enumerate(r["path"]):
                    assert number.setdefault(r["word"][:i], x) == x
            assert len(set(number.values())) == len(number)
            assert [w for _, w in sorted(places)] == sorted(vocabulary)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_counted_words(spark):
    rng = random.Random(6)
    vocab = ["Wörterbuch", "ABCDEFG", "abcdefgh", "tiny", "Straße", "straßenbahn", "ÉCLAIRAGE", "naïveté×÷", "x" * 40]
    rows = [(i, rng.choice([" ", "-", "\n", "9"]).join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(None, "abcdefgh " * 50), (5, None), (6, ""), (7, rows[7][1]), (-4, "Ābcdefgh ABCDEFGHĀ")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            want[run] += 1
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, `run h` string")
    assert {r["word"]: r["n"] for r in spelling.counted(docs).collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_query_against_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(f"select word, form, root, n, n_near, form_n from ({spelling.ORACLE})").fetchall()
    assert sorted(map(tuple, spelling.query(spark, "/root/testdata/sf0.001").collect()), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want)


def test_pairs_come_from_the_trie_numbers(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(spelling, "_common", lambda x, y: 0)
    assert got(spark, vocabulary) != brute(vocabulary)


def test_empty_and_very_long_words(spark):
    assert got(spark, {}) == []
    t = time.time()
    long = "ab" * 20_000
    words = {long: 2, long + "b": 50, "c" * 30_000: 3, "c" * 29_999: 3}
    rows = {r[0]: r for r in got(spark, words)}
    assert rows[long][1] == long + "b" and rows["c" * 30_000][4] == 1 and rows["c" * 29_999][1] is None
    assert time.time() - t < 120
