"""SimHash fingerprints and links against brute force over all pairs."""

import random
import re

import pytest
import xxhash

from cohortlens.llm import simhash
from cohortlens.llm.tables import Scratch


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    parts = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    alive = [i for i, (d, _) in enumerate(rows) if d is not None]
    for n, i in enumerate(alive):
        for j in alive[n + 1:]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in alive:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(d, f"{prints[i]:016x}", None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `print` string, `a.b c` int")
    return sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = [f"W{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 400))]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(rng.choice([" ", "\n"]).join(w))
    rows += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    rows += ["", None, " \t\x0b\n", "a", "A", "a b", "a\x0bB", "é É ü", "a b c", "a b c d", "a b a b a b a b", "x " * 5000]
    rng.shuffle(rows)
    ids = rng.sample(range(-1000, 10**6), len(rows))
    out = list(zip(ids, rows))
    return [*out, (None, "a b c"), (None, None), out[5], (out[7][0], "quite another text of the same id")]


def test_all_links_and_no_other(spark, corpus):
    assert got(spark, corpus) == brute(corpus)


def test_members_shuffled_instead_of_sent(spark, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "SENT", 0)
    assert got(spark, corpus) == brute(corpus)


def test_links_of_any_two_bits(spark):
    """Every way to differ in up to three bits, alone (pairs) and in a large family (places)."""
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for many in (False, True):
        want, values = set(), set()
        for _ in range(150):
            base = rng.getrandbits(64)
            bits = rng.sample(range(64), rng.randrange(1, 4))
            other = base
            for b in bits:
                other ^= 1 << b
            values |= {base, other}
            if len(bits) <= 2:
                want.add(frozenset((base, other)))
        if many:
            base = rng.getrandbits(64)
            values |= {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
        df = spark.createDataFrame([(signed(v),) for v in values], "print long")
        edges = simhash.links(df, Scratch(spark)).collect()
        assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2 for r in edges)
        up = {signed(v): signed(v) for v in values}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in edges:
            up[find(r["a"])] = find(r["b"])
        assert all(find(signed(min(p))) == find(signed(max(p))) for p in want)
        if many:
            assert len({find(signed(base ^ (1 << a) ^ (1 << b))) for a in range(64) for b in range(a)}) == 1


def test_segments_are_what_finds_pairs(spark, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "signatures", lambda p: p.selectExpr("print as sig", "print"))
    assert got(spark, corpus) != brute(corpus)


def test_empty_table(spark):
    assert got(spark, []) == []
