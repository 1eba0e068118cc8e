"""n-gram Jaccard join against brute force over all pairs."""

import random

import pytest

from cohortlens.llm import jaccard_join
from cohortlens.llm.tables import Scratch, pick

SPACE = " \t\n\x0b\x0c\r"


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACE else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, pct=80):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= pct * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, base, n, most, first):
    """Near copies of ``base`` with up to ``most`` changed words, some cut short."""
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.15:
            w = w[: len(w) - rng.randrange(40)]
        out.append((first + i, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = text(60)
    rows = family(rng, text(150), 70, 7, 100) + family(rng, text(40), 25, 3, 300)
    rows += [(400 + i, " ".join([*text(20), *passage, *text(10)])) for i in range(12)]  # a passage that many share
    rows += [(500 + i, " ".join(text(rng.randrange(1, 30)))) for i in range(25)]
    rows += [(600, "one two"), (601, "One  TWO"), (602, "one"), (603, ""), (604, None), (605, " \n\t "), (606, "Ärger ärger"), (607, "ärger ärger")]
    rows += [(700, "a b c d e f"), (701, "a b c d e f")]  # ties: exact copies
    rows += [(800, " ".join(text(30_000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("few", [32, 2])
def test_components_match_brute_force(spark, corpus, few, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "'x' as token", "1 as n", "2 as cols")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute(corpus)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(0, 3, 0), (1, 3, 1), (1, 3, 1), (2, 0, 2)]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0
    kept = jaccard_join.keep_one(spark.createDataFrame([(1, "a b c"), (2, "A b c"), (3, "z")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert pick(df, text="text").columns == ["text"]


def test_sets_are_shuffled_once_before_they_meet(spark):
    """The sets that pairs are verified with are read where the texts lie and then dealt by id a single time."""
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w"), (3, "x y z u v w q"), (None, "a b c d e f g")], "id long, text string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = jaccard_join._sets_of(docs, ids, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    sets = {r.id: len(r.tokens) // 8 for r in jaccard_join._one_each(found).collect() if r.id in (1, 2, 3)}
    assert sets[1] == sets[2] == 3 and sets[3] in (2, 3)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in jaccard_join._verify(pairs, found, 80).collect()] == [(1, 2)]


def test_tables_that_no_later_step_reads_are_deleted(spark, corpus, monkeypatch):
    """While pairs are written, one table of token rows and one of token columns are kept at most; none when all is done."""
    live = {}
    put, drop = Scratch.put, Scratch.drop

    def kept_put(self, df, parts=None):
        if df.columns == ["a", "b"]:
            assert sum("token" in c for c in live.values()) <= 1
            assert sum("cols" in c for c in live.values()) <= 1
        out = put(self, df, parts)
        live[out._scratch_path] = df.columns
        return out

    def kept_drop(self, *tables):
        for t in tables:
            live.pop(t._scratch_path)
        drop(self, *tables)

    monkeypatch.setattr(Scratch, "put", kept_put)
    monkeypatch.setattr(Scratch, "drop", kept_drop)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == brute(corpus)
    assert live and not any({"token", "tokens", "cols", "private"} & set(c) for c in live.values())


def test_a_common_line_joins_few_pairs_of_a_large_family(spark, monkeypatch):
    """Copies of a template that all have the same added line and own changes, too many to link: no pair of each two of them."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    line = [f"l{i}" for i in range(12)]
    rows = [(1, " ".join(base))]
    for i in range(70):
        w = list(base)
        for at in rng.sample(range(100), 4):
            w[at] = f"x{i}-{at}"
        rows.append((10 + i, " ".join([*w[:50], *line, *w[50:]])))
    for i in range(0, 70, 7):  # some have a copy that links
        w = rows[1 + i][1].split(" ")
        rows.append((100 + i, " ".join([*w[:111], "end"])))
    made = []
    within = jaccard_join._within

    def counted(*args):
        out = within(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_within", counted)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert made and made[0] < 4 * len(rows)


def test_sets_are_read_only_for_pairs_that_bit_rows_leave_and_are_not_written(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(4000)
    rows = [(i, " ".join([*text(2500), *passage, *text(2500)])) for i in range(4)]  # all token columns are touched, the bound by them is useless
    rows += [(10, "a b c d e f g h i j k l m n"), (11, "a b c d e f g h i j k l m n o"), (12, " ".join(passage)), (13, " ".join(passage[:3700]))]
    rows += [(20, "p q"), (21, "p q r"), (22, "")]
    written, seen = [], set()
    put, verify = Scratch.put, jaccard_join._verify

    def kept_put(self, df, parts=None):
        written.append(df.columns)
        return put(self, df, parts)

    def kept_verify(pairs, *args):
        seen.update((r.a, r.b) for r in pairs.collect())
        return verify(pairs, *args)

    monkeypatch.setattr(Scratch, "put", kept_put)
    monkeypatch.setattr(jaccard_join, "_verify", kept_verify)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert not any("tokens" in c for c in written)
    assert {(min(p), max(p)) for p in seen} == {(10, 11), (12, 13)}


def test_documents_with_equal_sets_emit_tokens_once(spark, monkeypatch):
    """Copies are linked by their sets' signatures, so only the first of them takes part in the shuffle of tokens."""
    sent, emit = spark.sparkContext.accumulator(0), jaccard_join._emit

    def counting(*args):
        run = emit(*args)

        def counted(batches):
            for b in run(batches):
                sent.add(b.num_rows)
                yield b
        return counted

    monkeypatch.setattr(jaccard_join, "_emit", counting)
    texts = [" ".join(f"w{j}x{i}" for i in range(30)) for j in range(6)]
    docs = spark.createDataFrame([(c * 6 + j, t) for c in range(40) for j, t in enumerate(texts)], "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == 240 and all(r.component_id == r.doc_id % 6 and r.n_shingles == 26 for r in got)
    assert sent.value == 6 * 6  # 26 - 21 + 1 tokens of each distinct set
