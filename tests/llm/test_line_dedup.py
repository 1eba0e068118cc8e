"""Line dedup: patience alignment on small cases, a plain search for partners, and the edge cases."""

import random

from cohortlens.llm import line_dedup
from cohortlens.llm.line_dedup import MIN_WORDS, RARE, blocks, patience


def test_patience_aligns_unique_lines_in_order():
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert patience([1, 9, 2, 9, 3], [1, 2, 3]) == [(0, 0), (2, 1), (4, 2)]
    assert patience([5, 1, 2, 3], [1, 2, 3, 5]) == [(1, 0), (2, 1), (3, 2)]
    assert patience([7, 7, 7], [7, 7]) in ([(0, 0), (2, 1)], [(0, 0), (1, 1)])
    assert patience([], [1]) == []
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        a = patience(x, y)
        assert all(x[i] == y[j] for i, j in a) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(a, a[1:]))


def test_blocks_need_words():
    assert blocks([1, 2, 3], [8, 1, 2, 9, 3], [5, 10, 10, 5, 30], 20) == [(1, 3), (4, 5)]
    assert blocks([1, 2], [1, 9, 2], [10, 1, 10], 20) == []


def common_runs(x, y, words, least):
    """By plain search: the lines of ``y`` in any run of ``least`` words that ``x`` has too."""
    return {t for a in range(len(y)) for b in range(a + 1, len(y) + 1) if sum(words[a:b]) >= least
            and any(x[i: i + b - a] == y[a:b] for i in range(len(x))) for t in range(a, b)}


def test_blocks_find_repeated_and_moved_lines():
    assert blocks([1, 2, 1], [3, 1, 4], [5, 60, 5], 20) == [(1, 2)]
    assert blocks([2, 1], [3, 1, 4, 1, 5], [5, 60, 5, 60, 5], 20) == [(1, 2), (3, 4)]
    assert blocks([1, 2, 9, 3, 4], [3, 4, 8, 1, 2], [30, 30, 5, 30, 30], 20) == [(0, 2), (3, 5)]
    rng = random.Random(3)
    size = [rng.randrange(1, 25) for _ in range(8)]
    for _ in range(400):
        x, y = ([rng.randrange(8) for _ in range(rng.randrange(14))] for _ in range(2))
        words = [size[v] for v in y]
        assert {t for lo, hi in blocks(x, y, words, 20) for t in range(lo, hi)} == common_runs(x, y, words, 20)


def brute(rows, rare=RARE, least=MIN_WORDS):
    """The operator's rule by plain search: which lines each document keeps."""
    lines = {i: [ln for ln in (t or "").split("\n") if ln.encode().split()] for i, t in rows}
    seq = {i: [tuple(ln.encode().split()) for ln in ls] for i, ls in lines.items()}
    rep = {}
    for i in sorted(seq):
        rep.setdefault(tuple(seq[i]), i)
    reps = sorted(set(rep.values()))
    holders, pairs = {}, {}
    for i in reps:
        for ln in set(seq[i]):
            holders.setdefault(ln, []).append(i)
        for p in set(zip(seq[i], seq[i][1:])):
            pairs.setdefault(p, []).append(i)
    gone = {}
    for i in sorted(seq):
        drop = set()
        if not seq[i]:
            pass
        elif rep[tuple(seq[i])] != i:
            drop = set(range(len(seq[i])))
        else:
            early = {holders[ln][0] for ln in seq[i] if len(holders[ln]) <= rare or len(ln) >= least} | {pairs[p][0] for p in zip(seq[i], seq[i][1:])}
            for e in early - {i}:
                for lo, hi in blocks(seq[e], seq[i], [len(x) for x in seq[i]], least):
                    drop |= set(range(lo, hi))
        gone[i] = drop
    return {i: (len(seq[i]), len(gone[i]), sum(len(seq[i][k]) for k in gone[i]), [ln for k, ln in enumerate(lines[i]) if k not in gone[i]]) for i in seq}


def corpus():
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    pool = [line(rng.randrange(3, 30)) for _ in range(60)]
    common = line(6)
    rows = []
    for i in range(60):
        own = [line(rng.randrange(2, 12)) for _ in range(rng.randrange(1, 6))]
        at = rng.randrange(50)
        own[1:1] = pool[at: at + rng.randrange(6)]
        rows.append((i, "\n".join([*own, common, ""])))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, "  " + rows[5][1].replace("\n", " \n\n")), (73, ""), (74, None), (75, " \n\t\n"), (76, "\n".join(line(8) for _ in range(3000)))]
    return rows


def test_kept_lines_match_plain_search(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n").repartition(4)
    for rare in (RARE, 2):
        expected = brute(rows, rare)
        out = line_dedup.line_dedup(df, rare=rare).collect()
        got = {r.row.doc_id: (r.n_lines, r.n_removed, r.n_removed_words, [x for x in ((r.clean if r.clean is not None else r.row.text) or "").split("\n") if x.split()]) for r in out}
        assert got == expected


def test_run_whose_pieces_were_first_seen_apart(spark):
    short = [" ".join(f"{c}{i}" for i in range(8)) for c in "abc"]
    mid = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("d", 15), ("e", 3), ("f", 15))]
    own = iter(f"own {i}" for i in range(100))
    rows = [(i, "\n".join([next(own), *x, next(own)])) for i, x in enumerate([short[:2], short[1:], short, short, mid[:2], mid[1:], mid, mid])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.n_removed for r in line_dedup.line_dedup(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0, 6: 0, 7: 3}


def test_every_run_an_earlier_document_holds_goes(spark):
    rng = random.Random(5)
    pool = [" ".join(f"p{k}x{i}" for i in range(rng.randrange(1, 12))) for k in range(12)]
    rows = [(i, "\n".join(pool[rng.randrange(12)] if rng.random() < 0.3 else pool[(i + k) % 12] for k in range(rng.randrange(1, 9)))) for i in range(60)]
    got = {r.row.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seq = {i: t.split("\n") for i, t in rows}
    for i, y in seq.items():
        words = [len(x.split()) for x in y]
        gone = set().union(*(common_runs(seq[e], y, words, MIN_WORDS) for e in range(i)), range(len(y)) if any(seq[e] == y for e in range(i)) else ())
        assert got[i] == len(gone)


def test_first_copies_stay_and_edge_cases(spark):
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(2, "own line two\n" + long), (1, "own line one\n" + long), (3, long), (3, long), (None, long), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup(df).collect())
    assert got == [(0, long), (1, "own line one\n" + long), (2, "own line two"), (4, None)]
    assert line_dedup.dedup(df.limit(0)).count() == 0
