"""Decontamination against a brute-force search of every window, with items in one and in several blocks."""

import hashlib
import re

import pytest

from cohortlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w = words(text)
        hit, names = [False] * len(w), set()
        for name, t in items:
            v = words(t)
            n = min(10, len(v))
            for a in range(len(v) - n + 1 if v else 0):
                for b in range(len(w) - n + 1):
                    if w[b: b + n] == v[a: a + n]:
                        hit[b: b + n] = [True] * n
                        names.add(str(name))
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


ITEM = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"
ITEMS = [(1, ITEM), (2, "short one"), (3, ""), (4, None), (5, "!!!"), (10, ITEM + " again"), (11, "été à"), (2, "short one"), (12, "a a a a a a a a a a a a")]
DOCS = [
    (1, "x y " + ITEM.upper() + " z"), (2, "the quick brown fox jumps over the lazy"), (3, "a Short, one; short one"), (4, ""), (5, None), (6, "..."),
    (7, "fox jumps over the lazy dog and runs away from the big bad wolf again"), (8, "Été à l'été"), (8, "Été à l'été"),
    (9, "a " * 40), (10, "quick brown fox jumps over the lazy dog and SHORT one"), (11, ("lorem " * 20_000) + ITEM), (12, "short"), (13, "one short"),
]


@pytest.mark.parametrize("block", [500_000, 6])
def test_digest_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'q' as spans", "0 as items")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_spans_are_cut_and_clean_rows_stay(spark):
    docs = spark.createDataFrame([(1, "keep this text as it is", "a"), (2, "before " + ITEM + ", after it come many words of its own " * 2, "b"), (3, ITEM, "c"), (4, None, "d")],
                                 "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.row) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got[1] == ("keep this text as it is", "a") and got[4] == (None, "d") and 3 not in got
    assert got[2][0].startswith("before , after it come") and "fox" not in got[2][0]
    empty = decontaminate.contamination(docs.limit(0), items.limit(0))
    assert empty.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"] and empty.count() == 0
