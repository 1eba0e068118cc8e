"""Language ID: held-out accuracy on the test data, filters without false negatives, edge cases."""

import random
import zlib

import numpy as np

from cohortlens.llm import language_id
from cohortlens.llm.tables import table

SF = "/root/testdata/sf0.001"


def test_grams_of_each_document():
    texts = [b"Ab  c!", b"", b"x", b"12", "été".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    g, first = language_id.grams(data, off)
    shown = [[x.to_bytes(4, "big") for x in g[a:b].tolist()] for a, b in zip(first[:-1], first[1:])]
    assert shown == [[b" ab ", b"ab c", b"b c "], [], [], [], [" ét".encode(), "été".encode()[:4], "été".encode()[1:5], "té ".encode()]]


def test_held_out_accuracy(spark):
    out = language_id.query(spark, SF)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    rows = out.collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert language_id.known_language(table(spark, SF, "documents")).count() == len(lang)


def test_prose_of_unlearned_languages_goes_and_clean_text_stays(spark):
    foreign = [
        "De regering heeft gisteren besloten dat de nieuwe wet pas volgend jaar in werking treedt, omdat er nog veel vragen zijn over de uitvoering. "
        "Volgens de minister moeten gemeenten eerst meer tijd krijgen om hun systemen aan te passen en het personeel op te leiden. Wij hebben daarom "
        "afgesproken dat iedereen voor het einde van de maand zijn bezwaren kan indienen.",
        "O governo decidiu ontem que a nova lei só entrará em vigor no próximo ano, porque ainda existem muitas dúvidas sobre a sua aplicação. Segundo "
        "o ministro, os municípios precisam de mais tempo para adaptar os seus sistemas e formar o pessoal.",
    ]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in language_id.known_language(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def test_rejection_score_follows_held_out_scores_and_strays_are_not_learned(spark):
    rows = [(1, "abcd " * 400_000, "x"), (2, "qqqq", "x"), (3, "efgh " * 1000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r.row: r.score for r in language_id.predict(df.selectExpr("doc_id as row", "text"), model).collect()}
    assert got[1] > 0.99 and got[3] > 0.99 and got[2] < 0.01
    least = language_id.least_scores(spark.createDataFrame([("abcd abcd", "x"), ("efgh " * 9 + "zzzz", "y")], "text string, lang string"), model)
    assert 0.6 < least["y"] < least["x"] < 0.7  # a third of the way from 1/2
    none = language_id.least_scores(df.limit(0), model)
    assert set(none) == {"x", "y"} and all(abs(v - 2 / 3) < 1e-9 for v in none.values())


def test_filter_has_no_false_negatives_and_many_languages(spark):
    rng = random.Random(2)
    langs = [f"l{i:02d}" for i in range(40)]  # more than one word of masks
    rows = []
    for n, lang in enumerate(langs):
        syllables = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(6)]
        rows += [(100 * n + i, " ".join(rng.choice(syllables) for _ in range(40)), lang) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r.row: r.lang_pred for r in language_id.predict(df.selectExpr("doc_id as row", "text"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_edge_cases(spark):
    rows = [(1, "aaaa bbbb aaaa", "x"), (2, "cccc dddd", "y"), (3, "zzzz", None), (4, None, "x"), (5, "12 !?", "y"), (6, "", None), (7, "qqqq", None), (8, "éé 1", None),
            (9, "aaaa bbbb " * 30_000, None), (1, "aaaa bbbb aaaa", "x"), (None, "cccc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as row")
    model = language_id.fit(df)
    got = {(r.row or 0): (r.lang_pred, round(r.score, 2)) for r in language_id.predict(df.selectExpr("doc_id as row", "text"), model).collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and got[9][0] == "x" and got[0][0] == "y"
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert got[7] == got[8] == got[3] == ("x", 0.0)  # letters, but nothing known: the most common language
    assert sorted(r.doc_id or 0 for r in language_id.known_language(df).collect()) == [0, 1, 1, 2, 9]
    nothing = language_id.fit(df.limit(0))
    assert [r.lang_pred for r in language_id.predict(df.selectExpr("doc_id as row", "text").limit(1), nothing).collect()] == ["und"]
    assert language_id.predict(df.selectExpr("doc_id as row", "text").limit(0), model).count() == 0
