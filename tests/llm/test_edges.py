"""Columns of any name, nulls, repeated rows and empty tables through the operators that keep whole rows."""

import pytest

from cohortlens.llm import bpe, html_text, language_id, line_dedup, pii
from cohortlens.llm.tables import beside

NAMES = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c d` string, `e-f` struct<`g h`: int, `i.j`: string>, row int, id string"
PASSAGE = "\n".join(f"line {i} of a passage that two documents have in common" for i in range(8))
ROWS = [(1, PASSAGE, "en", "web", 1, 5, "x", (1, "y"), 7, "z"), (2, "before\n" + PASSAGE + "\nafter", "en", None, 2, None, None, None, None, None),
        (2, None, None, None, None, 1, "x", (None, None), 1, "z"), (None, "some english words here", "en", "web", 3, 1, "", (2, ""), 1, ""),
        (3, "", "en", "web", 0, 1, "x", (1, "y"), 1, "z")]


@pytest.fixture(scope="module", params=[ROWS, []], ids=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(request.param, NAMES)


def test_rows_keep_their_columns(docs):
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and sorted(out.dtypes) == sorted(docs.dtypes)
    got = {r["doc_id"]: r for r in out.collect() if r["text"]}
    if docs.count():
        assert got[2]["text"] == "before\nafter" and got[1]["e-f"]["g h"] == 1 and got[1]["a.b"] == 5
    known = language_id.known_language(docs, min_score=0.0)
    assert known.columns == docs.columns
    assert all(r["text"] for r in known.collect())


def test_ids_of_any_type_stay(docs):
    for rows in (bpe.digests(docs), pii.replace(docs, key=b"k")):
        assert rows.columns[0] == "doc_id" and rows.count() == docs.count()
    both = docs.withColumnRenamed("e-f", "key")
    assert pii.replace(both, "key", key=b"k").count() == bpe.Codec(both, bpe.vocabulary()).encode(both, "key").count() == docs.count()
    pages = docs.withColumnRenamed("text", "html")
    assert html_text.extract(pages, keep=("a.b", "e-f", "c d")).columns == ["a.b", "e-f", "c d", "text", "n_chars"]
    assert html_text.extract(pages, keep=("a.b", "e-f", "c d")).count() == docs.count()


def test_schema_beside_a_column(docs):
    assert beside(docs, "e-f", "n long").simpleString() == "struct<e-f:struct<g h:int,i.j:string>,n:bigint>"
