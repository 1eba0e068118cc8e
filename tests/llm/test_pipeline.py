"""The corpus pipeline, stage by stage, against brute-force versions of its stages, and the driver contract."""

import re

import corpus_pipeline
from test_decontaminate import words
from test_jaccard_join import brute as jaccard_brute
from test_line_dedup import brute as lines_brute
from tokenizers import Tokenizer

from cohortlens.llm import bpe, queries
from cohortlens.llm.tables import Scratch, table

SF = "/root/testdata/sf0.001"


def without_hits(text, items):
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    w, hit = words(text), [False] * len(words(text))
    windows = {tuple(v[i: i + n]) for v in items for n in [min(10, len(v))] for i in range(len(v) - n + 1) if v}
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i: i + n]) in windows:
                hit[i: i + n] = [True] * n
    if sum(hit) > 0.5 * len(w):
        return None
    out, at = "", 0
    for i, h in enumerate(hit):
        if h and (i == 0 or not hit[i - 1]):
            out += text[at: spans[i][0]]
        if h:
            at = spans[i][1]
    return out + text[at:]


def test_stages(spark):
    tmp = Scratch(spark)
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = tmp.put(stage(spark, docs, SF))
        if k < 4:
            assert docs.columns == columns
        rows = docs.collect()
        seen.append({r.doc_id: r for r in rows})
        assert len(rows) == len(seen[-1])
    assert seen[1] == seen[0]  # every text is of a learned language
    lines = lines_brute([(i, r.text) for i, r in seen[1].items()])
    want = {i: [x for x in ls if x] for i, (n, gone, _, ls) in lines.items() if n == 0 or gone < n}
    assert {i: [x for x in r.text.split("\n") if x.split()] for i, r in seen[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in seen[2].values())
    comp = jaccard_brute([(i, r.text) for i, r in seen[2].items()])
    assert set(seen[3]) == {i for i, (_, c) in comp.items() if c == i}
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {i: without_hits(r.text, items) for i, r in seen[3].items()}
    assert {i: r.text for i, r in seen[4].items()} == {i: t for i, t in clean.items() if t is not None}
    library = Tokenizer.from_file(bpe.vocabulary())
    assert {i: r.ids for i, r in seen[5].items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in seen[4].items()}


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
