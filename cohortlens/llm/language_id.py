"""Language identification with language-bitmask n-gram filters.

Training counts every letter n-gram of every labelled text (per task in numpy, then summed by Spark).
A gram belongs to the languages whose relative frequency of it reaches ``SHARE`` of the
highest one, so that quotations and wrong labels do not blur the filters, and is at least ``NOISE``, so that strays do not
fill the filters as the input grows. All languages share one bit-sliced Bloom
filter: a cell holds one bit for each language, and the AND of a gram's ``HASHES`` cells gives the
bitmask of all languages that contain it. The filter has a fixed largest size (``MAX_BITS``), so what
is broadcast is bounded; when it fills up, the measured false positive rate of each language rises,
and that rate is taken out of the popcounts.

Prediction counts, for each language, the grams of the whole text whose mask has its bit, and corrects
the share for false positives: (hits - n fp) / (n (1 - fp)). The language with the largest corrected share is
predicted (ties: the earlier name) and the share is the score.

A text that is null or has no letter is ``und`` with score 0, as is every text when nothing could be learned.
A text none of whose grams is known gets the language with the most training grams, score 0. Labels that are null do
not train. Rows are independent: repeated rows and other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import beside, pick, ship, table

SHARE = 0.25
#: a gram that makes up less of a language's grams is a stray
NOISE = 1e-6
#: the quantile of the held-out scores of a language from which its rejection score follows
LOW = 0.01
HASHES = 3
#: the filter has at most 2**MAX_BITS cells, of one byte for up to 8 languages (4 MB)
MAX_BITS = 22
BLOCK = 16
GRAM = 4

#: ASCII letters in lower case, other ASCII as a space, the bytes of other characters as they are
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass
class Filters:
    langs: list[str]
    bits: int
    cells: list[np.ndarray] = field(default_factory=list)  # a word of masks for each 8 (or 32) languages
    width: int = 8
    false: list[float] = field(default_factory=list)
    common: int = 0


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, first gram of each document): byte n-grams of the text, runs of non-letters as one space."""
    n = len(data)
    docs = len(off) - 1
    buf = np.full(n + 2 * docs, 32, np.uint8)  # a space before and after each document
    shift = np.repeat(2 * np.arange(docs) + 1, np.diff(off))
    buf[np.arange(n) + shift] = FOLD[data]
    begin = off[:-1] + 2 * np.arange(docs)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    keep[begin] = True
    buf = buf[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    first = kept[np.append(begin, len(keep))]
    m = max(0, len(buf) - GRAM + 1)
    g = buf[:m].astype(np.uint32)
    for j in range(1, GRAM):
        g = (g << np.uint32(8)) | buf[j: m + j]
    size = np.maximum(np.diff(first) - (GRAM - 1), 0)
    # the last GRAM - 1 positions of a document begin no gram of it
    ok = np.ones(m, bool)
    for j in range(1, GRAM):
        cut = first[1:] - j
        ok[cut[(cut >= first[:-1]) & (cut < m)]] = False
    return g[ok], np.concatenate([[0], np.cumsum(size)])


def _count(batches: Iterator[pa.RecordBatch]):
    """(text, lang) -> (lang, gram, n) of a whole task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(lang: str) -> None:
        g = np.concatenate([x[0] for x in held[lang]])
        n = np.concatenate([x[1] for x in held[lang]])
        u, at = np.unique(g, return_inverse=True)
        held[lang] = [(u, np.bincount(at, n).astype(np.int64))]

    for c in tc.chunks(batches):
        g, first = grams(c.data, c.off)
        langs = np.array(c.cols[0].to_pylist(), object)
        owner = np.repeat(np.arange(len(c)), np.diff(first))
        for lang in sorted(set(langs)):
            held.setdefault(lang, []).append(np.unique(g[(langs == lang)[owner]], return_counts=True))
            if len(held[lang]) > 16:
                merge(lang)
    for lang in held:
        merge(lang)
        g, n = held[lang][0]
        for a in range(0, len(g), 100_000):
            k = len(g[a: a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[a: a + k].astype(np.int64)), pa.array(n[a: a + k])],
                                             names=["lang", "gram", "n"])


def _places(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = tc.mix(g.astype(np.uint64) * tc.ODD + tc.U(1))
    out = []
    for _ in range(HASHES):
        out.append((h >> tc.U(64 - bits)).astype(np.int64))
        h = tc.mix(h + tc.ODD)
    return out


def _place_rows(bits: int):
    def run(batches):
        for b in batches:
            for at in _places(np.asarray(b.column(0)), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> BLOCK, pa.int64()), pa.array(at, pa.int64()), b.column(1), b.column(2)],
                                                 names=["block", "cell", "word", "mask"])
    return run


def _pack(rows: pa.Table) -> pa.Table:
    cells = np.zeros(1 << BLOCK, np.uint32)
    np.bitwise_or.at(cells, np.asarray(rows["cell"]) & ((1 << BLOCK) - 1), np.asarray(rows["mask"]).astype(np.uint32))
    return pa.table({"block": rows["block"][:1], "word": rows["word"][:1], "cells": pa.array([cells.tobytes()], pa.binary())})


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Learn the filters from all rows with a label."""
    ship(labelled.sparkSession)
    src = pick(labelled, lang=lang_col, text=text_col).filter("lang is not null and text is not null")
    counts = (src.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n"))).cache()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    model = Filters(langs, BLOCK)
    if not langs:
        counts.unpersist()
        return model
    model.common = max(range(len(langs)), key=lambda i: (totals[langs[i]], -i))
    model.width = 8 if len(langs) <= 8 else 32
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(totals[lang]))])
    rated = counts.select("gram", number[F.col("lang")].alias("l"), (F.col("n") / total[F.col("lang")]).alias("f"))
    top = rated.groupBy("gram").agg(F.max("f").alias("top"), F.collect_list(F.struct("l", "f")).alias("by"))  # one entry a language
    own = top.select("gram", "top", F.explode("by").alias("x")).filter((F.col("x.f") >= SHARE * F.col("top")) & (F.col("x.f") >= NOISE))
    masks = own.groupBy("gram", F.floor(F.col("x.l") / model.width).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(x.l % {model.width} as int))")).alias("mask")).select("gram", "word", "mask")
    n = counts.select(F.approx_count_distinct("gram")).first()[0]
    model.bits = max(BLOCK, min(MAX_BITS, int(np.ceil(np.log2(max(2, 12 * n))))))
    packed = (masks.mapInArrow(_place_rows(model.bits), "block long, cell long, word int, mask long")
              .groupBy("block", "cell", "word").agg(F.bit_or("mask").alias("mask"))
              .groupBy("block", "word").applyInArrow(_pack, "block long, word int, cells binary"))
    kind = np.uint8 if model.width == 8 else np.uint32
    model.cells = [np.zeros(1 << model.bits, kind) for _ in range(-(-len(langs) // model.width))]
    for r in packed.toLocalIterator():
        at = r["block"] << BLOCK
        model.cells[r["word"]][at: at + (1 << BLOCK)] = np.frombuffer(r["cells"], np.uint32)
    for i in range(len(langs)):
        fill = np.count_nonzero(model.cells[i // model.width] & kind(1 << (i % model.width))) / (1 << model.bits)
        model.false.append(float(fill ** HASHES))
    counts.unpersist()
    return model


def shares(model: Filters, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Corrected share of each document's grams in each language, 0 to 1: an array (documents, languages)."""
    g, first = grams(data, off)
    n = np.diff(first)
    out = np.zeros((len(n), len(model.langs)))
    if not len(g):
        return out
    some = np.flatnonzero(n)
    places = _places(g, model.bits)
    for w, cells in enumerate(model.cells):
        mask = cells[places[0]]
        for at in places[1:]:
            mask = mask & cells[at]
        for i in range(w * model.width, min((w + 1) * model.width, len(model.langs))):
            bit = (mask >> mask.dtype.type(i % model.width)) & mask.dtype.type(1)
            hits = np.add.reduceat(bit, first[:-1][some], dtype=np.int64)
            fp = min(model.false[i], 0.999)
            out[some, i] = np.clip((hits / n[some] - fp) / (1 - fp), 0, 1)
    return out


def _has_letter(c: tc.Chunk) -> np.ndarray:
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[65:91] = ascii_letter[97:123] = 1
    run = np.concatenate([[0], np.cumsum(ascii_letter[c.data])])
    out = run[c.off[1:]] > run[c.off[:-1]]
    for i in np.flatnonzero(~out):
        a, b = c.bounds(i)
        out[i] = any(ch.isalpha() for ch in bytes(c.data[a:b]).decode())
    return out & ~c.nulls


def _predict(model):
    def run(batches):
        m: Filters = model.value
        for c in tc.chunks(batches):
            langs, scores = ["und"] * len(c), np.zeros(len(c))
            if m.langs:
                s = shares(m, c.data, c.off)
                best = s.argmax(1)
                scores = s[np.arange(len(c)), best]
                best = np.where(scores > 0, best, m.common)
                letter = _has_letter(c)
                scores = np.where(letter, scores, 0.0)
                langs = [m.langs[b] if ok else "und" for b, ok in zip(best, letter)]
            yield pa.RecordBatch.from_arrays([c.cols[0], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["row", "lang_pred", "score"])
    return run


def predict(rows: DataFrame, model: Filters) -> DataFrame:
    """(row, lang_pred, score) of each of ``rows(row, text)``."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select("row", F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(shared), beside(rows, "row", "lang_pred string, score double"))


def held_out(id_col: str):
    """Rows that never train: crc32 of the id's text leaves 2 modulo 4 (a null id is neither)."""
    return F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 4 = 2")


def least_scores(labelled: DataFrame, model: Filters, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """The rejection score of each language, from the scores of labelled rows that did not train.

    Where nearly every gram is known the best share is 1 / languages or more even for foreign text, so the score lies a third of the way
    from there to the low quantile of the language (of the lowest language, or 1, where it has no such rows).
    """
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("row"), F.col(f"`{text_col}`").alias("text")).filter("row is not null")
    right = predict(rows, model).filter("row = lang_pred and score > 0")
    low = {r[0]: r[1] for r in right.groupBy("lang_pred").agg(F.percentile_approx("score", LOW, 10_000)).collect()}
    base = 1 / len(model.langs) if len(model.langs) > 1 else 0.0
    found = {lang: low.get(lang, min(low.values(), default=1.0)) for lang in model.langs}
    return {lang: min(q, base + (q - base) / 3) for lang, q in found.items()}


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   min_score: float | None = None) -> DataFrame:
    """``docs`` without the rows that are ``und`` or score under ``min_score`` (by default the least score of their language)."""
    held = held_out(id_col)
    model = fit(docs.filter(~held), text_col, lang_col)
    least = F.lit(min_score if min_score is not None else 1.0)
    if min_score is None and model.langs:
        scores = least_scores(docs.filter(held), model, text_col, lang_col)
        least = F.create_map(*[F.lit(x) for item in scores.items() for x in item])[F.col("lang_pred")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return predict(rows, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id")))
    out = predict(docs.select(F.struct("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")).alias("row"), "text"), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")
