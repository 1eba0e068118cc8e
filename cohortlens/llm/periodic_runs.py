"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), at least
``LEAST`` words and ``TIMES`` periods long, that no neighbouring word extends with period q. Per text:

1. The dictionary names the factors of 1, 2, 4, ... words: equal factors have equal names, and a factor of twice
   the length is named by the pair of its halves. A factor is named further only while an equal one starts within a
   quarter of the text (the longest possible period), so that in ordinary prose almost nothing is left after few lengths.
2. At each length the next occurrence of a factor within twice its length proposes the distance as a period.
   Starts that follow each other with the same distance d are an arithmetic progression: they stand for one stretch with period d.
3. Stretches are extended to both sides while words d apart are identical, kept if long enough, and
   found more than once (from several lengths) are deduplicated.

Complete: in a run of period q the factors of the least power of two >= q have their next occurrence exactly q further, as rotations of
a primitive word differ, and that is within twice their length; and the run is longer than that factor plus q. Smallest: with a smaller
period r the stretch, being at least 4 d long, would let the factors recur at r.

Texts are worked on where they lie, chunks of whole documents at a time; nothing is shuffled. Words are compared by 64-bit hashes.

Nulls, empty texts and texts without words have no runs and nothing collapses (hashes of the empty string). A null id
is no seed for the inserted test repeat (``planted_repeat``): its text stays as it is. Of runs of equal length
the least start and then the least period is reported. Repeated rows give repeated results; an empty table gives
no rows; very long texts are one chunk each, in memory linear in the text. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import pick, ship, table

LEAST = 6
TIMES = 4


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, order): equal keys have equal names from 0 on; ``order`` lists the places by name and then by place."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), np.int64)
    new[:1] = 0
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    name = np.empty(len(keys), np.int64)
    name[order] = np.cumsum(new)
    return name, order


def successors(name: np.ndarray, order: np.ndarray, at: np.ndarray, doc: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For each factor how far the next equal one of its document is, 0 if there is none within its bound."""
    a, b = order[:-1], order[1:]
    ok = (name[a] == name[b]) & (at[b] - at[a] <= within[a]) & (doc[a] == doc[b])
    out = np.zeros(len(name), np.int64)
    out[a[ok]] = (at[b] - at[a])[ok]
    return out


def stretches(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, ascending; ``doc`` numbers the documents of the concatenated words from 0."""
    n = len(words)
    longest = np.bincount(doc) // TIMES if n else np.zeros(0, np.int64)  # period of a run in each document
    at = np.arange(n, dtype=np.int64)
    name, order = named(words)
    size, found = 1, []
    while len(at):
        gap = successors(name, order, at, doc[at], longest[doc[at]])
        near = np.flatnonzero((gap > 0) & (gap <= 2 * size))
        if len(near):  # arithmetic progressions: successive starts with one distance
            start, d = at[near], gap[near]
            cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(d) != 0) | (np.diff(doc[start]) != 0)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(near)]]) - 1
            found += zip(start[first].tolist(), (start[last] + size + d[last]).tolist(), d[first].tolist())
        # factors of twice the length: both halves must recur
        alive = gap > 0
        alive[np.searchsorted(at, (at + gap)[gap > 0])] = True
        half = np.searchsorted(at, at + size)
        half[half == len(at)] = 0
        keep = np.flatnonzero(alive & (at[half] == at + size) & alive[half] & (doc[at[half]] == doc[at]))
        name, order = named(name[keep] * np.int64(n + 1) + name[half[keep]])
        at = at[keep]
        size *= 2
    return extended(words, doc, found)


def extended(words: np.ndarray, doc: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The proposed (start, end, period) as whole runs, long enough and each once."""
    n, out, known, upto = len(words), [], 0, 0
    for a, z, d in sorted(found, key=lambda r: (r[2], r[0])):
        if d == known and z <= upto:
            continue  # a part of the stretch before
        while a and doc[a - 1] == doc[a] and words[a - 1] == words[a - 1 + d]:
            a -= 1
        while z < n and doc[z] == doc[a] and words[z] == words[z - d]:
            z += 1
        known, upto = d, z
        if z - a >= max(LEAST, TIMES * d):
            out.append((a, z - a, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_repeat(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document of the query's test repeats; None: as it is."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(source: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]):
        for c in tc.chunks(batches):
            ids = c.cols[0].to_pylist()
            start, end, first = tc.word_spans(c.data, c.off, tc.SPACE_WORDS)
            count = np.diff(first)
            doc = np.repeat(np.arange(len(c)), count)
            origin = np.arange(len(start))
            if source:
                for i, x in enumerate(ids):
                    moved = source(x, int(count[i]))
                    if moved is not None:
                        origin[first[i]: first[i + 1]] = first[i] + moved
            runs = stretches(tc.span_hashes(c.data, start, end)[origin], doc)
            drop = np.zeros(len(start) + 1, np.int64)
            each: list[list[dict]] = [[] for _ in ids]
            for a, length, period in runs:
                i = int(doc[a])
                each[i].append({"start": a - int(first[i]), "length": length, "period": period})
                drop[a + period] += 1
                drop[a + length] -= 1
            kept = np.cumsum(drop)[:-1] == 0
            raw, texts = c.data.tobytes(), []
            starts, ends = start.tolist(), end.tolist()
            for i in range(len(c)):
                mine = np.arange(first[i], first[i + 1])
                mine = origin[mine[kept[first[i]: first[i + 1]]]].tolist()
                texts.append(b" ".join([raw[starts[j]: ends[j]] for j in mine]).decode())
            yield pa.RecordBatch.from_arrays(
                [c.cols[0], pa.array(count, pa.int64()), pa.array(each, pa.list_(_RUN)), pa.array(texts, pa.string())],
                names=["id", "n_words", "runs", "collapsed"])
    return run


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` of each row: all runs in order of start and period, and the text's words
    without those that a run holds after its first period, joined by one space.

    ``source(id, n)`` may rearrange a document first: it gives for each of the n places the number of the word that stands there.
    """
    ship(docs.sparkSession)
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_find(source), SCHEMA).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Runs of ``documents`` in which every tenth text (by a hash of its id) repeats a part of itself."""
    found = runs(table(spark, sf_dir, "documents"), source=planted_repeat)
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.withColumn("best", best)
            .select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
                    F.expr("floor(1000 * best.length / -best.p)").cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
