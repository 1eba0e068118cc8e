"""Line dedup by pairwise alignment.

A document's lines are compared by the words in them (white space aside); lines without
words are ignored. The operator

1. reduces each document to its line hashes (8 bytes a line), and documents with equal line sequences to
   the first of them: the later ones are one aligned block, wholly deleted;
2. finds partners: for each line, the shortest run of successive lines with ``min_words`` words that begins with it, and
   the one that ends with it, are hashed; a document is linked with the first document (smallest id) that holds
   such a run. Every longer common run is covered by such runs, so each has its true first holder as a partner,
   nothing is capped, and links stay linear in the number of lines;
3. aligns each linked pair with patience diff: lines unique in both documents, their longest
   increasing subsequence, then the gaps between in the same way, with common heads and tails. What that
   cannot align (lines that repeat, blocks in another order) is looked up by the shortest runs of ``min_words`` words;
4. deletes from the later document the common runs of lines of ``min_words`` words or more, so none
   remains. Since partners are first holders, the first copy of each line always stays.

Nulls and texts without words have no lines and stay as they are; a null id links with nothing. Rows that
repeat an id count as one document, with the largest (number of lines, signature) of its texts; a row with other lines is
not cut. Other columns are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc
from cohortlens.llm.jaccard_join import ID_BITS, _id_filter
from cohortlens.llm.tables import Scratch, beside, pick, ship, table

RARE = 64
MIN_WORDS = 20

LINES = "id long, n long, s1 long, s2 long, lines array<long>, words array<int>"


def line_hashes(data: np.ndarray, off: np.ndarray):
    """(hashes, words) of the lines that have words, and the first line of each document."""
    start, end, first = tc.word_spans(data, off, tc.SPACE_WORDS)
    h = tc.span_hashes(data, start, end)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = line[1:] != line[:-1]
    new[first[:-1][first[:-1] < n]] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    p, q = tc.powers(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=run[1:])
    hashes = tc.mix((run[hi] - run[lo]) * q[lo] + (hi - lo).astype(np.uint64))
    return hashes, (hi - lo).astype(np.int32), np.searchsorted(lo, first)


def _sequence(h: np.ndarray) -> tuple[int, int]:
    p, _ = tc.powers(len(h))
    return (int((tc.mix(h) * p[: len(h)]).sum(dtype=np.uint64).astype(np.int64)),
            int((tc.mix(h ^ tc.ODD) * p[: len(h)]).sum(dtype=np.uint64).astype(np.int64)))


def _read(batches: Iterator[pa.RecordBatch]):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])
    for c in tc.chunks(batches):
        h, words, first = line_hashes(c.data, c.off)
        sig = [_sequence(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        off = pa.array(first.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [c.cols[0].cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array([s[0] for s in sig], pa.int64()),
             pa.array([s[1] for s in sig], pa.int64()), pa.ListArray.from_arrays(off, pa.array(tc.signed(h))),
             pa.ListArray.from_arrays(off, pa.array(words))], schema=schema)


def _increasing(at: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(at)
    for i, x in enumerate(at):
        k = bisect_left(tops, x)
        if k:
            back[i] = piles[k - 1]
        if k == len(tops):
            tops.append(x)
            piles.append(i)
        else:
            tops[k] = x
            piles[k] = i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(x: list[int], lo: int, hi: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[x[i]] = -1 if x[i] in seen else i
    return {v: i for v, i in seen.items() if i >= 0}


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal elements, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        left, right = _once(x, a, b), _once(y, c, d)
        common = [i for v, i in left.items() if v in right]
        if not common:
            continue
        common.sort()
        chain = _increasing([right[x[i]] for i in common])
        p, q = a, c
        for k in chain:
            i = common[k]
            j = right[x[i]]
            out.append((i, j))
            todo.append((p, i, q, j))
            p, q = i + 1, j + 1
        todo.append((p, b, q, d))
    out.sort()
    return out


def least_runs(words, first, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the shortest runs of a document's lines with ``least`` words, from each line on and up to each line.

    Together they cover every longer run. ``first`` is the first line of each document, and the end.
    """
    total = np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))])
    n = len(total) - 1
    at, size = np.arange(n), np.diff(first)
    end, begin = np.repeat(first[1:], size), np.repeat(first[:-1], size)
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    on, up = stop <= end, start >= begin
    runs = np.unique(np.concatenate([at[on] * (n + 1) + stop[on], start[up] * (n + 1) + at[up] + 1]))
    return runs // (n + 1), runs % (n + 1)


def blocks(x: list[int], y: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges of ``y`` in runs of lines that ``x`` has in succession too and that have ``least`` words.

    Patience diff aligns what it can; runs of lines that repeat or blocks that moved are looked up in what it leaves.
    """
    hit = [False] * len(y)
    start = last = None
    for i, j in [*patience(x, y), (-9, -9)]:
        if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
            last = (i, j)
            continue
        if start is not None and sum(words[start: last[1] + 1]) >= least:
            hit[start: last[1] + 1] = [True] * (last[1] + 1 - start)
        start, last = j, (i, j)
    if not all(hit):
        known = dict(zip(y, words))
        sizes = [known.get(v, least) for v in x]  # a line that y has not is in no common run
        held = {tuple(x[lo:hi]) for lo, hi in zip(*(r.tolist() for r in least_runs(sizes, [0, len(x)], least)))}
        for lo, hi in zip(*(r.tolist() for r in least_runs(words, [0, len(y)], least))):
            if tuple(y[lo:hi]) in held:
                hit[lo:hi] = [True] * (hi - lo)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _run_keys(least: int):
    """(id, lines, words) -> (id, k1, k2): two hashes of each of the least runs of a document."""
    def run(batches):
        for b in batches:
            size = np.diff(np.asarray(b.column(1).offsets))
            first = np.concatenate([[0], np.cumsum(size)])
            h = np.asarray(b.column(1).flatten()).view(np.uint64)
            lo, hi = least_runs(np.asarray(b.column(2).flatten()), first, least)
            p, q = tc.powers(len(h))
            keys = []
            for x in (tc.mix(h), tc.mix(h ^ tc.ODD)):
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(x * p[: len(h)], out=total[1:])
                keys.append(pa.array(tc.signed(tc.mix((total[hi] - total[lo]) * q[lo] + (hi - lo).astype(np.uint64)))))
            owner = np.searchsorted(first, lo, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *keys], names=["id", "k1", "k2"])
    return run


SPANS = "id long, spans array<struct<lo:int,hi:int>>"


def _align(least: int):
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for b in batches:
            ids, spans = [], []
            for i, y, words, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                found = blocks(x, y, words, least)
                if found:
                    ids.append(i)
                    spans.append([{"lo": lo, "hi": hi} for lo, hi in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["id", "spans"])

    return run


def _removed(docs: DataFrame, min_words: int, tmp: Scratch) -> DataFrame:
    """(id, n, s1, s2, spans): the line ranges to delete, of documents that lose any."""
    rows = tmp.put(docs.mapInArrow(_read, LINES).filter("id is not null and n > 0"))
    nodes = rows.groupBy("id").agg(F.max(F.struct("n", "s1", "s2", "lines", "words")).alias("v")).select("id", "v.*")
    nodes = tmp.put(nodes)
    tmp.drop(rows)
    # copies: the smallest id of each line sequence goes on
    lead = nodes.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    copied = tmp.put(nodes.select("id", "n", "s1", "s2").join(lead, ["n", "s1", "s2"]).select("id", "n", "s1", "s2", "rep"))
    reps = tmp.put(nodes.join(copied.filter("id = rep").select("id"), "id", "left_semi").select("id", "lines", "words"))

    keys = tmp.put(reps.mapInArrow(_run_keys(min_words), "id long, k1 long, k2 long"))
    held = keys.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    links = keys.join(held, ["k1", "k2"]).filter("id <> first").select("id", "first").distinct()
    later = reps.select("id", F.col("lines").alias("y"), "words")
    early = reps.select(F.col("id").alias("first"), F.col("lines").alias("x"))
    aligned = links.join(later, "id").join(early, "first").select("id", "y", "words", "x").mapInArrow(_align(min_words), SPANS)
    spans = aligned.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    own = copied.filter("id = rep").join(spans, "id").select("id", "n", "s1", "s2", "spans")
    whole = copied.filter("id <> rep").select("id", "n", "s1", "s2", F.expr(
        "array(named_struct('lo', 0, 'hi', cast(n as int)))").alias("spans"))
    out = tmp.put(own.unionByName(whole))
    tmp.drop(nodes, reps, keys, copied)
    return out


CUT = "n_lines long, n_removed long, n_removed_words long, clean string"


def _cut(batches: Iterator[pa.RecordBatch]):
    """(row, text, n, s1, s2, spans) -> row and what is left of the text; null where nothing changes."""
    for b in batches:
        at = {f.name: i for i, f in enumerate(b.schema)}
        data, off, _ = tc.string_parts(b.column(at["text"]))
        rows = zip(*(b.column(at[c]).to_pylist() for c in ("text", "n", "s1", "s2", "spans")))
        counts, gone, words_gone, clean = [], [], [], []
        for k, (text, n, s1, s2, spans) in enumerate(rows):
            h, words, _ = line_hashes(data[off[k]: off[k + 1]], np.array([0, off[k + 1] - off[k]]))
            counts.append(len(h))
            if spans is None or (n, s1, s2) != (len(h), *_sequence(h)):
                gone.append(0)
                words_gone.append(0)
                clean.append(None)
                continue
            drop = np.zeros(len(h), bool)
            for s in spans:
                drop[s["lo"]: s["hi"]] = True
            keep, i = [], 0
            for part in text.split("\n"):
                if part.encode().split():
                    i += 1
                    if drop[i - 1]:
                        continue
                keep.append(part)
            gone.append(int(drop.sum()))
            words_gone.append(int(words[drop].sum()))
            clean.append("\n".join(keep))
        yield pa.RecordBatch.from_arrays(
            [b.column(at["row"]), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(words_gone, pa.int64()),
             pa.array(clean, pa.string())], names=["row", "n_lines", "n_removed", "n_removed_words", "clean"])


def _maybe(held):
    def run(batches):
        bits = held.value.view(np.uint64)
        for b in batches:
            at = np.asarray(b.column(3)).view(np.uint64) >> tc.U(64 - ID_BITS)
            hit = ((bits[(at >> tc.U(6)).astype(np.int64)] >> (at & tc.U(63))) & tc.U(1)).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hit)], names=["row", "id", "text", "maybe"])
    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               rare: int = RARE) -> DataFrame:
    """``docs`` with n_lines, n_removed, n_removed_words and ``clean``: the text that is left (null: unchanged).

    The result holds the input row in the struct ``row``, so no column name can clash. ``rare`` is accepted for
    callers of earlier forms; the partners no longer depend on how many documents hold a line.
    """
    spark = docs.sparkSession
    ship(spark)
    tmp = Scratch(spark)
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    gone = _removed(src, min_words, tmp)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # texts that surely lose nothing (by a broadcast filter of fixed size) are not shuffled for the join
    held = spark.sparkContext.broadcast(_id_filter(gone.select("id")))
    told = rows.withColumn("h", F.xxhash64("id")).mapInArrow(
        _maybe(held), beside(rows, "row", "id long, text string, maybe boolean"))
    cols = ["row", "text", "n", "s1", "s2", "spans"]
    none = told.filter("not maybe").select("row", "text", *[F.lit(None).cast(gone.schema[c].dataType).alias(c) for c in cols[2:]])
    some = told.filter("maybe").join(gone, "id", "left").select(*cols)
    return none.unionByName(some).mapInArrow(_cut, beside(rows, "row", CUT))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the deleted lines taken out of the text; rows that lose all their lines go."""
    out = line_dedup(docs, id_col, text_col, min_words).filter("n_removed = 0 or n_removed < n_lines")
    return out.select(*[(F.coalesce("clean", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", "n_removed_words", F.coalesce("clean", "row.text").alias("text"))
