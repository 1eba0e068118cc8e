"""Suffix-array dedup with longest-previous-factor arrays.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id, or same document and
earlier start) is removed, judged on the input. Exact, and distributed as follows:

1. Windows of ``length`` bytes are dealt out by their *minimizer*: the smallest hash of the ``K``-byte strings in
   them. Equal windows have equal minimizers, and successive windows mostly share one, so a document becomes
   few segments (windows of one minimizer, some 35 at a time) of which only hashes, id and place are shuffled.
   A first pass counts minimizers in a sketch of fixed size; for those it knows to be hot (a line that
   stands in a third of the texts) each window is dealt by its own hash instead, so that no key gathers an
   unbounded group. Equal segments of one task are combined there: all but the first are removed as a whole.
2. By key, all but the first of equal segments are removed. Where one minimizer has segments of several contents,
   the first of each is wanted in bytes.
3. The wanted bytes are cut from the texts and meet again by key. There a suffix array over the segments is
   built by doubling (8, 16, 32, 64, ``length`` bytes). Suffixes that agree on ``length`` bytes stand in order of place, so the previous smaller
   position of each is its neighbour: the longest previous factor reaches ``length`` except
   for the first of a run, and such places are removed.
4. Spans are joined per document.

Nulls and texts under ``length`` bytes lose nothing; a null id neither matches nor loses anything. A row that repeats an id with
the same text is the same document: neither is earlier than the other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import sketch as counts
from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import Scratch, pick, table

LENGTH = 100
K = 28
#: sketched minimizer counts from which windows are dealt one by one
HOT = 4096
#: bytes in one suffix array
ARRAY = 1 << 20


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` successive values: running minima from both ends of blocks of ``w``."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    pad = np.full(-(-len(h) // w) * w, tc.U(0xFFFFFFFFFFFFFFFF))
    pad[: len(h)] = h
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1: w - 1 + n])


class Segments:
    """The segments of a chunk: key, document, place of the first window, number of windows."""

    def __init__(self, c: tc.Chunk, length: int):
        data, n = c.data, len(c.data)
        self.key = np.zeros(0, np.uint64)
        self.doc = self.start = self.size = np.zeros(0, np.int64)
        if n < length:
            return
        p, q = tc.powers(n)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(tc._SEEDS[data] * p[:n], out=self.run[1:])
        self.inverse = q
        h = tc.mix((self.run[K:] - self.run[:-K]) * q[: n - K + 1])
        low = _window_minima(h, length - K + 1)  # one for each place where a window fits into the chunk
        size = np.diff(c.off)
        # a window that runs over its document's end is none
        valid = np.zeros(n + 1, np.int8)
        fits = size >= length
        np.add.at(valid, c.off[:-1][fits], 1)
        np.add.at(valid, c.off[1:][fits] - length + 1, -1)
        valid = np.cumsum(valid[: len(low)]).astype(bool)
        change = np.empty(len(low), bool)
        change[0] = True
        # a segment ends where a smaller hash comes in or its minimizer leaves: no window occurs twice in a segment
        change[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1]) | (valid[1:] != valid[:-1])
        at = c.off[:-1][fits]
        change[at[at < len(low)]] = True
        begin = np.flatnonzero(change)
        long = np.diff(np.append(begin, len(low)))
        ok = valid[begin]
        self.start, self.size = begin[ok], long[ok]
        self.key = low[self.start]
        self.doc = np.searchsorted(c.off, self.start, "right") - 1

    def content(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tc.mix((self.run[end] - self.run[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _count(length: int):
    def run(batches):
        seen = counts.Counter()
        for c in tc.chunks(batches):
            seen.add(Segments(c, length).key)
        yield seen.batch()
    return run


ROW = "key long, content long, id long, pos int, windows int"
NAMES = ["key", "content", "id", "pos", "windows"]


def _batch(key, content, ids, pos, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tc.signed(key)), pa.array(tc.signed(content)), pa.array(ids, pa.int64()),
                                       pa.array(pos.astype(np.int32)), pa.array(windows.astype(np.int32))], names=NAMES)


def _spread(ids: np.ndarray) -> np.ndarray:
    return tc.mix(ids.view(np.uint64) + tc.ODD)


def _joined(ids: np.ndarray, pos: np.ndarray, windows: np.ndarray):
    """Runs of windows of one document that touch, as one run each."""
    order = np.lexsort((pos, ids))
    ids, pos, end = ids[order], pos[order], (pos + windows)[order]
    if not len(ids):
        return ids, pos, windows
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (pos[1:] > end[:-1])
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, at)
    return ids[at], pos[at], stop - pos[at]


def _later(key, content, ids, pos) -> np.ndarray:
    """Marks the rows whose (key, content) also stands in an earlier row (by id, then place)."""
    order = np.lexsort((pos, ids, content, key))
    k, x, d, s = key[order], content[order], ids[order], pos[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later = np.zeros(len(k), bool)
    later[order] = (d != d[lead]) | (s != s[lead])
    return later


def _deal(length: int, sketch):
    """Segments of a task: rows to be dealt by key, and runs that are removed already (windows < 0)."""
    hot = counts.step(HOT)

    def run(batches):
        steps = sketch.value
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            key, content, ids, pos, windows = (np.concatenate(x) for x in zip(*held))
            gone = _later(key, content, ids, pos)
            yield _batch(*(x[~gone] for x in (key, content, ids, pos, windows)))
            i, p, w = _joined(ids[gone], pos[gone], windows[gone])
            yield _batch(_spread(i), np.zeros(len(i), np.uint64), i, p, -w)

        for c in tc.chunks(batches):
            s = Segments(c, length)
            if not len(s.key):
                continue
            ids = np.asarray(c.cols[0])
            fine = steps[counts.cells(s.key)] >= hot
            start, n = s.start[~fine], s.size[~fine]
            parts = [(s.key[~fine], s.content(start, start + n + length - 1), s.doc[~fine], start, n)]
            if fine.any():
                n = s.size[fine]
                start = np.repeat(s.start[fine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                x = s.content(start, start + length)
                parts.append((x, tc.mix(x ^ tc.ODD), np.repeat(s.doc[fine], n), start, np.ones(len(start), np.int64)))
            for key, x, doc, start, n in parts:
                held.append([key, x, ids[doc], start - c.off[doc], n])
                size += len(key)
            if size > 1_500_000:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()
    return run


def _group(batches: Iterator[pa.RecordBatch]):
    """All rows of a key stand in one partition: removed runs (windows < 0), and segments wanted in bytes."""
    cols = [[np.asarray(b.column(i)) for i in range(5)] for b in batches if b.num_rows]
    if not cols:
        return
    key, content, ids, pos, windows = (np.concatenate(x) for x in zip(*cols))
    done = windows < 0
    yield _batch(*(x[done].view(np.uint64) if x is key or x is content else x[done] for x in (key, content, ids, pos, windows)))
    key, content, ids, pos, windows = (x[~done] for x in (key, content, ids, pos, windows))
    key, content = key.view(np.uint64), content.view(np.uint64)
    gone = _later(key, content, ids, pos)
    i, p, w = _joined(ids[gone], pos[gone].astype(np.int64), windows[gone].astype(np.int64))
    yield _batch(_spread(i), np.zeros(len(i), np.uint64), i, p, -w)
    key, content, ids, pos, windows = (x[~gone] for x in (key, content, ids, pos, windows))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    several = same.copy()
    several[:-1] |= same[1:]
    at = order[several]
    # a repeated row of one document has equal content and is no second content
    yield _batch(key[at], content[at], ids[at], pos[at], windows[at])


CUT = "key long, id long, pos int, bytes binary"


def _cut(length: int):
    """(text, id, want: [(key, pos, windows)]) -> the bytes of the wanted segments."""
    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary())
            keys, ids, places, parts = [], [], [], []
            for t, i, want in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.as_py()
                for w in want:
                    keys.append(w["key"])
                    ids.append(i)
                    places.append(w["pos"])
                    parts.append(raw[w["pos"]: w["pos"] + w["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())],
                                             names=["key", "id", "pos", "bytes"])
    return run


def previous_factors(data: np.ndarray, end: np.ndarray, ids: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """Places of ``data`` whose ``length`` bytes also stand at an earlier (id, place).

    ``end`` is where the segment of each place ends; ``ids`` and ``pos`` are the place's document and offset in it.
    Suffixes are ranked by doubling, then ordered by (rank, id, offset).
    """
    n = len(data)
    rank = np.zeros(n, np.uint64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(8):
        rank = (rank << tc.U(8)) | wide[j: n + j]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    place = np.arange(n)
    have = 8
    while have < length:
        step = min(have, length - have)
        next_rank = np.zeros(n, np.uint64)
        next_rank[: n - step] = rank[step:]
        pair = rank * tc.U(n + 1) + next_rank
        have += step
        if have == length:
            place = np.flatnonzero(end - place >= length)
            pair = pair[place]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    order = np.lexsort((pos[place], ids[place], rank))
    r, d, s = rank[order], ids[place][order], pos[place][order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) if len(r) else order
    return place[order[(d != d[lead]) | (s != s[lead])]]


def _factors(length: int):
    """Segments, whole keys in one partition -> removed runs of windows."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by("key").combine_chunks()
        key, ids, pos = (np.asarray(rows[c]) for c in ("key", "id", "pos"))
        off = np.concatenate([[0], np.cumsum([len(x) for x in rows["bytes"].to_pylist()])])
        data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        heads = np.append(heads, len(key))
        lo = 0
        while lo < len(heads) - 1:
            hi = max(lo + 1, int(np.searchsorted(off[heads], off[heads[lo]] + ARRAY, "right")) - 1)
            a, b = heads[lo], heads[hi]
            size = np.diff(off[a: b + 1])
            base = off[a]
            first = off[a:b] - base
            end = np.repeat(off[a + 1: b + 1] - base, size)
            doc = np.repeat(ids[a:b], size)
            at = np.arange(off[b] - base) - np.repeat(first, size) + np.repeat(pos[a:b].astype(np.int64), size)
            found = previous_factors(data[base: off[b]], end, doc, at, length)
            i, p, w = _joined(doc[found], at[found], np.ones(len(found), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(p.astype(np.int32)), pa.array(w.astype(np.int32))], names=["id", "pos", "windows"])
            lo = hi
    return run


def removed_windows(src: DataFrame, length: int, tmp: Scratch) -> DataFrame:
    """(id, pos, windows): runs of window places of which each starts earlier too; ``src`` has (id, text)."""
    spark = src.sparkSession
    known = src.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    sketch = spark.sparkContext.broadcast(counts.merged(known.mapInArrow(_count(length), counts.ROWS)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known.rdd.getNumPartitions())
    grouped = tmp.put(known.mapInArrow(_deal(length, sketch), ROW).repartition(parts, "key").mapInArrow(_group, ROW))
    want = grouped.filter("windows > 0").groupBy("id").agg(F.collect_list(F.struct("key", "pos", "windows")).alias("want"))
    cut = (known.join(want, "id").select("text", "id", "want").mapInArrow(_cut(length), CUT)
           .repartition(parts, "key").mapInArrow(_factors(length), "id long, pos int, windows int"))
    gone = grouped.filter("windows < 0").select("id", "pos", (-F.col("windows")).alias("windows"))
    return gone.unionByName(cut)


OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(length: int):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            data, off, _ = tc.string_parts(b.column(1))
            out = []
            for k, spans in enumerate(b.column(2).to_pylist()):
                raw = data[off[k]: off[k + 1]].tobytes()
                kept, at, gone, number = hashlib.sha256(), 0, 0, 0
                last = -1
                for s in spans or ():
                    lo, hi = s["lo"], min(s["hi"], len(raw))
                    if lo >= hi:
                        continue
                    number += lo > last
                    kept.update(raw[at: max(at, lo)])
                    gone += hi - max(lo, at) if hi > at else 0
                    at = last = max(at, hi)
                kept.update(raw[at:])
                out.append((len(raw), gone, number, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([o[j] for o in out], schema.field(j + 1).type) for j in range(4))], schema=schema)
    return run


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, spans): the byte ranges to remove, sorted, of each document that loses any."""
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    tmp = Scratch(docs.sparkSession)
    runs = removed_windows(src, length, tmp)
    return runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos").alias("lo"), (F.col("pos") + F.col("windows") + (length - 1)).alias("hi")))).alias("spans"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    found = spans(docs, id_col, text_col, length)
    return (src.join(found, "id", "left").select("id", "text", "spans").mapInArrow(_digest(length), OUT)
            .withColumnRenamed("id", id_col))


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
