"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items go into one suffix automaton (items are kept apart
by separators that no document has). Training words then stream through it: the current
state and match length are the longest run of words, ending here, that some item contains.
A run of ``window`` words or more is a hit; an item of fewer words is a hit where the whole item
occurs. The states also tell which items own a hit window.

Documents are never shuffled: the automaton is broadcast and the texts are scanned where they
lie. The broadcast is bounded by ``BLOCK_WORDS``: more test words than that are dealt into blocks of items,
and the scan runs once a block, adding to each document's spans. Only runs of known word pairs reach the automaton; the
pair test is a sorted 64-bit hash table, so it skips nothing that could match.

Null or empty texts and texts without words have no words and no hits. Items without words match
nothing; repeated items count once for each id. Rows are independent, so repeated rows and extra columns
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import pick, ship, table

#: words of test items in one broadcast automaton (about 0.5 KB a word)
BLOCK_WORDS = 500_000

WORD = np.zeros(256, np.uint8)
WORD[0x30:0x3A] = 1
WORD[0x61:0x7B] = 1
WORD[0x80:] = 1


def hashed_words(data: np.ndarray, off: np.ndarray):
    low = tc.LOWER[data]
    start, end, first = tc.word_spans(low, off, WORD)
    return tc.span_hashes(low, start, end), start, end, first


class Automaton:
    """Suffix automaton over integer words, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for sep, (_, words) in enumerate(items):
            for w in words:
                last = self._extend(last, w)
            last = self._extend(last, -1 - sep)
        self.owners: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            if len(words) < window:
                if words:
                    short.setdefault(self._walk(words), []).append((len(words), name))
            else:
                for i in range(len(words) - window + 1):
                    self.owners.setdefault(self._walk(words[i: i + window]), set()).add(name)
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                own = short.get(v, []) + self.short.get(self.link[v], [])
                if own:
                    self.short[v] = own
        sizes = [len(w) for _, w in items if w]
        self.least = min([window, *sizes])
        words = [np.array(w, np.int64).view(np.uint64) for _, w in items if w]
        pairs = [_pairs(w) for w in words] if self.least > 1 else words
        self.known = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)

    def _extend(self, last: int, w: int) -> int:
        cur = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.link)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p != -1 and self.next[p].get(w) == q:
                    self.next[p][w] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        return cur

    def _walk(self, words: list[int]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v

    def hits(self, words: list[int], names: set[str]) -> list[tuple[int, int]]:
        """Maximal hit runs [from, to) in ``words``; adds the owners of their windows to ``names``."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        out: list[list[int]] = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                size = length[v]
            v = nxt[v].get(w, 0)
            size = size + 1 if v else 0
            lo = i + 1
            if size >= window:
                lo = i + 1 - size
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                names.update(self.owners[u])
            for n, name in self.short.get(v, ()):
                if n <= size:
                    lo = min(lo, i + 1 - n)
                    names.add(name)
            if lo <= i:
                while out and out[-1][1] >= lo:
                    lo = min(lo, out.pop()[0])
                out.append([lo, i + 1])
        return [(a, b) for a, b in out]


def _pairs(h: np.ndarray) -> np.ndarray:
    return tc.mix(h[:-1] * tc.ODD + h[1:])


def _runs(known: np.ndarray, h: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Word ranges of one document each in which every word (or pair of words) is known, of ``least`` words or more."""
    keys = _pairs(h) if least > 1 else h
    if not len(keys) or not len(known):
        return []
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    ok = known[at] == keys
    wide = 1 if least > 1 else 0
    ends = first[1:-1]
    if wide:  # no pair spans two documents
        cut = ends[(ends > 0) & (ends <= len(keys))] - 1
        ok[cut] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2] + wide
    if wide:
        keep = hi - lo >= least
        return list(zip(lo[keep].tolist(), hi[keep].tolist()))
    out = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        cuts = ends[(ends > a) & (ends < b)].tolist()
        out += list(zip([a, *cuts], [*cuts, b]))
    return out


SPANS = "array<struct<lo:int,hi:int,first:int,last:int>>"


def _maximal(spans: list[dict]) -> list[dict]:
    """Spans (bytes [lo, hi), words [first, last)) joined where they overlap or touch."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], "hi": s["hi"]}
        else:
            out.append(dict(s))
    return out


def _scan(model):
    spans_t = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))
    names = ["row", "text", "n_words", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]):
        m: Automaton = model.value
        for c in tc.chunks(batches):
            h, start, end, first = hashed_words(c.data, c.off)
            had_spans, had_items = c.cols[1].to_pylist(), c.cols[2].to_pylist()
            spans = [list(x or []) for x in had_spans]
            items = [set(x or []) for x in had_items]
            for a, b in _runs(m.known, h, first, m.least):
                d = int(np.searchsorted(first, a, "right")) - 1
                for lo, hi in m.hits(tc.signed(h[a:b]).tolist(), items[d]):
                    base, word = int(c.off[d]), a - int(first[d])
                    spans[d].append({"lo": int(start[a + lo]) - base, "hi": int(end[a + hi - 1]) - base,
                                     "first": word + lo, "last": word + hi})
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(c.off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(c.data))]) if len(c.data) else pa.array([b""] * len(c), pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [c.cols[0], text.cast(pa.large_string()).cast(pa.string()), pa.array(np.diff(first), pa.int64()),
                 pa.array([_maximal(x) if x else x for x in spans], spans_t), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=names)

    return run


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Automaton]:
    """One automaton for each block of items; items are read from Spark block by block."""
    src = pick(bench, item=id_col, text=text_col).select(F.col("item").cast("string"), F.col("text").cast("string"))
    src = src.filter("item is not null and text is not null")
    # a word is a byte or more, so bytes / 2 bounds the words
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * BLOCK_WORDS)))
    for b in range(n):
        part = src.filter(F.expr(f"pmod(xxhash64(item), {n}) = {b}")) if n > 1 else src
        items = []
        for r in part.distinct().orderBy("item", "text").toLocalIterator():
            raw = np.frombuffer(r["text"].encode(), np.uint8)
            h = hashed_words(raw, np.array([0, len(raw)]))[0]
            items.append((r["item"], tc.signed(h).tolist()))
        yield Automaton(items, window)


def find_hits(rows: DataFrame, bench: DataFrame, window: int = 10, item_col: str = "item_id",
              item_text: str = "text") -> DataFrame:
    """``rows(row, text)`` with n_words, spans (byte ranges of maximal hit runs and their words) and items."""
    spark = rows.sparkSession
    ship(spark)
    out = rows.select("row", F.col("text").cast("string").alias("text"),
                      F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    for m in _blocks(bench, item_col, item_text, window):
        model = spark.sparkContext.broadcast(m)
        scan = _scan(model)
        out = out.select("row", "spans", "items", "text").mapInArrow(scan, schema)
    return out


def _hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"]))


def _cut(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        texts = []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw, at, keep = t.encode(), 0, []
            for s in sorted(spans, key=lambda s: s["lo"]):
                keep.append(raw[at: max(at, s["lo"])])
                at = max(at, s["hi"])
            texts.append(b"".join([*keep, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 10,
                  max_share: float = 0.5) -> DataFrame:
    """``docs`` with hit spans cut out of the text; rows in which hits exceed ``max_share`` of the words go.

    Rows without hits come back unchanged (a null text stays null).
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = find_hits(rows, bench, window)
    judged = found.withColumn("hit", _hit_words()).filter((F.col("hit") == 0) | (F.col("hit") <= max_share * F.col("n_words")))
    clean = judged.filter("hit = 0").select("row.*")
    cut = (judged.filter("hit > 0").select("row", "text", "spans")
           .mapInArrow(_cut, judged.select("row", "text").schema)
           .select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
    return clean.unionByName(cut)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = 10) -> DataFrame:
    """The digest of each row: words, hit words, items with a hit window, and whether there is any."""
    found = find_hits(pick(docs, row=id_col, text=text_col), bench, window)
    hit = _hit_words()
    names = F.array_sort("items")
    return found.select(
        F.col("row").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
