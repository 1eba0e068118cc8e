"""N-gram Jaccard join by a token-group matrix.

Two documents link when the Jaccard similarity of their sets of distinct word
shingles reaches a threshold (in percent, compared as integers). The operator
returns every document with the smallest id it can reach by links. It is exact:

1. One pass writes each document's set size, a 128-bit signature of the set and a
   coarse *token row*: which of ``COLUMNS`` hashed token columns its set touches.
   The same pass counts tokens in a fixed-size count sketch, merged in two levels.
2. A second pass emits, for each distinct set, its ``n - ceil(t n) + 1`` first tokens in the order
   (sketched count, hash), rarest first. Any two linked sets share one of these, whatever
   the order. Tokens that only one set emits are dropped after one shuffle; tokens the
   sketch knows to be hot are salted, so that none is gathered by one task.
3. Groups: each set is compared with the first holder of each of its tokens, then, where a token still
   joins several groups, with one holder picked by a hash of token and id. Both are
   linear in the rows. Verified links make groups of similar documents.
4. The matrix: documents whose tokens still join several groups are partitioned into families, each around the centre of
   the largest group it shares a token with. A family's row is the union of its members' token
   columns, plus the size range. For a query set Q that shares an emitted token with another family F, the number of Q's
   columns absent from F's row bounds |Q n F| from above; only families whose bound reaches the
   threshold are opened. In a family, its own members included, Q is compared with the pivot; what Q and a member do not share with it
   (see ``_within``) leaves the pairs that can link, which are bounded by their token columns and verified on the
   full sets. Pairs inside one group are never formed: they are connected already.

Nulls, empty texts and texts without words have empty sets and link with nothing. A null
id is never linked (its component is null). Repeated rows share their component. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import sketch as counts
from cohortlens.llm import textcols as tc
from cohortlens.llm.tables import Scratch, components, pick, table, union_all

LONGS = 32
COLUMNS = 64 * LONGS
#: sketched counts from which a token's entries are dealt over several tasks
HOT = 2048


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for c in tc.chunks(batches):
        low = tc.LOWER[c.data]
        start, end, first = tc.word_spans(low, c.off, tc.SPACE_WORDS)
        yield c, tc.shingles(tc.span_hashes(low, start, end), first, k)


def _token_row(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(COLUMNS, np.uint8)
    bits[(tokens & tc.U(COLUMNS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    return (int(tc.mix(tokens).sum(dtype=np.uint64).astype(np.int64)),
            int(tc.mix(tokens ^ tc.ODD).sum(dtype=np.uint64).astype(np.int64)))


PROFILE = "id long, n long, s1 long, s2 long, cols array<long>, block int, part int, counts binary"


def _profile(k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                        ("cols", pa.list_(pa.int64())), ("block", pa.int32()), ("part", pa.int32()),
                        ("counts", pa.binary())])

    def run(batches):
        sketch = counts.Counter()
        for c, sets in _sets(batches, k):
            sig = [_signature(s) for s in sets]
            rows = [_token_row(s) for s in sets]
            sketch.add(np.concatenate(sets))
            flat = pa.array(np.concatenate(rows))
            off = pa.array(np.arange(0, LONGS * len(sets) + 1, LONGS, dtype=np.int32))
            m = len(sets)
            yield pa.RecordBatch.from_arrays(
                [c.cols[0].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s[0] for s in sig], pa.int64()), pa.array([s[1] for s in sig], pa.int64()),
                 pa.ListArray.from_arrays(off, flat), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()),
                 pa.nulls(m, pa.binary())], schema=schema)
        rows = sketch.rows()
        m = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.list_(pa.int64())), pa.array([r[0] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=schema)

    return run


def _emit(k: int, pct: int, sketch, wanted):
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("id", pa.int64())])
    hot_from = int(counts.step(HOT))

    def run(batches):
        steps = sketch.value
        for c, sets in _sets(_some(batches, wanted), k):
            ids = c.cols[0].cast(pa.int64()).to_pylist()
            toks, owner = [], []
            for i, s in zip(ids, sets):
                n = len(s)
                if n and i is not None:
                    p = n - -(-pct * n // 100) + 1
                    step = steps[counts.cells(s)]
                    if p < n:
                        bound = np.partition(step, p - 1)[p - 1]
                        less = np.flatnonzero(step < bound)
                        ties = np.flatnonzero(step == bound)[: p - len(less)]  # ascending hashes
                        s = s[np.concatenate([less, ties])]
                    toks.append(s)
                    owner.append(np.full(len(s), i, np.int64))
            if toks:
                t, o = np.concatenate(toks), np.concatenate(owner)
                step = steps[counts.cells(t)].astype(np.int64)
                ways = np.where(step >= hot_from, np.exp2(np.maximum(step - hot_from, 0) / 8).astype(np.int64) * 4, 1)
                salt = (tc.mix(o.view(np.uint64)) % ways.astype(np.uint64)).astype(np.int32) + (ways > 1)
                yield pa.RecordBatch.from_arrays([pa.array(tc.signed(t)), pa.array(salt.astype(np.int32)), pa.array(o)], schema=schema)

    return run


#: bits of the broadcast filter of wanted ids (8 MB); false positives go in the joins that follow
ID_BITS = 26


def _id_filter(ids: DataFrame) -> np.ndarray:
    at = ids.select(F.expr(f"shiftrightunsigned(xxhash64(id), {64 - ID_BITS})").alias("b"))
    words = at.groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m"))
    out = np.zeros(1 << (ID_BITS - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["m"]
    return out


def _bit_row(tokens: np.ndarray) -> bytes:
    """The size of the set, and which of four to eight times as many hashed columns (a power of two) it touches."""
    bits = np.zeros(max(8, 4 << max(0, len(tokens) - 1).bit_length()), np.uint8)
    bits[(tokens & tc.U(len(bits) - 1)).astype(np.int64)] = 1
    return len(tokens).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def _some(batches: Iterator[pa.RecordBatch], wanted):
    """(id, text) of the rows (id, text, h) whose id the filter has."""
    bits = wanted.value.view(np.uint64)
    for b in batches:
        at = np.asarray(b.column(2)).view(np.uint64) >> tc.U(64 - ID_BITS)
        ok = (bits[(at >> tc.U(6)).astype(np.int64)] >> (at & tc.U(63))) & tc.U(1)
        yield b.select([0, 1]).filter(pa.array(ok.astype(bool)))


def _marked(src: DataFrame, ids: DataFrame):
    """The rows with an id as ``_some`` reads them, and the broadcast filter of the wanted ``ids``."""
    return src.filter("id is not null").withColumn("h", F.xxhash64("id")), src.sparkSession.sparkContext.broadcast(_id_filter(ids))


def _full_sets(k: int, wanted, write=np.ndarray.tobytes):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for c, sets in _sets(_some(batches, wanted), k):
            yield pa.RecordBatch.from_arrays([c.cols[0].cast(pa.int64()), pa.array([write(s) for s in sets], pa.binary())], schema=schema)

    return run


def _sets_of(src: DataFrame, ids: DataFrame, k: int, write=np.ndarray.tobytes) -> DataFrame:
    """(id, tokens) of the texts with these ids, and of few others; the texts are read where they lie, nothing is shuffled."""
    marked, wanted = _marked(src, ids)
    return marked.mapInArrow(_full_sets(k, wanted, write), "id long, tokens binary")


def _one_each(sets: DataFrame) -> DataFrame:
    """One set of each id: dealt by id, so that a join with it shuffles the sets no second time."""
    return sets.groupBy("id").agg(F.max("tokens").alias("tokens"))


def _linked(pct: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * inter >= pct * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _able(pct: int):
    """The pairs whose bit rows leave an overlap possible that reaches the threshold; the longer row is folded to the other's length.
    Without a row (the texts of one id differ) a pair stays."""
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if x is None or y is None:
                    keep.append(True)
                    continue
                nx, ny = (int.from_bytes(r[:8], "little") for r in (x, y))
                p, q = (np.frombuffer(r, np.uint8, offset=8) for r in (x, y))
                few = min(len(p), len(q))
                p, q = (np.bitwise_or.reduce(r.reshape(-1, few)) for r in (p, q))
                both = min(nx - int(np.bitwise_count(p & ~q).sum()), ny - int(np.bitwise_count(q & ~p).sum()))
                keep.append((100 + pct) * both >= pct * (nx + ny))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _possible(pairs: DataFrame, rows: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that bit rows as long as the sets don't rule out; the rows take a tenth of what the sets take."""
    rows = rows.groupBy("id").agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).select("id", F.expr("if(lo = hi, hi, null)").alias("r"))
    left = rows.select(F.col("id").alias("a"), F.col("r").alias("ra"))
    right = rows.select(F.col("id").alias("b"), F.col("r").alias("rb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
            .mapInArrow(_able(pct), "a long, b long"))


def _absent(x: str, y: str):
    """How many token columns of ``x`` are not in the row ``y``."""
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)")


def _verify(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    sets = _one_each(sets)
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_linked(pct), "a long, b long"))


#: documents in a family up to which they are paired with a query directly
FEW = 32

RELATION = "id long, f long, label long, n long, own boolean, linked boolean, e long, private array<long>, missing array<long>, " \
    "e0 long, e1 long, e2 long, e3 long"


def _most(n: int, pct: int) -> tuple[int, int]:
    """Of the elements in which a document of ``n`` shingles differs from a pivot, how many that lie first in one order must hold
    one in common with any linked document: if that differs in no fewer elements, and if it does not."""
    apart = (100 - pct) * (100 * n // pct + n) // (100 + pct)  # a linked one has 100 n / pct shingles at most
    return apart // 2 + 1, apart + 1


def _relate(pct: int):
    """How a document differs from a family's pivot: tokens that the pivot lacks (``private``) and, as far as they can be needed, tokens that
    it lacks (``missing``, in the order of their hash); ``label`` is the pivot's group if they link, else the document's own."""
    def run(batches):
        for b in batches:
            rows = []
            for i, f, g, gf, own, x, y in zip(*(c.to_pylist() for c in b.columns)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.isin(p, q, assume_unique=True)
                inter = int(both.sum())
                linked = 100 * inter >= pct * (len(p) + len(q) - inter)
                private = p[~both]
                lacks = np.setdiff1d(q, p, assume_unique=True)
                apart = np.concatenate([private, lacks])
                bits = np.zeros(256, np.uint8)
                bits[(apart & tc.U(255)).astype(np.int64)] = 1
                lacks = lacks[np.argsort(tc.mix(lacks))][: max(0, _most(len(p), pct)[1] - len(private))]
                rows.append((i, f, gf if linked else g, len(p), own, linked, len(apart), tc.signed(private), tc.signed(lacks),
                             *np.packbits(bits, bitorder="little").view(np.int64).tolist()))
            kinds = [*[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)],
                                             names=["id", "f", "label", "n", "own", "linked", "e", "private", "missing", "e0", "e1", "e2", "e3"])
    return run


def _sides(cols: list[str], of: DataFrame, tag: str) -> DataFrame:
    return of.select("f", *[F.col(c).alias(f"{c}_{tag}") for c in cols])


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _few(asks: DataFrame, family: DataFrame) -> DataFrame:
    """The pairs (a, b) of a query and a member of a small family, of different groups."""
    few = asks.filter("not large")
    own = few.join(family.select("id", "f"), ["id", "f"], "left_semi")
    return _pairs(_sides(["id", "g"], few, "x").join(_sides(["id", "g"], own, "y"), "f").filter("g_x <> g_y"))


def _within(relation: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) of one large family, of different groups, that can reach the threshold.

    Let E(x) be what x and the pivot do not share, private to x or missing in it. Two documents link if and only if they differ in c (n_x + n_y)
    tokens at most, c = (100 - pct) / (100 + pct), and they differ in |E(x)| + |E(y)| - 2 |E(x) n E(y)|. If |E(x)| + |E(y)| is no
    more than that, both link with the pivot and have its label. All other pairs must share elements of E, so each document is found by the
    first of them (private ones first, the rarest of the family before the others): ``_most`` says how many suffice. What may follow the shared one, and a row
    of 256 bits of E, then bound the shared elements from above.
    """
    doc = ["f", "id", "label", "n", "own", "e"]
    row = ["e0", "e1", "e2", "e3"]
    private = relation.select("f", "id", F.explode("private").alias("t"))
    often = private.groupBy("f", "t").agg(F.count("*").alias("c"))
    last = relation.select("f", "id", F.posexplode("missing").alias("k", "t"))
    ordered = (private.join(often, ["f", "t"]).select("f", "id", "t", "c", F.xxhash64("t").alias("k"))
               .unionByName(last.select("f", "id", "t", F.lit(1 << 62).alias("c"), F.col("k").cast("long").alias("k")))
               .withColumn("pos", F.row_number().over(Window.partitionBy("f", "id").orderBy("c", "k", "t"))).drop("c", "k"))
    apart = f"{100 - pct} * (100 * n div {pct} + n) div {100 + pct}"
    entry = ordered.join(relation.select(*doc, *row), ["f", "id"]).filter(f"pos <= {apart} + 1")
    cols = [*doc[1:], *row, "pos", "t"]
    x = _sides(cols, entry.filter(f"pos <= {apart} div 2 + 1"), "x").withColumnRenamed("t_x", "t")
    y = _sides(cols, entry, "y").withColumnRenamed("t_y", "t")

    def own(p: str, q: str) -> str:
        """A bound of the elements of E(p) that E(q) has."""
        return f"e_{p} - (" + " + ".join(f"bit_count({e}_{p} & ~{e}_{q})" for e in row) + ")"

    shared = f"least(e_x - pos_x + 1, e_y - pos_y + 1, {own('x', 'y')}, {own('y', 'x')})"
    return _pairs(x.join(y, ["f", "t"]).filter(
        "label_x <> label_y and (own_x or own_y) and (e_x < e_y or e_x = e_y and id_x < id_y)"
        f" and 100 * least(n_x, n_y) >= {pct} * greatest(n_x, n_y)"
        f" and {2 * (100 + pct)} * {shared} >= {100 + pct} * (e_x + e_y) - {100 - pct} * (n_x + n_y)"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       pct: int = 80) -> DataFrame:
    """Rows ``(id_col, n_shingles, component_id)``, one for each row of ``docs``."""
    spark = docs.sparkSession
    tmp = Scratch(spark)
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    profile = tmp.put(src.mapInArrow(_profile(k), PROFILE))
    rows = profile.filter("block is null").select("id", "n", "s1", "s2", "cols")
    sketch = spark.sparkContext.broadcast(counts.merged(profile.filter("block is not null")))

    # a repeated id stands for one node; of several texts the one with the largest (size, signature) counts
    nodes = rows.filter("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "s1", "s2", "cols")).alias("v")).select("id", "v.*")
    # documents with equal sets are linked with the first of them, and only that one goes on
    first = nodes.groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "cols")).alias("v")).select(F.col("v.id").alias("id"), "n", "s1", "s2", F.col("v.cols").alias("cols"))
    reps = tmp.put(first)
    known = rows.filter("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "s1", "s2")).alias("v")).select("id", "v.*")
    member = known.join(reps.select(F.col("id").alias("rep"), "n", "s1", "s2"), ["n", "s1", "s2"]).select("id", "rep")
    equal = tmp.put(member)
    # tables go as soon as no later step reads them: token rows and columns are most of what lies on disk
    sizes = tmp.put(rows.select("id", "n"))
    tmp.drop(profile)
    tmp.sweep()

    # of documents with equal sets only the first emits tokens; the join drops what the filter of ids lets pass by chance
    firsts = equal.filter("id = rep").select("id")
    marked, wanted = _marked(src, firsts)
    emitted = marked.mapInArrow(_emit(k, pct, sketch, wanted), "token long, salt int, id long")
    held = emitted.withColumn("r", F.expr("count(*) over (partition by token, salt)"))
    shared = tmp.put(held.filter("r > 1 or salt > 0").select("token", "id")
                     .join(firsts, "id", "left_semi").distinct())

    tmp.sweep()
    # groups: every set against the first holder of each of its tokens
    lead = shared.groupBy("token").agg(F.min("id").alias("b"), F.count("*").alias("r")).filter("r > 1").select("token", "b")
    star = shared.withColumnRenamed("id", "a").join(lead, "token").filter("a <> b").select("a", "b").distinct()
    sized = reps.select("id", "n", "cols")

    def bounded(pairs: DataFrame) -> DataFrame:
        x = sized.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("cols").alias("ca"))
        y = sized.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("cols").alias("cb"))
        fit = F.expr(f"100 * least(na, nb) >= {pct} * greatest(na, nb)")
        both = F.least(F.col("na") - _absent("ca", "cb"), F.col("nb") - _absent("cb", "ca"))
        return (pairs.join(x, "a").join(y, "b").filter(fit)
                .filter((100 + pct) * both >= pct * (F.col("na") + F.col("nb"))).select("a", "b"))

    def checked(pairs: DataFrame) -> DataFrame:
        """The links among the written ``pairs``. Sets and bit rows are made from the texts anew, so none lies on disk but while it is shuffled."""
        left = tmp.put(_possible(pairs, _sets_of(src, _ends(pairs), k, _bit_row), pct))
        tmp.drop(pairs)
        tmp.sweep()
        out = tmp.put(_verify(left, _sets_of(src, _ends(left), k), pct))
        tmp.drop(left)
        tmp.sweep()
        return out

    first_near = checked(tmp.put(bounded(star)))

    def grouped(links: DataFrame) -> DataFrame:
        comp = components(links, tmp).withColumnRenamed("node", "id")
        return tmp.put(reps.select("id").join(comp, "id", "left").select("id", F.coalesce("comp", "id").alias("g")))

    def across(entries: DataFrame, group: DataFrame) -> DataFrame:
        """Entries of the tokens that occur in several groups."""
        entry = entries.join(group, "id")
        several = entry.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("token")
        return tmp.put(entry.join(several, "token").select("token", "id", "g"))

    between = across(shared, grouped(first_near))
    tmp.drop(shared)
    tmp.sweep()
    lead = between.groupBy("token").agg(F.min_by(F.struct("id", "g"), F.xxhash64("token", "id")).alias("v")).select("token", F.col("v.id").alias("b"), F.col("v.g").alias("gb"))
    star = between.join(lead, "token").filter("g <> gb").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    pairs = tmp.put(bounded(star))
    tmp.sweep()
    second_near = checked(pairs)
    near = first_near.unionByName(second_near)
    group = grouped(near)

    open_entries = across(between.select("token", "id"), group)
    tmp.drop(between)
    tmp.sweep()

    # families: each document joins the centre (most links) of the largest group it shares an open token with
    degree = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("d"))
    centre = (group.join(degree, "id", "left").groupBy("g").agg(
        F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-F.col("id")).alias("m"))).alias("v"), F.count("*").alias("size"))
        .select("g", "size", F.col("v.m").alias("m")))
    by_token = open_entries.join(centre, "g").groupBy("token").agg(F.max(F.struct("size", "m")).alias("p"))
    family = tmp.put(open_entries.join(by_token, "token").groupBy("id", "g").agg(F.max("p").alias("p"))
                     .select("id", "g", (-F.col("p.m")).alias("f")))

    # the matrix: (token, family), and each family's union of token columns; a document asks the families it shares
    # tokens with, and those whose bound it reaches are opened
    entries = open_entries.select("token", "id").join(family, "id")
    matrix = entries.select("token", F.col("f").alias("other")).distinct()
    asked = entries.join(matrix, "token").filter("f > other").select("id", "other").distinct()
    held = sized.join(family, "id")
    longs = held.select("f", "n", F.posexplode("cols").alias("pos", "w"))
    union = (longs.groupBy("f", "pos").agg(F.bit_or("w").alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi"))
             .groupBy("f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("row"))
             .select(F.col("f").alias("other"), "lo", "hi", F.expr("transform(row, x -> x.w)").alias("row")))
    opened = (asked.join(sized.select("id", "n", "cols"), "id").join(union, "other")
              .filter(F.expr(f"100 * hi >= {pct} * n and 100 * n >= {pct} * lo"))
              .filter(100 * (F.col("n") - _absent("cols", "row")) >= pct * F.greatest("n", "lo"))
              .select("id", F.col("other").alias("f")))
    size = family.groupBy("f").agg((F.count("*") > FEW).alias("large"))
    asks = tmp.put(family.select("id", "f", F.lit(True).alias("own")).unionByName(opened.select("id", "f", F.lit(False).alias("own"))).join(size, "f")
                   .join(group.select("id", "g"), "id").join(group.select(F.col("id").alias("f"), F.col("g").alias("gf")), "f"))
    tmp.drop(open_entries)
    tmp.sweep()
    # small families are paired directly; only large ones need what their members share with the pivot
    near_by = tmp.put(bounded(_few(asks, family)))
    tmp.sweep()
    large = tmp.put(asks.filter("large").drop("large"))
    tmp.drop(asks)
    links = [near, equal.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))]
    some = large.limit(1).count()
    if some:
        one = _one_each(_sets_of(src, large.select("id").unionByName(large.select(F.col("f").alias("id"))).distinct(), k))
        relation = tmp.put(large.join(one, "id").join(one.select(F.col("id").alias("f"), F.col("tokens").alias("pivot")), "f")
                           .select("id", "f", "g", "gf", "own", "tokens", "pivot").mapInArrow(_relate(pct), RELATION))
        tmp.sweep()
        links.append(tmp.put(relation.filter("linked and id <> f").select(F.col("id").alias("a"), F.col("f").alias("b"))))
        within = tmp.put(bounded(_within(relation, pct)))
        tmp.drop(relation)
        tmp.sweep()
        links.append(checked(within))
    if near_by.limit(1).count():
        links.append(checked(near_by))
    else:
        tmp.drop(near_by)
    tmp.drop(large)
    final = components(union_all(links), tmp)
    out = (sizes.join(final.withColumnRenamed("node", "id"), "id", "left")
           .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")))
    tmp.drop(family, reps, equal, first_near, second_near)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns stay."""
    comp = jaccard_components(docs, id_col, text_col, k, pct)
    later = comp.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__later")).distinct()
    return docs.join(later, docs[id_col].cast("long") == later["__later"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
