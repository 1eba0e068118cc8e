"""Exact k-nearest neighbours over any number of training rows (L11): k-d cells with bounds by boxes.

Fit. The rows collapse to prototypes: distinct vectors with their rows per class (or row count and label sum). A k-d tree over a bounded draw
of prototypes cuts the space into cells; every prototype is placed in its cell and packed into blocks. The blocks are a Parquet table; the
model holds the tree and, for each cell, the box around its prototypes and its number of rows.

Search, once for each distinct query vector. A query first searches the cell it falls in, which gives an upper bound for the distance of the
k-th neighbour (or, if the cell holds fewer than k rows, the boxes' greatest distances do). Then it visits exactly the
other cells whose box is within the bound. Visits are sorted by cell and packed, so one equi-join on the cell
pairs packs of queries with blocks of prototypes. A numpy step boxes a block again by a small k-d tree and takes the distances to the boxes within a
query's bound only, so the work for a query depends on its neighbourhood and hardly on the number of prototypes. Neighbours are summed by
distance before they are shuffled (k rows a query and block at most, and those at the last distance).

Prototypes at one distance (equal to nine decimals) stand together; those at the last distance within reach share the remaining places in proportion
to their rows, so results depend neither on an order nor on partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.session import cut_lineage, release

#: prototypes a cell is planned for, most cells that a model holds, drawn prototypes a cell, prototypes in a block, queries in a pack, prototypes in a box
CELL = 2048
MOST_CELLS = 4096
DRAWN = 16
BLOCK = 4096
PACK = 4096
BOX = 96
#: distances are compared with this slack, and are equal when they round to the same number of so many decimals
SLACK = 1e-6
DECIMALS = 9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of ``x`` and ``y``, summed feature by feature without cancellation."""
    d = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        a, b = x[:, f], y[:, f]
        if len(a) and len(b) and a.min() == a.max() == b.min() == b.max():
            continue
        d += (a[:, None] - b[None, :]) ** 2
    return np.sqrt(d)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


# --------------------------------------------------------------------------- index

def halved(x: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The widest feature of ``x[rows]`` and the value up to which about half the rows go left; None if the rows are equal."""
    part = x[rows]
    f = int((part.max(axis=0) - part.min(axis=0)).argmax())
    v = np.sort(part[:, f])
    if v[0] == v[-1]:
        return None
    cut = v[(len(v) - 1) // 2]
    return f, float(cut if cut < v[-1] else v[np.searchsorted(v, cut, "left") - 1])


def split(x: np.ndarray, parts: int) -> tuple[list[list[float]], int]:
    """A k-d tree over the rows of ``x`` with at most ``parts`` leaves: nodes (feature or -1, cut, left, right or leaf number)."""
    nodes: list[list[float]] = [[-1, 0.0, 0, 0]]
    todo, leaves = [(0, np.arange(len(x)), parts)], 0
    while todo:
        at, rows, n = todo.pop()
        found = halved(x, rows) if n > 1 and len(rows) > 1 else None
        if not found:
            nodes[at][3], leaves = leaves, leaves + 1
            continue
        goes = x[rows, found[0]] <= found[1]
        left = len(nodes)
        nodes[at] = [*found, left, left + 1]
        nodes += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
        todo += [(left, rows[goes], n - n // 2), (left + 1, rows[~goes], n // 2)]
    return nodes, leaves


def leaf_of(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf number of each row of ``x``."""
    feature, left, right = (nodes[:, j].astype(np.int64) for j in (0, 2, 3))
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return right[node]
        goes = x[rows, np.maximum(f, 0)] <= nodes[node, 1]
        node = np.where(inner, np.where(goes, left[node], right[node]), node)


def _assign(nodes: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cell = leaf_of(nodes, _rows(b.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), b.column(1)], names=["cell", "p", "w"])
    return run


def _by_cell(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The sorted batches cut where the cell changes and after ``most`` rows; small neighbours are joined first."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        cell = np.asarray(rows["cell"])
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, z in zip(edges, edges[1:]):
            for at in range(a, z, most):
                yield rows.slice(at, min(most, z - at)).combine_chunks().to_batches()[0]

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 16 * most:
            yield from cut(pa.Table.from_batches(held))
            held = []
    if sum(x.num_rows for x in held):
        yield from cut(pa.Table.from_batches(held))


BLOCKS = "cell int, lo array<double>, hi array<double>, points binary, rows binary, total double"


def _blocks(width: int, classes: int, kind: str):
    def run(batches):
        for b in _by_cell(batches, BLOCK):
            p, w = _rows(b.column(1), width), _rows(b.column(2), classes)
            total = float((w[:, 0] if kind == "regression" else w).sum())
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[0].as_py()], pa.int32()), pa.array([p.min(axis=0)], pa.list_(pa.float64())),
                                              pa.array([p.max(axis=0)], pa.list_(pa.float64())), pa.array([p.tobytes()], pa.binary()),
                                              pa.array([w.tobytes()], pa.binary()), pa.array([total])],
                                             names=["cell", "lo", "hi", "points", "rows", "total"])
    return run


# --------------------------------------------------------------------------- search

def to_boxes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: bool = False) -> np.ndarray:
    """Least (or greatest) distances between the rows of ``x`` and the boxes [lo, hi]."""
    d = np.zeros((len(x), len(lo)))
    for f in range(x.shape[1]):
        a, z = lo[None, :, f] - x[:, f, None], x[:, f, None] - hi[None, :, f]
        d += np.minimum(a, z) ** 2 if far else np.maximum(np.maximum(a, z), 0.0) ** 2
    return np.sqrt(d)


class Cells:
    """The tree, and for each cell the box around its prototypes and its rows."""

    def __init__(self, nodes, lo, hi, total):
        self.nodes = np.asarray(nodes, float).reshape(-1, 4)
        self.total = np.asarray(total, float)
        self.lo, self.hi = (np.asarray(v, float).reshape(len(self.total), -1) for v in (lo, hi))

    def reach(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each row of ``x`` a radius that holds k rows for certain (all rows if there are fewer)."""
        upper = np.where(self.total > 0, to_boxes(x, self.lo, self.hi, far=True), 0.0)
        order = np.argsort(upper, axis=1)
        enough = np.cumsum(self.total[order], axis=1) >= k
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), upper.shape[1] - 1)
        return np.take_along_axis(upper, order, axis=1)[np.arange(len(x)), last]

    def around(self, x: np.ndarray, bound: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells but a row's own that can hold a point within its bound."""
        near = np.flatnonzero((self.total > 0) & (np.maximum(np.maximum(self.lo - x.max(axis=0), x.min(axis=0) - self.hi), 0.0).max(axis=1) <= bound.max()))
        able = to_boxes(x, self.lo[near], self.hi[near]) <= bound[:, None]
        able &= near[None, :] != own[:, None]
        row, cell = np.nonzero(able)
        return row, near[cell]


VISIT = "q long, x array<double>, cell int, bound double"


def _own_cell(cells: Cells, width: int):
    def run(batches):
        for b in batches:
            own = leaf_of(cells.nodes, _rows(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(np.full(len(own), np.inf))],
                                             names=["q", "x", "cell", "bound"])
    return run


def _other_cells(cells: Cells, width: int, k: int):
    """Visits (q, x, cell, bound) of all cells but the first that can hold a point within the bound (null: the first holds fewer than k rows)."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x, bound = _rows(part.column(1), width), part.column(3).to_numpy(zero_copy_only=False).astype(float)
                open_ = np.isnan(bound)
                if open_.any():
                    bound[open_] = cells.reach(x[open_], k)
                bound = bound + SLACK
                row, cell = cells.around(x, bound, np.asarray(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(bound[row])],
                    names=["q", "x", "cell", "bound"])
    return run


PACKS = "cell int, q binary, x binary, bound binary"


def _pack(width: int):
    def run(batches):
        for b in _by_cell(batches, PACK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(2)[0].as_py()], pa.int32()),
                 *[pa.array([v.tobytes()], pa.binary()) for v in (np.asarray(b.column(0)), _rows(b.column(1), width), np.asarray(b.column(3)) + SLACK)]],
                names=["cell", "q", "x", "bound"])
    return run


def summed(q: np.ndarray, d: np.ndarray, w: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, d, summed rows) by query and ascending distance, of each query up to the distance that completes k rows."""
    order = np.lexsort((d, q))
    q, d, w, counts = q[order], d[order], w[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(d) > 0)])) if len(q) else np.zeros(0, np.int64)
    if not len(first):
        return q, d, w
    q, d, w, counts = q[first], d[first], np.add.reduceat(w, first), np.add.reduceat(counts, first)
    before = np.cumsum(counts) - counts
    starts = np.concatenate([[True], np.diff(q) != 0])
    keep = before - np.maximum.accumulate(np.where(starts, before, 0.0)) < k
    return q[keep], d[keep], w[keep]


def nearest(x: np.ndarray, bound: np.ndarray, points: np.ndarray, w: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, distance, summed rows) of the prototypes within the bounds, up to the distance that completes k rows. The
    points are boxed by a k-d tree; the box a row is nearest to gives a first bound, then the boxes within it are searched."""
    tree, n = split(points, -(-len(points) // BOX))
    leaf = leaf_of(np.asarray(tree, float), points)
    order = np.argsort(leaf, kind="stable")
    points, w, counts = points[order], w[order], counts[order]
    edge = np.searchsorted(leaf[order], np.arange(n + 1))
    lo, hi = (f.reduceat(points, edge[:-1]) for f in (np.minimum, np.maximum))
    bound = bound.copy()
    away = np.concatenate([to_boxes(x[at:at + 1024], lo, hi) for at in range(0, len(x), 1024)]) if len(x) else np.zeros((0, n))
    own = away.argmin(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(box: int, rows: np.ndarray, first: bool) -> None:
        a, z = edge[box], edge[box + 1]
        d = np.round(distances(x[rows], points[a:z]), DECIMALS)
        if first and z - a >= k:  # each prototype stands for one row at least
            bound[rows] = np.minimum(bound[rows], np.partition(d, k - 1, axis=1)[:, k - 1] + SLACK)
        r, c = np.nonzero(d <= bound[rows][:, None])
        out.append((rows[r], d[r, c], a + c))

    def by_box(box_of: np.ndarray, rows: np.ndarray, first: bool) -> None:
        sort = np.argsort(box_of, kind="stable")
        box_of, rows = box_of[sort], rows[sort]
        cuts = [0, *(np.flatnonzero(np.diff(box_of)) + 1).tolist(), len(box_of)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                take(int(box_of[a]), rows[a:z], first)

    by_box(own, np.arange(len(x)), True)
    able = away <= bound[:, None]
    able[np.arange(len(x)), own] = False
    rows, box = np.nonzero(able)
    by_box(box, rows, False)
    q, d, c = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, t) for j, t in enumerate((np.int64, float, np.int64)))
    inside = d <= bound[q]
    return summed(q[inside], d[inside], w[c[inside]], counts[c[inside]], k)


def _compare(width: int, classes: int, kind: str, k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}
                points, w = np.frombuffer(row["points"]).reshape(-1, width), np.frombuffer(row["rows"]).reshape(-1, classes)
                counts = w[:, 0] if kind == "regression" else w.sum(axis=1)
                qs = np.frombuffer(row["q"], np.int64)
                at, d, rows = nearest(np.frombuffer(row["x"]).reshape(-1, width), np.frombuffer(row["bound"]), points, w, counts, k)
                yield pa.RecordBatch.from_arrays([pa.array(qs[at]), pa.array(d), *[pa.array(rows[:, j]) for j in range(classes)]],
                                                 names=["q", "d", *[f"w{j}" for j in range(classes)]])
    return run


class KNNModel(Transformer, MLWritable, MLReadable):
    """The cells, and the table of prototype blocks (copied beside the model when it is saved)."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    kind = Param(Params._dummy(), "kind", "task kind", TypeConverters.toString)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "sums that a prototype has", TypeConverters.toInt)
    cells = Param(Params._dummy(), "cells", "tree, boxes and rows of the cells as JSON", TypeConverters.toString)
    path = Param(Params._dummy(), "path", "table of prototype blocks", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "input vector", TypeConverters.toString)

    def __init__(self, k: int = 5, kind: str = "binary", weights: str = "uniform", classes: int = 2, cells: str = "[[], [], [], []]",
                 path: str = "", featuresCol: str = "features"):
        super().__init__()
        self._set(k=k, kind=kind, weights=weights, classes=classes, cells=cells, path=path, featuresCol=featuresCol)

    def write(self) -> DefaultParamsWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _Reader(cls)

    def _search(self, visits: DataFrame, width: int) -> DataFrame:
        """(q, d, w0, w1, ...) of the visits (q, x, cell, d, bound): for each query and block, summed by distance."""
        g = self.getOrDefault
        spark = visits.sparkSession
        blocks = spark.read.schema(BLOCKS).parquet(g(self.path))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        # by range, so that a cell that very many queries visit is dealt over several tasks
        packs = visits.repartitionByRange(parts, "cell", "q").sortWithinPartitions("cell", "q").mapInArrow(_pack(width), PACKS)
        pairs = packs.join(blocks, "cell")
        found = ", ".join(["q long", "d double", *[f"w{j} double" for j in range(g(self.classes))]])
        return pairs.select("q", "x", "bound", "points", "rows").mapInArrow(_compare(width, g(self.classes), g(self.kind), g(self.k)), found)

    def _within_reach(self, near: DataFrame) -> DataFrame:
        """Sums by (query, distance) with ``before``, the rows that are nearer; up to the distance that completes k."""
        n = self.getOrDefault(self.classes)
        count = F.col("w0") if self.getOrDefault(self.kind) == "regression" else sum((F.col(f"w{j}") for j in range(1, n)), F.col("w0"))
        by = Window.partitionBy("q").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        return (near.groupBy("q", "d").agg(*[F.sum(f"w{j}").alias(f"w{j}") for j in range(n)]).withColumn("c", count)
                .withColumn("before", F.coalesce(F.sum("c").over(by), F.lit(0.0))).filter(F.col("before") < self.getOrDefault(self.k)))

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """``(q, agg)``: the summed rows of the k nearest, for queries ``(q long, x array<double>)`` with one row a q."""
        g = self.getOrDefault
        cells, k, n = Cells(*json.loads(g(self.cells))), g(self.k), g(self.classes)
        width = cells.lo.shape[1]
        own = cut_lineage(queries.select("q", "x").filter(~F.exists("x", F.isnan)).mapInArrow(_own_cell(cells, width), VISIT))
        first = cut_lineage(self._search(own, width))
        reached = self._within_reach(first).groupBy("q").agg(F.when(F.sum("c") >= k, F.max("d")).alias("kth"))
        bounded = own.join(reached, "q", "left").select("q", "x", "cell", F.col("kth").alias("bound")).sortWithinPartitions("cell")
        more = cut_lineage(bounded.mapInArrow(_other_cells(cells, width, k), VISIT))
        final = self._within_reach(first.unionByName(self._search(more, width)))
        share = F.least(k - F.col("before"), F.col("c")) / F.col("c")
        if g(self.weights) == "distance":  # inverse distance; a neighbour at distance zero leaves out all others
            nearest = F.min("d").over(Window.partitionBy("q"))
            share = share * F.when(nearest == 0.0, (F.col("d") == 0.0).cast("double")).otherwise(1.0 / F.col("d"))
        return final.withColumn("s", share).groupBy("q").agg(F.array(*[F.sum(F.col(f"w{j}") * F.col("s")) for j in range(n)]).alias("agg"))

    def _transform(self, df: DataFrame) -> DataFrame:
        g = self.getOrDefault
        vec, agg = "__knn_vec", F.col("__knn_agg")
        rows = df.withColumn(vec, vector_to_array(g(self.featuresCol)))
        # the result depends on a row only through its vector: each distinct one is searched once and joined back
        distinct = cut_lineage(rows.select(F.col(vec).alias("x")).distinct().withColumn("q", F.monotonically_increasing_id()))
        if distinct.limit(1).count():
            found = cut_lineage(distinct.join(self.neighbours(distinct), "q").select(F.col("x").alias(vec), F.col("agg").alias("__knn_agg")))
        else:
            found = distinct.select(F.col("x").alias(vec), F.lit(None).cast("array<double>").alias("__knn_agg"))
        out = rows.join(found, vec, "left")
        if g(self.kind) == "regression":
            return out.withColumn("prediction", agg[1] / agg[0]).drop(vec, "__knn_agg")
        total = F.aggregate(agg, F.lit(0.0), lambda s, v: s + v)
        return (out.withColumn("__knn_agg", F.transform(agg, lambda v: v / total))
                .withColumns({"probability": array_to_vector(agg), "prediction": (F.array_position(agg, F.array_max(agg)) - 1).cast("double")})
                .drop(vec, "__knn_agg"))


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        spark = SparkSession.getActiveSession()
        spark.read.schema(BLOCKS).parquet(self.instance.getOrDefault("path")).write.parquet(f"{path}/prototypes")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> KNNModel:
        model = super().load(path)
        model._set(path=f"{path}/prototypes")
        return model


class KNNEstimator(Estimator):
    """Fits on all labelled rows; their number is not bounded."""

    def __init__(self, k: int = 5, kind: str = "binary", n_classes: int = 2, weights: str = "uniform", featuresCol: str = "features",
                 labelCol: str = "label"):
        super().__init__()
        self.k_, self.kind_, self.n_classes, self.weights_, self.cols = k, kind, n_classes, weights, (featuresCol, labelCol)

    def _fit(self, df: DataFrame) -> KNNModel:
        rows = df.select(vector_to_array(self.cols[0]).alias("p"), F.col(self.cols[1]).cast("double").alias("y"))
        if self.kind_ == "regression":
            sums, classes = F.array(F.count(F.lit(1)).cast("double"), F.sum("y")), 2
        else:
            sums, classes = F.array(*[F.count_if(F.col("y") == float(i)).cast("double") for i in range(self.n_classes)]), self.n_classes
        # vectors without a known label say nothing
        protos = cut_lineage(rows.groupBy("p").agg(sums.alias("w")).filter(F.aggregate("w", F.lit(0.0), lambda a, v: a + F.abs(v)) > 0))
        n = protos.count()
        if not n:
            raise ValueError("k-nearest neighbours need at least one row")
        width = len(protos.first()["p"])
        # a vector with a missing value is near to none
        protos_ = protos.filter(~F.exists("p", F.isnan))
        parts = min(MOST_CELLS, -(-n // CELL))
        share = min(1.0, DRAWN * parts / n)  # a draw by hash, of about DRAWN vectors a cell: the same on every partitioning
        some = protos_ if share == 1.0 else protos_.filter(F.abs(F.xxhash64("p") % (1 << 30)) < int(share * (1 << 30)))
        drawn = np.asarray([r["p"] for r in some.select("p").orderBy("p").collect()], float).reshape(-1, width)
        nodes, leaves = split(drawn, parts) if len(drawn) else ([[-1, 0.0, 0, 0]], 1)
        spark = df.sparkSession
        parts = min(max(1, n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
        placed = protos_.mapInArrow(_assign(np.asarray(nodes, float), width), "cell int, p array<double>, w array<double>")
        blocks = cut_lineage(placed.repartitionByRange(parts, "cell", "p").sortWithinPartitions("cell", "p")
                             .mapInArrow(_blocks(width, classes, self.kind_), BLOCKS))
        release(protos)
        ends = [F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
        known = {r["cell"]: r for r in blocks.groupBy("cell").agg(*ends, F.sum("total").alias("n")).collect()}
        stats = [[known[i][c] if i in known else none for i in range(leaves)] for c, none in (("lo", [0.0] * width), ("hi", [0.0] * width), ("n", 0.0))]
        return KNNModel(self.k_, self.kind_, self.weights_, classes, json.dumps([nodes, *stats]), blocks._cut_path, self.cols[0])
