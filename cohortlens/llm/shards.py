"""Byte-balanced sharding by Karmarkar-Karp differencing.

Rows of equal text are one indivisible group; a row weighs its text's UTF-8 bytes plus ``overhead``. A partial
partition is a tuple of shard sums. The differencing method keeps all partial partitions in a heap by their
spread (largest minus smallest sum), takes the two with the largest spread, and adds them in
opposite order, until one is left. It runs in two or more levels, so that no task holds all groups:

1. Rows are combined to one row per distinct text (map-side, so a hot group is one row early). Groups are dealt by hash
   over buckets of about ``BUCKET`` groups; each bucket is differenced in its own task.
   A group of at least the mean of the shards that are left gets a shard of its own first: no law can make
   that shard smaller, and the others are balanced without it (at most one such group a shard, found by a top-k).
2. Bucket results are again partial partitions of the same form, up to ``FAN_IN`` of which are combined by
   one task a level, until one is left. Each level hands down where every bucket's shard goes, so a group's
   shard is found by following these small tables.

Slots: rows are dealt by a hash of their id over partitions and numbered within (partition, shard); offsets are running
sums of a table of partitions x shards counts.

A null text weighs ``overhead``; null texts form one group, apart from the empty text. Repeated rows are rows like
others; with an empty table nothing is returned. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import Scratch, pick, table

SHARDS = 40
OVERHEAD = 16
BUCKET = 20_000
FAN_IN = 256


def difference(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (descending sums): the final sums, and for each part its slots' shards.

    The result's second array has a row a part: entry j is the final place of the part's j-th sum.
    """
    width = len(parts[0])
    heap = [(-int(p[0] - p[-1]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    sums = list(parts)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        made.append((a, b, order))
        sums.append(total[order])
        sums[a] = sums[b] = None
        new = len(sums) - 1
        heapq.heappush(heap, (-int(sums[new][0] - sums[new][-1]), new))
    place: list[np.ndarray | None] = [None] * len(sums)
    place[-1] = np.arange(width)
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        at = np.empty(width, np.int64)
        at[order] = place[len(parts) + k]  # where the j-th unsorted sum ends up
        place[a], place[b] = at, at[::-1]
    return sums[-1], np.array(place[: len(parts)])


def _single(size: int, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    out[0] = size
    return out


def _bucket(width: int):
    """Groups of one bucket -> the shard of each, and the bucket's sums (``key`` null)."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bytes", "descending"), ("key", "ascending")])
        size = rows["bytes"].to_pylist()
        sums, place = difference([_single(s, width) for s in size])
        n = len(size)
        return pa.table({
            "bucket": pa.array([rows["bucket"][0].as_py()] * (n + 1), pa.int64()),
            "key": pa.array([*rows["key"].to_pylist(), None], pa.string()),
            "place": pa.array([*place[:, 0].tolist(), None], pa.int32()),
            "sums": pa.array([None] * n + [sums.tolist()], pa.list_(pa.int64()))})
    return run


def _combine(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("node")
    sums, place = difference([np.array(s, np.int64) for s in rows["sums"].to_pylist()])
    n = rows.num_rows
    return pa.table({
        "up": pa.array([rows["up"][0].as_py()] * (n + 1), pa.int64()),
        "node": pa.array([*rows["node"].to_pylist(), None], pa.int64()),
        "places": pa.array([*place.tolist(), None], pa.list_(pa.int32())),
        "sums": pa.array([None] * n + [sums.tolist()], pa.list_(pa.int64()))})


def _group_shards(groups: DataFrame, shards: int, tmp: Scratch) -> DataFrame:
    """(key, shard) for ``groups(key, bytes)``."""
    n = groups.count()
    buckets = max(1, -(-n // BUCKET))
    dealt = groups.withColumn("bucket", F.expr(f"pmod(xxhash64(key), {buckets})"))
    first = tmp.put(dealt.groupBy("bucket").applyInArrow(_bucket(shards), "bucket long, key string, place int, sums array<long>"))
    at = first.filter("key is not null").select("key", F.col("bucket").alias("node"), "place")
    nodes = first.filter("key is null").select(F.col("bucket").alias("node"), "sums")
    path = None  # node of the lowest level -> node above, and the places of its sums there
    count = buckets
    while count > 1 or path is None:
        up = nodes.withColumn("up", F.expr(f"node div {FAN_IN}"))
        level = tmp.put(up.groupBy("up").applyInArrow(_combine, "up long, node long, places array<int>, sums array<long>"))
        step = level.filter("node is not null").select("node", "up", "places")
        if path is None:
            path = step.select(F.col("node").alias("leaf"), "up", "places")
        else:
            path = path.withColumnRenamed("up", "node").withColumnRenamed("places", "below").join(step, "node").select(
                "leaf", "up", F.expr("transform(below, p -> places[p])").alias("places"))
        nodes = level.filter("node is null").select(F.col("up").alias("node"), "sums")
        count = -(-count // FAN_IN)
    return (at.join(path, at["node"] == path["leaf"])
            .select("key", F.expr("places[place]").alias("shard")))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          overhead: int = OVERHEAD) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``bytes``."""
    spark = docs.sparkSession
    tmp = Scratch(spark)
    rows = tmp.put(pick(docs, id=id_col, text=text_col).select(
        "id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("key"))
        .withColumn("size", F.col("bytes") + overhead).drop("bytes"))
    groups = tmp.put(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    total, left, alone = groups.agg(F.sum("bytes")).first()[0] or 0, shards, []
    for g in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left == 1 or g["bytes"] * left < total:
            break
        left -= 1
        total -= g["bytes"]
        alone.append((g["key"], left))
    single = spark.createDataFrame(alone, "key string, shard int")
    rest = groups.join(F.broadcast(single), "key", "left_anti")
    shard_of = _group_shards(rest, left, tmp).unionByName(single)
    placed = rows.join(shard_of, "key").select("id", "size", "text_crc32", "shard")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tmp.put(placed.withColumn("part", F.expr(f"pmod(xxhash64(id, text_crc32), {8 * parts})")))
    held = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    # one row for each part and shard: no more rows than parts
    before = held.withColumn("before", F.expr("sum(n) over (partition by shard order by part) - n")).select("shard", "part", "before")
    slot = F.expr("row_number() over (partition by part, shard order by id, text_crc32) - 1")
    return (dealt.withColumn("at", slot).join(before, ["part", "shard"])
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"),
                    F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("at")).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
