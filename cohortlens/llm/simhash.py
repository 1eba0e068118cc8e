"""SimHash near duplicates by segments with one wildcard.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set. Fingerprints link if they differ in at
most two bits; the operator returns each document's fingerprint and the smallest id it reaches by links. It is exact:

1. Distinct fingerprints, each with its smallest id, go on; copies are never paired.
2. A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two bits, one of the two segments differs in at most one.
   Each segment is indexed as it is and with each of its bits deleted (a wildcard): 33 signatures a segment, each one integer.
   Equal signatures meet in one aggregation that combines in the tasks first: count, least and greatest fingerprint.
3. A signature that two fingerprints share proposes that pair, which is verified by counting its differing bits.
4. Signatures that more than two share may be shared by very many (families of near copies), so no pairs are formed there. Their
   members are indexed again by the same variants of the whole fingerprint as one segment: itself and each of its 64 one-bit changes. Two of
   them meet at such a place exactly if they differ in at most two bits, at most 65 fingerprints meet at one place, and
   each is linked with the least there. Every linked pair shares a signature, of two or of more, so none is lost.

Rows are 66 a fingerprint, 65 more for members of step 4, whatever the sizes of the groups.

Results for special inputs: a null or empty text and one without words has fingerprint zero, which links like any other; with fewer words than
a shingle has the whole sequence is the one shingle; a null id has a fingerprint and no component and links nothing; the rows of a repeated id
are documents of their own; ties don't arise (ids decide); texts of any length are handled whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import Scratch, components, pick, table

SEED = 42
SHINGLE = 3
#: signatures that more than two fingerprints share are sent to every executor up to so many (8 bytes each), else shuffled
SENT = 500_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The fingerprint of a text; only A-Z are lower-cased, only ASCII white space separates words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(words) - k + 1)
    last = end[min(k, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(start[:n].tolist(), last.tolist())], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # 64 bytes a shingle: long texts in parts
        bits += np.unpackbits(hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _prints(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = np.array([fingerprint(t, k) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "print"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``(id, print)`` of each row, the fingerprint as a signed 64-bit integer."""
    src = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_prints(k), "id long, print long")


def signatures(prints: DataFrame) -> DataFrame:
    """``(sig, print)``: each half of a fingerprint as it is, and with each of its 32 bits deleted.

    The integer holds which half (bit 38), which bit is deleted (32 to 37; 32 stands for none) and what is left of the half.
    """
    def of(half: int) -> str:
        seg = f"(shiftrightunsigned(print, {32 * half}) & 4294967295L)"
        low = f"({seg} & (shiftleft(1L, j) - 1))"
        high = f"shiftleft(shiftrightunsigned({seg}, j + 1), j)"
        at = f"shiftleft({half}L, 38) | shiftleft(cast(j as long), 32)"
        return f"transform(sequence(0, 32), j -> {at} | if(j = 32, {seg}, {low} | {high}))"
    return prints.select(F.explode(F.expr(f"concat({of(0)}, {of(1)})")).alias("sig"), "print")


def _differ(x: str, y: str):
    return F.expr(f"bit_count({x} ^ {y})")


def _met(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between fingerprints that meet at one of the places themselves and their one-bit changes."""
    places = prints.select(F.explode(F.expr("concat(array(print), transform(sequence(0, 63), j -> print ^ shiftleft(1L, j)))")).alias("place"), "print")
    met = places.groupBy("place").agg(F.array_sort(F.collect_list("print")).alias("g")).filter("size(g) > 1")
    return met.select(F.col("g")[0].alias("a"), F.explode(F.expr("slice(g, 2, size(g) - 1)")).alias("b")).distinct()


def links(prints: DataFrame, tmp: Scratch) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(print)`` that differ in at most two bits: enough of them to
    connect what such pairs connect, each one true."""
    shared = tmp.put(signatures(prints).groupBy("sig").agg(F.count("*").alias("c"), F.min("print").alias("a"), F.max("print").alias("b")).filter("c > 1"))
    pairs = shared.filter("c = 2").select("a", "b").distinct().filter(_differ("a", "b") <= 2)
    many = shared.filter("c > 2").select("sig")
    held = many.limit(SENT + 1).count()
    if not held:
        return pairs
    members = signatures(prints).join(F.broadcast(many) if held <= SENT else many, "sig", "left_semi").select("print").distinct()
    return pairs.unionByName(_met(tmp.put(members)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Rows ``(id_col, fingerprint, component_id)``, one for each row of ``docs``; the fingerprint as 16 hexadecimal digits."""
    tmp = Scratch(docs.sparkSession)
    rows = tmp.put(fingerprints(docs, id_col, text_col, k))
    least = tmp.put(rows.filter("id is not null").groupBy("print").agg(F.min("id").alias("least")))
    edges = tmp.put(links(least.select("print"), tmp))
    comp = components(edges, tmp).withColumnRenamed("node", "print")
    owner = comp.join(least, "print").groupBy("comp").agg(F.min("least").alias("owner"))
    moved = comp.join(owner, "comp").select("print", "owner")
    known = least.join(moved, "print", "left").select("print", F.coalesce("owner", "least").alias("component_id"))
    out = rows.join(known, "print", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                      F.expr("if(id is null, null, component_id)").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
