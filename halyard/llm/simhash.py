"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint is cut into `segments` on a ring. If two fingerprints differ in at most t
bits then at least segments - t segments are equal, and some segment starts a chain in
which, for every l, the first l segments differ in at most floor(l * t / segments) bits.
Candidates meet in the keys of all choices of segments - t segments (with five segments and
two bits: ten keys of 38 or 39 bits, which two unrelated fingerprints among ten billion
rarely share); the chain test prunes them before the full Hamming test, which each pair
takes once, in the first key that it shares.

Work is on distinct fingerprints, so copies cost one row. A key is large only where so many
fingerprints truly lie together. One shared by more than `group_limit` is not paired off:
its members are linked through the points within half the radius of each (every pair at
distance 2 or less meets in such a point, and no other pair does), which costs a fixed
number of rows for each member. Both ways are exact, so the limit changes cost and never
the result.

Null and empty texts, and texts without words, have fingerprint 0 and link like any
other; very long texts are read whole. Repeated rows and equal texts have one fingerprint
and each row its result; ties of the component are settled by the least id. Further columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import blocks, settle, through
from .components import components

SEED = 42
BITS = 64
SEGMENTS = 5
#: Largest key group that is paired off member by member.
GROUP_LIMIT = 256


def text_fingerprint(text: str | None, words: int = 3) -> int:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    # bytes.split() cuts at 0x20 and 0x09-0x0D, bytes.lower() moves A-Z only
    joined = b" ".join(raw.split())
    if not joined:
        return 0
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, stops = [0, *(at + 1).tolist()], [*at.tolist(), len(joined)]
    if len(starts) > words:
        starts, stops = starts[: len(starts) - words + 1], stops[words - 1 :]
    else:
        starts, stops = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))
    return int(majority(hashes.reshape(-1, 1))[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """For hashes (rows by 64-bit words) the words whose bits are set in over half the rows."""
    counts = np.zeros(hashes.shape[1] * BITS, np.int64)
    for k in range(0, len(hashes), 255):
        part = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8)
        # 255 rows fit in a byte, so the sums need no wider lanes
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, *, id_column: str = "doc_id") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            fp = np.array([text_fingerprint(t, words) for t in block.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).transform(through, run, "doc_id long, fp long"
    )


def ring(segments: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    cuts = [round(k * bits / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(parts: list[tuple[int, int]]) -> int:
    """The bits of the segments, as a signed 64-bit number."""
    bits = sum(((1 << width) - 1) << shift for shift, width in parts)
    return bits - (1 << 64) if bits >> 63 else bits


def _differing(difference, parts: list[tuple[int, int]]):
    return F.bit_count(difference.bitwiseAND(F.lit(_mask(parts)).cast("long")))


def chain(difference, segments: int, radius: int):
    """Some segment starts a chain that keeps within its budget at every length."""
    parts = ring(segments)
    own = [_differing(difference, [p]) for p in parts]
    test = F.lit(False)
    for start in range(segments):
        total, kept = F.lit(0), F.lit(True)
        for length in range(1, segments):
            total = total + own[(start + length - 1) % segments]
            kept = kept & (total <= F.lit(length * radius // segments))
        test = test | kept
    return test


def links(points: DataFrame, radius: int = 2, segments: int = SEGMENTS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) whose connected components
    are those of all pairs at distance `radius` or less."""
    if not 0 < radius <= 2:
        raise ValueError("the exact way for large groups holds for radius 1 and 2")
    if segments <= radius:
        raise ValueError("more segments than differing bits are needed")
    chosen = [_mask(list(c)) for c in combinations(ring(segments), segments - radius)]
    key = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(chosen)]
    keys = settle(points.select("fp", F.explode(F.array(*key)).alias("key")).select("fp", "key.k", "key.part"))
    sizes = keys.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(keys.join(sizes, ["k", "part"]))
    few = shared.filter(F.col("n") <= group_limit).select("k", "part", "fp")
    difference = F.col("u").bitwiseXOR(F.col("v"))
    first = F.lit(len(chosen))
    for k, m in reversed(list(enumerate(chosen))):
        first = F.when(difference.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(k)).otherwise(first)
    pairs = (
        few.withColumnRenamed("fp", "u")
        .join(few.withColumnRenamed("fp", "v"), ["k", "part"])
        .filter("u > v")
        # if the first key is a large one, the points below link both
        .filter(F.col("k") == first)
        .filter(chain(difference, segments, radius))
        .filter(F.bit_count(difference) <= radius)
        .select("u", "v")
    )
    # members of large groups: themselves and all points one bit away
    many = shared.filter(F.col("n") > group_limit).select("fp").distinct()
    if many.isEmpty():
        return pairs
    near = [F.col("fp")]
    if radius == 2:
        near += [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(BITS)]
        meet = many.select("fp", F.explode(F.array(*near)).alias("point"))
    else:
        # distance 1: the even-parity one of both is a point of each
        odd = F.bit_count("fp") % 2 == 1
        flipped = [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), b)) for b in range(BITS)]
        meet = many.select("fp", odd.alias("odd"), F.explode(F.array(*near, *flipped)).alias("point"))
        # a point stands for the links between it and its neighbours, so it must be a member
        meet = meet.join(many.select(F.col("fp").alias("point")), "point", "left_semi")
    least = meet.groupBy("point").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    if radius == 2:
        star = meet.join(least, "point").filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    else:
        star = meet.filter("fp <> point").select(F.col("fp").alias("u"), F.col("point").alias("v"))
    return pairs.union(star).distinct()


def simhash_components(
    docs: DataFrame, text: str = "text", *, words: int = 3, radius: int = 2, segments: int = SEGMENTS,
    group_limit: int = GROUP_LIMIT, id_column: str = "doc_id",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least reachable doc_id)."""
    prints = settle(fingerprints(docs, text, words, id_column=id_column))
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(points, radius, segments, group_limit))
    named = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
