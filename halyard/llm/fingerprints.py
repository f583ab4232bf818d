"""Document fingerprints: one-permutation MinHash with optimal densification.

Each text's word shingles are hashed once. The hash's high bits choose one of `bins`
bins, the rest compete for the bin's minimum. Empty bins copy a non-empty bin that a
universal hash of (bin, attempt) picks, the same for all texts. Of every bin the low
`bits` bits are kept and packed. Two fingerprints agree by chance in a share 2**-bits of
their bins; the likeness corrects for that: (agreement - c) / (1 - c), at least 0.

Null and empty texts, and texts without words, have the fingerprint of zeros; their
likeness is 1 to each other and 0 to all others. Equal texts have equal fingerprints.
Fewer words than a shingle takes make one shingle of all; very long texts are read whole. Rows
of one id, and rows without an id, which come first, tie and follow each other in the order of
their texts' hashes; repeated rows each have a result. Further columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import (
    BLOCK_BYTES, SPACES, blocks, chained, lower_bytes, mix, partitions, settle, span_hashes, text_buffers, through,
    word_spans, word_table,
)

BINS = 128
BITS = 8
WORDS = 5
_INSIDE = word_table(spaces=SPACES)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densify(mins: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fill empty bins of each row from the bins that (bin, attempt) picks."""
    bins = mins.shape[1]
    row, col = np.nonzero(empty & ~empty.all(1)[:, None])
    out, attempt = mins.copy(), 0
    while len(row):
        with np.errstate(over="ignore"):
            seed = col.astype(np.uint64) + np.uint64(bins) * np.uint64(attempt) + np.uint64(1)
            pick = (mix(seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)
        hit = ~empty[row, pick]
        out[row[hit], col[hit]] = mins[row[hit], pick[hit]]
        row, col, attempt = row[~hit], col[~hit], attempt + 1
    return out


def sketch(raw: np.ndarray, ends: np.ndarray, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Packed bins (one uint8 matrix row for each text) and whether a text has words."""
    raw = lower_bytes(raw)
    starts, stops, bounds = word_spans(raw, ends, _INSIDE)
    counts = np.diff(bounds)
    hashes = span_hashes(raw, starts, stops)
    full = chained(hashes, words)
    n = len(counts)
    text_of = np.repeat(np.arange(n), counts)[: len(full)]
    inside = np.arange(len(full)) + words <= bounds[1:][text_of] if len(full) else np.zeros(0, bool)
    full, text_of = full[inside], text_of[inside]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                there = counts[short] > k
                step = hashes[np.minimum(bounds[short] + k, len(hashes) - 1)]
                whole[there] = mix(whole[there] * np.uint64(0x9E3779B97F4A7C15) + step[there])
        full, text_of = np.r_[full, whole], np.r_[text_of, short]
    slot = ((full >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    value = mix(full ^ np.uint64(0xA0761D6478BD642F))
    mins = np.full(n * bins, _EMPTY)
    np.minimum.at(mins, text_of * bins + slot, value)
    mins = mins.reshape(n, bins)
    mins = densify(mins, mins == _EMPTY)
    has = counts > 0
    low = (mins & np.uint64((1 << bits) - 1)).astype(np.uint16 if bits > 8 else np.uint8)
    low[~has] = 0
    if bits == 8:
        return low, has
    spread = np.unpackbits(low.astype(">u2").view(np.uint8).reshape(n, bins, 2), axis=2)[:, :, 16 - bits :]
    return np.packbits(spread.reshape(n, bins * bits), axis=1), has


def unpack(packed: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return packed
    spread = np.unpackbits(packed, axis=1)[:, : bins * bits].reshape(-1, bins, bits)
    return spread @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a, a_has, b, b_has, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    chance = 2.0**-bits
    same = (unpack(a, bins, bits) == unpack(b, bins, bits)).mean(1)
    corrected = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(a_has & b_has, corrected, (~a_has & ~b_has).astype(float))


def _sketch_texts(texts: list[str], bins: int, bits: int, words: int):
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.r_[0, np.cumsum([len(x) for x in encoded])].astype(np.int64)
    return sketch(np.frombuffer(b"".join(encoded), np.uint8), ends, bins, bits, words)


def fingerprint_documents(
    docs: DataFrame, text: str = "text", *, bins: int = BINS, bits: int = BITS, words: int = WORDS, id_column: str = "doc_id",
) -> DataFrame:
    """doc_id, fingerprint (hex): one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            packed, _ = sketch(*text_buffers(block.column(1)), bins, bits, words)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([x.tobytes().hex() for x in packed])], ["doc_id", "fingerprint"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).transform(through, run, "doc_id long, fingerprint string"
    )


def in_order(docs: DataFrame, id_column: str, text: str, parts: int) -> DataFrame:
    """doc_id, text, part, donor: rows dealt to ranges of ascending ids, sorted; the rows of
    each range's first id also go, as donors, to the range before it (those of the first
    range to the last one), so that each range holds the next row of all its rows.

    The text moves once. Only the ranges' bounds, one row for each range, reach the driver.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(docs[id_column].cast("long"), F.lit(least)).alias("ord"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
    )
    cuts = rows.agg(F.percentile_approx("ord", [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(map(int, cuts)))
    rows = rows.withColumn("part", F.expr(_bisect(cuts, 0, len(cuts))))
    heads = sorted((r["part"], r["first"]) for r in rows.groupBy("part").agg(F.min("ord").alias("first")).collect())
    bounds = spark.createDataFrame(
        [(p, first, heads[k - 1][0]) for k, (p, first) in enumerate(heads)], "part int, first long, before int"
    )
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("donor"))
    lent = F.struct(F.col("before").alias("part"), F.lit(True).alias("donor"))
    dealt = rows.join(F.broadcast(bounds), "part").select(
        "doc_id", "ord", "text", F.explode(F.when(F.col("ord") == F.col("first"), F.array(own, lent)).otherwise(F.array(own))).alias("to")
    )
    dealt = dealt.select("doc_id", "ord", "text", "to.part", "to.donor")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(
        "part", "donor", "ord", F.xxhash64("text"), "text"
    )


def _bisect(cuts: list[int], lo: int, hi: int) -> str:
    """The number of cuts at or below ord."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    bound = f"{cuts[mid]}L" if cuts[mid] > -(1 << 63) else "(-9223372036854775807L - 1L)"
    return f"if(ord >= {bound}, {_bisect(cuts, mid + 1, hi)}, {_bisect(cuts, lo, mid)})"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows that follow each other; the last row of a run is only the next
    row of the one before it. A run holds about BLOCK_BYTES characters."""
    ids: list = []
    texts: list[str] = []
    held, part, lent = 0, None, False
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "donor")]
        for i, t, p, donor in zip(*cols):
            if p != part:
                part, lent, ids, texts, held = p, False, [], [], 0
            if donor and lent:
                continue  # only the first donor follows the range's last row
            ids.append(i)
            texts.append(t)
            held += len(t)
            if donor:
                lent = True
                if len(ids) > 1:
                    yield ids, texts
                ids, texts, held = [], [], 0
            elif held >= BLOCK_BYTES and len(ids) > 1:
                yield ids, texts
                ids, texts, held = ids[-1:], texts[-1:], len(t)


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(
    docs: DataFrame, text: str = "text", *, bins: int = BINS, bits: int = BITS, words: int = WORDS, id_column: str = "doc_id",
) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likeness of its
    fingerprint to the edited text's and to the next row's."""
    spark = docs.sparkSession
    ordered = in_order(docs, id_column, text, partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _runs(batches):
            changed = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
            fp, has = _sketch_texts(texts, bins, bits, words)
            new, new_has = _sketch_texts(changed, bins, bits, words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array([x.tobytes().hex() for x in fp[:-1]]),
                    pa.array([x.tobytes().hex() for x in new]),
                    pa.array(likeness(fp[:-1], has[:-1], new, new_has, bins, bits)),
                    pa.array(likeness(fp[:-1], has[:-1], fp[1:], has[1:], bins, bits)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return ordered.select("doc_id", "text", "part", "donor").transform(
        through, run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
