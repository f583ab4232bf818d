"""Shared pieces: shared-folder checkpoints, Arrow text blocks, byte-level word spans.

Every Python operator here works on blocks of a few megabytes cut from the Arrow
batches it receives, so a worker's memory depends on the longest text and the block
size, never on the table.
"""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code

#: Bytes of text in one block; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes in one Arrow batch between the JVM and Python, where the session has Spark's default.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

SPACES = bytes([0x20, *range(0x09, 0x0E)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset, on a local master."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        there = sc.getConf().get("spark.checkpoint.dir")
        if there is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = there or os.path.join(tempfile.gettempdir(), "halyard-checkpoints")
        sc.setCheckpointDir(there)
    return there


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_clean(df: DataFrame) -> DataFrame:
    """settle, for jobs of many steps: what earlier steps left is removed first.

    Spark removes shuffle files and checkpoints once the driver has collected what refers to
    them, which a driver with room to spare may not do before the whole job has ended."""
    release(df.sparkSession)
    return settle(df)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def through(df: DataFrame, run, schema) -> DataFrame:
    """df through an Arrow function of this package. Batches are smaller than Spark's default:
    each is held by the JVM and by Python at once, for every task of an executor.

    The size is a setting of the session, read when the plan runs, so it stays; where the
    session has a size of its own, that one is used."""
    ship_code(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


#: Node numbers are broadcast up to so many rows (16 MB).
BROADCAST_NODES = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_NODES) -> DataFrame:
    """df, settled, to be broadcast in a join if it has no more rows than that."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= rows else df


#: A key that more than one row in HOT has is hot; there are fewer than HOT such keys.
HOT = 1_000
#: Their rows are broadcast up to so many bytes; larger ones are repeated for each of SALTS parts of a hot key.
HOT_BYTES = 64 << 20
SALTS = 64


def join_hot(left: DataFrame, right: DataFrame, *keys: str, most: int = HOT_BYTES) -> DataFrame:
    """left (settled by the caller) joined with right, which has one row for each key: rows of hot
    keys meet theirs by a broadcast of fewer than HOT rows and no more than `most` bytes and are not moved; beyond
    that a hot key's rows are spread over SALTS parts by their hash. All others are joined."""
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = settle(sizes.filter(F.col("n") * HOT > left.count()).select(*keys))
    if hot.isEmpty():
        return left.join(right, list(keys))
    few = left.join(F.broadcast(hot), list(keys), "left_anti").join(right, list(keys))
    theirs = settle(right.join(F.broadcast(hot), list(keys), "left_semi"))
    size = theirs.agg(F.sum(F.octet_length(F.to_json(F.struct(*theirs.columns))))).first()[0] or 0
    if size <= most:
        return few.unionByName(left.join(F.broadcast(theirs), list(keys)))
    (part,) = fresh(left.join(right, list(keys)), "part")
    parted = left.join(F.broadcast(hot), list(keys), "left_semi").withColumn(part, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    repeated = theirs.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return few.unionByName(parted.join(repeated, [*keys, part]).drop(part))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where a column of df has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(column: str = "doc_id"):
    return F.col(column).cast("long")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    if data is None or not len(ends):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about `size` bytes of `column`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            # rows without text take no bytes, but their results do
            to = min(to, at + 20_000)
            yield batch.slice(at, to - at)
            at = to


def word_table(*, words: bytes | None = None, spaces: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words."""
    table = np.zeros(256, bool) if words is not None else np.ones(256, bool)
    table[list(words if words is not None else spaces or b"")] = words is not None
    return table


def lower_bytes(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(
    raw: np.ndarray, ends: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the range of its words."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(ends), np.int64)
    word = inside[raw]
    first = np.empty(len(raw), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    last = np.empty(len(raw), bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    closing = ends[1:] - 1
    last[closing[closing >= 0]] = True
    starts = np.flatnonzero(word & first)
    stops = np.flatnonzero(word & last) + 1
    return starts, stops, np.searchsorted(starts, ends, "left")


_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed together; a longer word makes a piece of its own.
_PIECE = 1 << 18
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64; only those of a usual piece are kept."""
    global _powers, _inverse
    if len(_powers) >= n:
        return _powers, _inverse
    with np.errstate(over="ignore"):
        made = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * _PIECE) - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    if n <= 2 * _PIECE:
        _powers, _inverse = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from prefix sums of a polynomial mod 2**64.

    Spans are in order and don't overlap; they are taken a piece of the text at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, first + _PIECE, "left")))
        piece = raw[first : int(stops[to - 1])]
        powers, inverse = _grow(len(piece) + 1)
        a, b = starts[at:to] - first, stops[at:to] - first
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        with np.errstate(over="ignore"):
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers[: len(piece)], out=sums[1:])
            out[at:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def chained(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of `length` hashes from each place on; the last length-1 places are left out."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(length):
                out = mix(out * np.uint64(_BASE) + hashes[k : k + n])
    return out
