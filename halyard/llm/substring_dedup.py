"""Removal of repeated passages by difference-cover anchors.

A window is `window` consecutive words of one document; it is a repeat if the same words also start
earlier (smaller doc_id, or same doc_id and earlier start). All words that repeats cover are removed.

COVER is a difference cover modulo PERIOD: for any two places i and j there is a shift under PERIOD that takes
both to places whose remainder is in COVER. So two equal windows share an anchor, the
`window` - PERIOD + 1 words at such a place, at one offset in both, and only anchors at cover places
(4 of 13) are hashed and sent. Documents are dealt into blocks once; three steps read that exchange:

1. Each block sends its distinct anchors to buckets by hash; a bucket tells each block which
   of its anchors another block has too.
2. The windows around shared anchors are extended to full length: each block sends those windows' 96-bit hashes,
   one for each distinct window, with the least (doc_id, start) it has. Buckets find the least of all
   blocks and tell each block that has a later one.
3. A window that starts later than the least start of its words is a repeat; covered words go.

A passage that a third of all documents share is one hash in each block, so no bucket gets a
row for each copy, and no pairs are formed. Blocks hold about BLOCK_BYTES of text, buckets the hashes of about
BUCKET_BYTES of it; both are counted from the bytes of the table. Windows are told by a
64-bit and a 32-bit hash over 64-bit hashes of their words. What is sent is laid out byte plane by byte plane, so that the
zeros of small numbers and the equal first bytes of a bucket's hashes take no room once it is compressed.

A null or empty text has no words and stays empty; a very long text is read whole, as a block of its own.
Rows that share a doc_id tie where they start windows at the same place: neither is earlier, both stay;
that holds for repeated rows. A null doc_id is larger than all others and counts as one id. Blocks are chosen by
doc_id, text and input partition, so repeated rows are dealt too. An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from ._blocks import SPACES, mix, partitions, span_hashes, text_buffers, word_spans, word_table

WINDOW = 20
#: Every difference modulo 13 is one of two of these.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a block, and bytes of text whose hashes meet in a bucket.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 256 << 20

_INSIDE = word_table(spaces=SPACES)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: A window of a block: two hashes, its least start, flags (1: the doc_id is null; 2: the block has it again).
_RECORD = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("at", "<u4"), ("flags", "u1")])
#: Bits of the second hash that are left out.
_SECOND_SHIFT = np.uint64(32)
_NO_ID, _AGAIN = 1, 2


def sequence_hashes(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of the `length` words from each place on."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, length):
            out *= np.uint64(base)
            out += hashes[k : k + n]
    return mix(out)


class Words:
    """The words of a block's texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.window = window
        self.raw, ends = text_buffers(texts)
        self.ends = ends
        self.starts, self.stops, self.bounds = word_spans(self.raw, ends, _INSIDE)
        self.hashes = span_hashes(self.raw, self.starts, self.stops)
        counts = np.diff(self.bounds)
        #: of each word: its text, its place in it, and how many words follow up to the text's end
        self.text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        self.place = np.arange(len(self.hashes)) - self.bounds[:-1][self.text]
        self.left = counts[self.text] - self.place

    def anchors(self, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of each anchor of a text that has a window."""
        length = self.window - period + 1
        chosen = np.zeros(period, bool)
        chosen[list(cover)] = True
        at = np.flatnonzero(chosen[self.place % period] & (self.left >= length) & (self.place + self.left >= self.window))
        return at, sequence_hashes(self.hashes, length, _BASES[0])[at] if len(at) else np.zeros(0, np.uint64)

    def around(self, anchors: np.ndarray, period: int) -> np.ndarray:
        """First words of the windows that hold one of the anchors at an offset under period."""
        change = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(change, anchors - np.minimum(self.place[anchors], period - 1), 1)
        np.add.at(change, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(change[:-1]) > 0) & (self.left >= self.window))

    def windows(self) -> np.ndarray:
        return sequence_hashes(self.hashes, self.window, _BASES[0])

    def second(self) -> np.ndarray:
        return (sequence_hashes(self.hashes, self.window, _BASES[1]) >> _SECOND_SHIFT).astype(np.uint32)


def pack(values: np.ndarray) -> bytes:
    """All first bytes, all second bytes, and so on."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Bucket and range of sorted keys: the buckets part the range of 64-bit hashes."""
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([width * k for k in range(1, buckets)], np.uint64), "left")
    edges = np.r_[0, edges, len(keys)]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(int(edges[k]), int(edges[k + 1]))


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("doc_id").combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
_SENT_SQL = "bucket int, block int, data binary"
_TOLD = pa.schema([("block", pa.int32()), ("data", pa.binary())])
_TOLD_SQL = "block int, data binary"


def _held(table: pa.Table, kind) -> np.ndarray:
    """All values of a table's packed column."""
    return np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for c in table.column("data").chunks for x in c.to_pylist())])


def _told(blocks: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row for each block with its values."""
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    at = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(blocks)]
    return pa.Table.from_arrays([pa.array(blocks[at], pa.int32()), pa.array([pack(values[a:b]) for a, b in zip(at, ends)] if len(at) else [], pa.binary())], schema=_TOLD)


def _senders(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """(block, value) of all values of a bucket."""
    data = [x for c in table.column("data").chunks for x in c.to_pylist()]
    sizes = [len(x) // np.dtype(kind).itemsize for x in data]
    return np.repeat(np.array(table.column("block").to_pylist(), np.int32), sizes), _held(table, kind)


def _anchors_of(period: int, cover: tuple[int, ...], window: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        words = Words(table.column("text").combine_chunks(), window)
        kept = np.unique(words.anchors(period, cover)[1])
        rows = list(_by_bucket(kept, buckets))
        block = _block_of(table)
        return pa.Table.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([pack(kept[s]) for _, s in rows], pa.binary())], schema=_SENT)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """What each block must hear of its anchors: those that another block has."""
    blocks, values = _senders(table, np.uint64)
    order = np.argsort(values, kind="stable")
    values, blocks = values[order], blocks[order]
    same = values[1:] == values[:-1]
    shared = np.r_[False, same] | np.r_[same, False] if len(values) else np.zeros(0, bool)
    return _told(blocks[shared], values[shared])


def _windows_of(period: int, cover: tuple[int, ...], window: int, buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SENT.empty_table()
        words = Words(table.column("text").combine_chunks(), window)
        at, anchors = words.anchors(period, cover)
        kinds, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[np.searchsorted(kinds, _held(told, np.uint64))] = True
        first = words.around(at[shared[inverse]], period)
        ids, missing = _ids(table)
        text = words.text[first]
        records = np.empty(len(first), _RECORD)
        if len(first):
            records["a"], records["b"] = words.windows()[first], words.second()[first]
        records["id"], records["at"], records["flags"] = ids[text], words.place[first], missing[text]
        records = _least(records)[0]
        rows = list(_by_bucket(records["a"], buckets))
        block = _block_of(table)
        return pa.Table.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([pack(records[s]) for _, s in rows], pa.binary())], schema=_SENT)

    return run


def _order(records: np.ndarray) -> np.ndarray:
    return np.lexsort((records["at"], records["id"], records["flags"] & _NO_ID, records["b"], records["a"]))


def _groups(records: np.ndarray) -> np.ndarray:
    """Where the records of another window begin; records are in order."""
    new = np.ones(len(records), bool)
    new[1:] = (records["a"][1:] != records["a"][:-1]) | (records["b"][1:] != records["b"][:-1])
    return np.flatnonzero(new)


def _least(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One record for each distinct window, of least start, marked if there are more; how many there are."""
    records = records[_order(records)]
    at = _groups(records)
    sizes = np.diff(np.r_[at, len(records)])
    out = records[at]
    out["flags"] |= np.where(sizes > 1, _AGAIN, 0).astype(np.uint8)
    return out, sizes


def _earlier(table: pa.Table) -> pa.Table:
    """What each block must hear of its windows: the least start of those that it has at a later one."""
    blocks, records = _senders(table, _RECORD)
    order = _order(records)
    records, blocks = records[order], blocks[order]
    at = _groups(records)
    sizes = np.diff(np.r_[at, len(records)])
    least = np.repeat(records[at], sizes)
    later = (records["flags"] & _AGAIN > 0) | _after(records, least)
    return _told(blocks[later], least[later])


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the start in a comes after that in b."""
    x, y = a["flags"] & _NO_ID, b["flags"] & _NO_ID
    return (x > y) | (x == y) & ((a["id"] > b["id"]) | (a["id"] == b["id"]) & (a["at"] > b["at"]))


def _found(known: np.ndarray, a: np.ndarray, b_at) -> tuple[np.ndarray, np.ndarray]:
    """(window, its record) of the windows that known, in order of (a, b), has; b_at gives second hashes."""
    if not len(known) or not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known["a"], a)
    here = np.flatnonzero(known["a"][np.minimum(at, len(known) - 1)] == a)
    at, b = at[here], b_at(here)
    # equal first hashes of different windows: go on to the second hash
    while len(step := np.flatnonzero((at + 1 < len(known)) & (known["b"][at] != b) & (known["a"][np.minimum(at + 1, len(known) - 1)] == a[here]))):
        at[step] += 1
    same = known["b"][at] == b
    return here[same], at[same]


_RESULT = "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept string"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])


def _kept_of(window: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _RESULT_SCHEMA.empty_table()
        words = Words(table.column("text").combine_chunks(), window)
        known = _held(told, _RECORD)
        known = known[_order(known)]
        gone = np.zeros(len(words.hashes), bool)
        if len(known):
            whole = np.flatnonzero(words.left >= window)
            second = words.second()
            here, at = _found(known, words.windows()[whole], lambda k: second[whole[k]])
            first = whole[here]
            ids, missing = _ids(table)
            own = np.empty(len(first), _RECORD)
            own["id"], own["at"], own["flags"] = ids[words.text[first]], words.place[first], missing[words.text[first]]
            first = first[_after(own, known[at])]
            change = np.zeros(len(gone) + 1, np.int32)
            np.add.at(change, first, 1)
            np.add.at(change, first + window, -1)
            gone = np.cumsum(change[:-1]) > 0
        return _result(table, words, gone)

    return run


def _result(table: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
    n = table.num_rows
    # a kept word's bytes stay, and one byte after it, which becomes the space, unless no kept word follows
    stay = np.flatnonzero(~gone)
    keep = np.zeros(len(words.raw) + 1, np.int8)
    np.add.at(keep, words.starts[stay], 1)
    np.add.at(keep, words.stops[stay], -1)
    mask = np.cumsum(keep, dtype=np.int32)[:-1] > 0
    raw = words.raw.copy()
    followed = stay[:-1][words.text[stay[:-1]] == words.text[stay[1:]]] if len(stay) else stay
    raw[words.stops[followed]] = 0x20
    mask[words.stops[followed]] = True
    out = raw[mask]
    ends = np.r_[0, np.cumsum(mask)][words.ends]
    kept = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))
    # ranges of removed words, each inside its text
    opens = gone.copy()
    opens[1:] &= ~gone[:-1] | (words.text[1:] != words.text[:-1])
    closes = gone.copy()
    closes[:-1] &= ~gone[1:] | (words.text[1:] != words.text[:-1])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    removed: list[list] = [[] for _ in range(n)]
    for k, x, y in zip(words.text[a].tolist(), words.place[a].tolist(), (words.place[b] + 1).tolist()):
        removed[k].append([x, y])
    return pa.Table.from_arrays(
        [
            table.column("doc_id").combine_chunks(),
            pa.array(np.diff(words.bounds), pa.int64()),
            pa.array(np.bincount(words.text[gone], minlength=n) if n else [], pa.int64()),
            pa.array(removed, pa.list_(pa.list_(pa.int32()))),
            kept,
        ],
        schema=_RESULT_SCHEMA,
    )


def remove_repeats(
    docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, blocks: int | None = None, buckets: int | None = None
) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of words), kept (the kept words joined by one space) of every row.

    Blocks and buckets are counted from the table's bytes unless they are given; results don't depend on them."""
    if not 0 < period <= window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}, or the period is over the window")
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = blocks or max(2 * partitions(spark), size // BLOCK_BYTES + 1)
    buckets = buckets or max(2 * partitions(spark), size // BUCKET_BYTES + 1)
    # the input partition takes part so that equal rows don't all meet in one block
    block = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "doc_id", "text").groupBy("block")
    anchors = dealt.applyInArrow(_anchors_of(period, cover, window, buckets), _SENT_SQL)
    shared = anchors.groupBy("bucket").applyInArrow(_shared, _TOLD_SQL)
    windows = dealt.cogroup(shared.groupBy("block")).applyInArrow(_windows_of(period, cover, window, buckets), _SENT_SQL)
    earlier = windows.groupBy("bucket").applyInArrow(_earlier, _TOLD_SQL)
    return dealt.cogroup(earlier.groupBy("block")).applyInArrow(_kept_of(window), _RESULT)


def report(found: DataFrame) -> DataFrame:
    """The digest columns."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
