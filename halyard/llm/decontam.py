"""Benchmark decontamination with training suffix arrays.

Every worker cuts its documents into shards of about SHARD_BYTES, numbers the words that
the benchmark has (all others are 0, which matches nothing) and sorts the shard's word
suffixes that begin with as many numbered words as the shortest window, two words to a sort key; suffixes that agree
there are sorted on by the next two, to the depth a window needs. Each test suffix is
then found in the array by binary search: its interval holds all places in the shard
where the window occurs word for word. Matches are compared with the window's own bytes.

A window is `window` consecutive words of an item; an item of fewer words, but not none,
is one window. The benchmark is cut into blocks of BENCHMARK_BYTES of text. A block is held as
flat arrays of a few times its text; the driver holds one at a time, and so does a worker,
which takes the blocks in turn for some megabytes of documents.

Null and empty texts have no words; a text longer than a shard is a shard of its own, of
any number of distinct words. An empty benchmark hits nothing; items that share an item_id
count once; a null item_id counts as the string "null". Ties don't arise: all occurrences
count. Repeated rows repeat their results; further columns are ignored by `scan` and kept by
`keep_clean`, whatever their names. An empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, lower_bytes, span_hashes, text_buffers, through, word_spans, word_table

WINDOW = 10
#: Bytes of document text whose suffixes are sorted together.
SHARD_BYTES = 2 << 20
#: Bytes of documents that a worker takes through all blocks of the benchmark.
GROUP_BYTES = 8 << 20
#: Bytes of benchmark text in one block.
BENCHMARK_BYTES = 16 << 20
#: Digits, letters and all bytes of other code points; A-Z are lowered before.
_INSIDE = word_table(words=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Bits of a word's number, and words in a 64-bit sort key.
_BITS = 32
_PER_KEY = 2
_FIELDS = ("item", "item_word", "doc_word", "words")
_MATCHES = "array<struct<item:string,item_word:int,doc_word:int,words:int>>"
_MATCH_TYPE = pa.list_(pa.struct([(n, pa.string() if n == "item" else pa.int32()) for n in _FIELDS]))


class Tests:
    """The windows of a block of benchmark items, as flat arrays over its words.

    Window w begins with word at[w]; its item and its length follow from the items' bounds."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.items = [i for i, _ in items]
        texts = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        ends = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        raw = lower_bytes(np.frombuffer(b"".join(texts), np.uint8))
        starts, stops, bounds = word_spans(raw, ends, _INSIDE)
        self.raw = raw.tobytes()
        self.starts, self.stops = starts.astype(np.int32), stops.astype(np.int32)
        self.bounds = bounds
        self.vocabulary, number = np.unique(span_hashes(raw, starts, stops), return_inverse=True)
        self.number = (number + 1).astype(np.uint32)
        counts = np.diff(bounds)
        first = np.repeat(bounds[:-1], counts)
        last = np.repeat(np.maximum(bounds[1:] - window, bounds[:-1]), counts)
        place = np.arange(len(starts))
        self.at = place[(place >= first) & (place <= last)].astype(np.int32)
        #: words of the shortest window
        self.least = int(min(window, counts[counts > 0].min(initial=window)))
        self.known = np.zeros(1 << 20, bool)
        self.known[self._low(self.vocabulary)] = True

    def owner(self, at):
        """The item of the word `at`."""
        return np.searchsorted(self.bounds, at, "right") - 1

    def length(self, at):
        """Words of the windows that begin at the words `at`."""
        return np.minimum(self.window, self.bounds[self.owner(at) + 1] - at)

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 20) - 1)).astype(np.int64)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for those that no item has."""
        out = np.zeros(len(hashes), np.uint64)
        # most words of no item are told by the low bits of their hashes
        maybe = np.flatnonzero(self.known[self._low(hashes)])
        if len(maybe):
            wanted = hashes[maybe]
            there = np.minimum(np.searchsorted(self.vocabulary, wanted), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[there] == wanted, there + 1, 0)
        return out

    def word(self, k: int) -> bytes:
        return self.raw[self.starts[k] : self.stops[k]]


def _keys(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sort keys of the words from each place on; ids has zeros enough at its end."""
    return ids[places] << np.uint64(_BITS) | ids[places + 1]


def suffix_array(ids: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places that begin with `least` numbered words, sorted by the `depth` words from each on,
    and ids with zeros at its end."""
    padded = np.r_[ids, np.zeros(depth + 2 * _PER_KEY, np.uint64)]
    # the next 0 at or after each place
    zeros = np.flatnonzero(padded == 0)
    runs = np.diff(zeros, prepend=-1) - 1
    long = np.flatnonzero(runs >= least)
    sizes = runs[long] - least + 1
    places = np.repeat(zeros[long] - runs[long] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(long) else np.zeros(0, np.int64)
    order = places[np.argsort(_keys(padded, places))]
    n = len(order)
    done = _PER_KEY
    group = np.zeros(n, np.int64)
    if n:
        np.cumsum(np.diff(_keys(padded, order)) != 0, out=group[1:])
    while done < depth and n:
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(group[1:], group[:-1], out=new[1:])
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        places = order[open_]
        next_keys = _keys(padded, places + done)
        inner = np.lexsort((next_keys, group[open_]))
        order[open_] = places[inner]
        sorted_keys, own = next_keys[inner], group[open_]
        split = np.zeros(n, bool)
        split[open_[1:]] = (sorted_keys[1:] != sorted_keys[:-1]) & (own[1:] == own[:-1])
        group = np.cumsum(new | split) - 1
        done += _PER_KEY
    return order, padded


def _bound(ids, order, lo, hi, want, offset, shift, right):
    """Binary search in [lo, hi) of each query: where key >> shift reaches (passes) `want`."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        active = lo < hi
        if not active.any():
            return lo
        mid = (lo + hi) >> 1
        got = _keys(ids, order[np.minimum(mid, len(order) - 1)] + offset) >> shift
        below = (got <= want) if right else (got < want)
        lo = np.where(active & below, mid + 1, lo)
        hi = np.where(active & ~below, mid, hi)


def occurrences(ids: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(place, first word of the window) of every occurrence of a test window in the shard.

    ids: the tests' numbers of the shard's words, with 0 between texts.
    """
    none = np.zeros(0, np.int64)
    if not len(tests.at) or not ids.any():
        return none, none
    # a window can occur only if the shard has all its words
    there = np.zeros(len(tests.vocabulary) + 1, bool)
    there[ids.astype(np.int64)] = True
    missing = np.r_[0, np.cumsum(~there[tests.number])]
    at, length = tests.at.astype(np.int64), tests.length(tests.at)
    live = missing[at + length] == missing[at]
    at, length = at[live], length[live]
    order, padded = suffix_array(ids, tests.window, tests.least)
    if not len(order):
        return none, none
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    words = np.r_[tests.number, np.zeros(_PER_KEY, np.uint32)].astype(np.uint64)
    for offset in range(0, tests.window, _PER_KEY):
        for take in range(1, _PER_KEY + 1):
            pick = np.flatnonzero((np.minimum(length - offset, _PER_KEY) == take) & (lo < hi))
            if not len(pick):
                continue
            want = np.zeros(len(pick), np.uint64)
            for k in range(take):
                want = want << np.uint64(_BITS) | words[at[pick] + offset + k]
            shift = np.uint64(_BITS * (_PER_KEY - take))
            a = _bound(padded, order, lo[pick], hi[pick], want, offset, shift, False)
            b = _bound(padded, order, a, hi[pick], want, offset, shift, True)
            lo[pick], hi[pick] = a, b
    found = np.flatnonzero(lo < hi)
    if not len(found):
        return none, none
    counts = (hi - lo)[found]
    start = np.repeat(lo[found] - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return order[start + np.arange(counts.sum())], np.repeat(at[found], counts)


def longest(hits: list[tuple[int, int, int]], tests: Tests) -> list[tuple[str, int, int, int]]:
    """(item, its first word, the document's first word, words) of the longest verbatim
    matches: windows that follow each other in both texts are one match."""
    owners = tests.owner(np.array([t for _, _, t in hits], np.int64)).tolist()
    rows = sorted((o, w - (t - int(tests.bounds[o])), w, n) for o, (w, n, t) in zip(owners, hits))
    out: list[list] = []
    for owner, shift, w, n in rows:
        if out and out[-1][0] == owner and out[-1][1] == shift and w == out[-1][3] + 1:
            out[-1][3], out[-1][4] = w, w + n
        else:
            out.append([owner, shift, w, w, w + n])
    return [(tests.items[o], first - shift, first, end - first) for o, shift, first, _, end in out]


def scan_shard(texts: pa.Array, tests: Tests) -> list[tuple[int, list, list, list]]:
    """Per document: n_words, hit spans [(first word, end)], items, longest matches."""
    raw, ends = text_buffers(texts)
    raw = lower_bytes(raw)
    starts, stops, bounds = word_spans(raw, ends, _INSIDE)
    n = len(bounds) - 1
    counts = np.diff(bounds)
    # a 0 after each text keeps windows inside it
    numbered = np.zeros(len(starts) + n, np.uint64)
    numbered[np.arange(len(starts)) + np.repeat(np.arange(n), counts)] = tests.numbered(span_hashes(raw, starts, stops))
    place, window = occurrences(numbered, tests)
    hits: dict[int, list] = {}
    if len(place):
        first = np.cumsum(counts + 1) - (counts + 1)
        text_no = np.searchsorted(first, place, "right") - 1
        word = place - text_no
        joined = raw.tobytes()
        order = np.lexsort((place, text_no))
        length = tests.length(window)
        for d, w, t, size in zip(*(x[order].tolist() for x in (text_no, word, window, length))):
            if all(joined[starts[w + k] : stops[w + k]] == tests.word(t + k) for k in range(size)):
                hits.setdefault(d, []).append((w - int(bounds[d]), size, t))
    out = []
    for d in range(n):
        own = hits.get(d, [])
        items = {tests.items[o] for o in tests.owner(np.array([t for _, _, t in own], np.int64)).tolist()} if own else ()
        out.append((int(counts[d]), _merged([[w, w + size] for w, size, _ in own]), sorted(items), longest(own, tests) if own else []))
    return out


def _test_blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Tests]:
    rows = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("null")), benchmark[text].cast("string"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        size += len((r[1] or "").encode("utf-8", "surrogatepass")) + 64
        if size >= BENCHMARK_BYTES:
            yield Tests(held, window)
            held, size = [], 0
    if held:
        yield Tests(held, window)


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _sent(docs: DataFrame, benchmark: DataFrame, item: str, text: str, window: int) -> list:
    """Each block of the benchmark as a broadcast; the driver keeps none of them in memory."""
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(tests) for tests in _test_blocks(benchmark, item, text, window)]


def _through_blocks(shards: list[pa.Array], sent: list, window: int) -> list[list[tuple[int, list, list, list]]]:
    """What scan_shard gives for each shard with all blocks together."""
    found: list = []
    for block in sent or [None]:
        tests = block.value if block else Tests([], window)
        new = [scan_shard(texts, tests) for texts in shards]
        found = [[(n, _merged(a + b), sorted({*i, *j}), m + k) for (n, a, i, m), (_, b, j, k) in zip(x, y)] for x, y in zip(found, new)] if found else new
        if len(sent) > 1:
            # held again when its turn comes: a worker has one block in memory
            del tests
            block.__dict__.pop("_value", None)
    return found


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """Lists of shards of about GROUP_BYTES of text."""
    held, size = [], 0
    for shard in blocks(batches, column, SHARD_BYTES):
        held.append(shard)
        size += shard.column(shard.schema.get_field_index(column)).nbytes
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", *, window: int = WINDOW, id_column: str = "doc_id",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, n_words, spans (word ranges inside some occurrence), items, matches (the
    longest verbatim matches and where they are), one row per row of docs: one pass, no shuffle."""
    names = ["doc_id", "n_words", "spans", "items", "matches"]
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sent = _sent(docs, benchmark, item_column, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _grouped(batches, "text"):
            for shard, found in zip(shards, _through_blocks([s.column(1) for s in shards], sent, window)):
                yield pa.RecordBatch.from_arrays(
                    [
                        shard.column(0),
                        pa.array([r[0] for r in found], pa.int64()),
                        pa.array([r[1] for r in found], pa.list_(pa.list_(pa.int32()))),
                        pa.array([r[2] for r in found], pa.list_(pa.string())),
                        pa.array([[dict(zip(_FIELDS, m)) for m in r[3]] for r in found], _MATCH_TYPE),
                    ],
                    names,
                )

    return rows.transform(through, run, f"doc_id long, n_words long, spans array<array<int>>, items array<string>, matches {_MATCHES}")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the scan."""
    merged = F.array_sort("items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(merged, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, window: int = WINDOW, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that a window occurs in: one pass over whole rows, no join."""
    sent = _sent(docs, benchmark, item_column, item_text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _grouped(batches, text):
            columns = [s.column(s.schema.get_field_index(text)) for s in shards]
            for shard, found in zip(shards, _through_blocks(columns, sent, window)):
                yield shard.filter(pa.array([not r[1] for r in found], pa.bool_()))

    return docs.transform(through, run, docs.schema)
