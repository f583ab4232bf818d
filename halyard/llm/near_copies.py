"""Near copies at a stated similarity: SimHash by pigeonring, bands of a MinHash, exact sets.

Texts get the SimHash fingerprints of op4, and its pigeonring search (segments on a ring, chain
test, full Hamming test) finds those that differ in at most two bits. Each class of equal
fingerprints is a star about its least text, and linked fingerprints join their stars.
That sees only the closest copies, so more candidates come from a second search: each text has
a one-permutation MinHash of 512 bins, cut into 64 bands of eight bins. Texts that agree on a
band meet. Texts alike by 0.8 agree on a bin with chance 0.8 wherever and however they were
edited, so all but 1 - (1 - 0.8**8)**64, or 8 in a million, of them meet; texts alike by less
meet more rarely and unrelated ones hardly ever.

All pairs of a small group are compared. A large one is first linked along chains, in blocks
and in an order of its own for each band; then every pair of blocks is compared in a task of
its own between what is still apart. There the texts of up to SET_LIMIT shingles bring the set
itself, so that the many pairs of a family that are nearly but not quite alike end in that task.
No candidate is dropped, however large the group. Fingerprints, bins and sets only choose which
pairs are proven, and both searches' candidates are; a link is a pair whose whole sets of shingles are alike by the similarity.

Null and empty texts and texts without words are copies of each other; very long texts are
read whole. A row whose id and text repeat counts once; rows that share an id, or have none,
and differ in text are rows of their own. Ties for the row that stays go to the least id, then
the least hash of the text. Further columns are kept, whatever their names. An empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints, simhash
from ._blocks import SPACES, blocks, bounded, chained, fresh, lower_bytes, mix, release, settle_clean, span_hashes, text_buffers, through, word_spans, word_table
from .components import components

WORDS = 5
BINS = 512
#: Bins of one band: eight bins of eight bits are one 64-bit key.
BAND = 8
BANDS = BINS // BAND
#: Larger groups are first thinned by chains of their members, then compared between components.
SMALL = 32
BLOCK = 1024
#: Pairs are compared exactly where the estimate (sd 0.025 at most) is no further below the similarity.
MARGIN = 0.12
#: The same for two texts of more than SET_LIMIT shingles, whose bins are all filled (sd 0.018).
MARGIN_LONG = 0.09
#: Shingles of a text whose set goes to the comparison of blocks, four bytes each.
SET_LIMIT = 512
_INSIDE = word_table(spaces=SPACES)
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of all texts, repeats and all, and each text's range of them.

    Fewer than five words are one shingle."""
    starts, stops, bounds = word_spans(lower_bytes(raw), ends, _INSIDE)
    counts = np.diff(bounds)
    hashes = span_hashes(lower_bytes(raw), starts, stops)
    five = chained(hashes, WORDS)
    values = np.zeros(len(hashes), np.uint64)
    values[: len(five)] = five
    kept = np.arange(len(hashes)) + WORDS <= np.repeat(bounds[1:], counts)
    for k in np.flatnonzero((counts > 0) & (counts < WORDS)).tolist():
        values[bounds[k]] = chained(hashes[bounds[k] : bounds[k + 1]], int(counts[k]))[0] + np.uint64(counts[k])
        kept[bounds[k]] = True
    return values[kept], np.r_[0, np.cumsum(np.where(counts < WORDS, np.minimum(counts, 1), counts - WORDS + 1))]


def nodes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for the shingles of each text."""
    values, bounds = shingles(raw, ends)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(mix(values ^ np.uint64(0xA0761D6478BD642F)))]
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def bands(bins: np.ndarray) -> np.ndarray:
    """The keys of each row of bins, one a band."""
    return mix(np.ascontiguousarray(bins).view(np.uint64) ^ _SEEDS[None, :]).view(np.int64)


def points(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """node, least (doc_id), fp, bins: one row for each distinct text, but for spaces and case.

    fp: the SimHash fingerprint of op4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            raw, ends = text_buffers(block.column(1))
            bins, _ = fingerprints.sketch(raw, ends, BINS, 8)
            fp = np.array([simhash.text_fingerprint(t) for t in block.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(nodes(raw, ends)), pa.array(fp), pa.array([x.tobytes() for x in bins], pa.binary())], ["doc_id", "node", "fp", "bins"]
            )

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    made = rows.transform(through, run, "doc_id long, node long, fp long, bins binary")
    return made.groupBy("node", "bins").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp")).select("node", "least", "fp", "bins")


def ring_pairs(found: DataFrame) -> DataFrame:
    """u, v: texts whose fingerprints are equal or linked by pigeonring; the components are those of op4."""
    # node 0 has no shingles: it is one point already
    own = found.filter("node <> 0").select("fp", "node")
    first = settle_clean(own.groupBy("fp").agg(F.min("node").alias("first")))
    same = own.join(first, "fp").filter("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    linked = simhash.links(first.select("fp"))
    ends = linked.join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u")
    ends = ends.join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    return same.union(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _bins(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _shared_bands(found: DataFrame) -> DataFrame:
    """node, part, n: the band keys that a text shares with n - 1 others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                own = bands(_bins(piece.column(1)))
                node = np.repeat(piece.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own.ravel())], ["node", "part"])

    # node 0 has no shingles: it is one point already
    keys = found.filter("node <> 0").select("node", "bins").transform(through, run, "node long, part long")
    sizes = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(sizes, "part")


def _alike(bins: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs (i, j) agree in so many bins."""
    chance = 2.0**-8
    hit = [np.zeros(0, np.int64)]
    for p in range(0, len(i), 16_384):
        same = (bins[i[p : p + 16_384]] == bins[j[p : p + 16_384]]).mean(1)
        hit.append(p + np.flatnonzero((same - chance) / (1 - chance) >= least))
    return np.concatenate(hit)


def _first(view: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band in which the pairs agree; a pair counts in the group of that band only."""
    return (view[i] == view[j]).argmax(1)


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own: the sorted low halves of the hashes of the shingles of the wanted nodes'
    texts; null for texts of more than SET_LIMIT shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, bounds = shingles(*text_buffers(block.column(1)))
            sets = [np.unique(values[a:b].astype(np.uint32)) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([x.tobytes() if len(x) <= SET_LIMIT else None for x in sets], pa.binary())], ["node", "words"])

    # texts come out of one Python worker; settled first, they don't need a second one in the same task
    held = settle_clean(texts.join(bounded(wanted), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    return settle_clean(held.transform(through, run, "node long, words binary"))


def _close_sets(words: list, i: np.ndarray, j: np.ndarray, bins: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs are alike by their sets, with a little to spare for equal halves of hashes,
    or, where a text has too many shingles for a set, by the bins with MARGIN_LONG to spare."""
    keep = np.ones(len(i), bool)
    unknown = np.array([words[a] is None or words[b] is None for a, b in zip(i.tolist(), j.tolist())], bool)
    for k in np.flatnonzero(~unknown).tolist():
        a, b = words[i[k]], words[j[k]]
        joined = np.concatenate([a, b])
        joined.sort()
        shared = np.count_nonzero(joined[1:] == joined[:-1])
        keep[k] = shared >= (similarity - 0.01) * (len(joined) - shared)
    far = np.flatnonzero(unknown)
    keep[far] = False
    keep[far[_alike(bins, i[far], j[far], similarity - MARGIN_LONG)]] = True
    return np.flatnonzero(keep)


def _compare(held: DataFrame, found: DataFrame, similarity: float, sets: DataFrame | None = None) -> DataFrame:
    """u, v: pairs of held (node, part, block_a, block_b, own, side, chain) that meet and agree.

    Rows of a chain meet the next row only; others meet those of another side, and in a task of
    two blocks those of the other block."""
    least, with_sets = similarity - MARGIN, sets is not None

    def compare(table: pa.Table) -> pa.RecordBatch:
        node, part, side, own, chain = (table[c].to_numpy() for c in ("node", "part", "side", "own", "chain"))
        bins = _bins(table["bins"])
        view = bands(bins)
        words = [None if x is None else np.frombuffer(x, np.uint32) for x in table["words"].to_pylist()] if with_sets else None
        key = np.stack([table[c].to_numpy() for c in ("part", "block_a", "block_b")])
        two = key[1] != key[2]
        starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, len(node)]
        sizes = np.diff(starts)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            near = np.flatnonzero((side[i] != side[j]) & ~(two[i] & (own[i] == own[j])))
            i, j = i[near], j[near]
            hit = _alike(bins, i, j, least)
            i, j = i[hit], j[hit]
            hit = np.flatnonzero(view[i, _first(view, i, j)] == part[i])
            i, j = i[hit], j[hit]
            if words is not None:
                hit = _close_sets(words, i, j, bins, similarity)
                i, j = i[hit], j[hit]
            left.append(i)
            right.append(j)

        linked = np.flatnonzero((key[:, 1:] == key[:, :-1]).all(0) & chain[1:])
        hit = _alike(bins, linked, linked + 1, least)
        left.append(linked[hit])
        right.append(linked[hit] + 1)
        single = ~chain[np.minimum(starts[:-1], len(chain) - 1)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL) & single]).tolist():
            at = starts[:-1][(sizes == size) & single]
            i, j = np.triu_indices(size, 1)
            for p in range(0, len(at), max(1, 20_000 // len(i))):
                some = at[p : p + max(1, 20_000 // len(i)), None]
                meet((some + i).ravel(), (some + j).ravel())
        for k in np.flatnonzero((sizes > SMALL) & single).tolist():
            for i in range(starts[k], starts[k + 1] - 1):
                j = np.arange(i + 1, starts[k + 1])
                meet(np.full(len(j), i), j)
        u, v = node[np.concatenate(left)], node[np.concatenate(right)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count < 8_000:
                continue
            table = pa.concat_tables(held).combine_chunks()
            key = np.stack([table[c].to_numpy() for c in ("part", "block_a", "block_b")])
            # the last key's rows may go on in the next batch
            last = int(np.flatnonzero((key != key[:, -1:]).any(0)).max(initial=-1)) + 1
            if last:
                yield compare(table.slice(0, last))
            held, count = [table.slice(last)], table.num_rows - last
        if count:
            yield compare(pa.concat_tables(held))

    order = F.xxhash64("part", "node")
    held = held.join(found.select("node", "bins"), "node")
    if sets is not None:
        held = held.join(sets, "node", "left")
    dealt = held.withColumn("order", order).repartition("part", "block_a", "block_b")
    return dealt.sortWithinPartitions("part", "block_a", "block_b", "order").transform(through, run, "u long, v long")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """node, text of all rows that have a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(nodes(*text_buffers(block.column(0)))), block.column(0)], ["node", "text"])

    rows = docs.select(docs[text].cast("string").alias("text")).filter("text is not null")
    return rows.transform(through, run, "node long, text string")


def _proven(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are alike by the similarity."""
    pairs = settle_clean(pairs)
    needed = bounded(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node"))
    held = settle_clean(texts.join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "a"):
            a, a_at = shingles(*text_buffers(block.column(2)))
            b, b_at = shingles(*text_buffers(block.column(3)))
            hit = np.zeros(block.num_rows, bool)
            for k in range(block.num_rows):
                x, y = np.unique(a[a_at[k] : a_at[k + 1]]), np.unique(b[b_at[k] : b_at[k + 1]])
                shared = len(x) + len(y) - len(np.unique(np.r_[x, y]))
                hit[k] = shared / (len(x) + len(y) - shared) >= similarity
            yield pa.RecordBatch.from_arrays([block.column(0).filter(pa.array(hit)), block.column(1).filter(pa.array(hit))], ["u", "v"])

    both = pairs.join(held.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(held.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").transform(through, run, "u long, v long")


def edges(found: DataFrame, texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """u, v: links that connect each group of near copies. texts: node, text."""
    held = settle_clean(_shared_bands(found))
    cuts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "part"), cuts).cast("int")
    # all pairs of small groups; of large ones, each block as a chain in an order of its own for each band
    chain = F.col("n") > SMALL
    once = held.select("node", "part", F.when(chain, own).otherwise(0).alias("block_a"), chain.alias("chain")).select(
        "node", "part", "block_a", F.col("block_a").alias("block_b"), F.lit(0).alias("own"), F.col("node").alias("side"), "chain"
    )
    pairs = ring_pairs(found).union(_compare(once, found, similarity)).distinct()
    links = settle_clean(_proven(pairs, texts, similarity))
    large = held.filter(chain)
    if large.isEmpty():
        return links
    # what the chains left apart: block b of a large group meets all blocks; (a, b) with a <= b names the task
    linked = components(links, settle=settle_clean)
    large = settle_clean(large.join(linked, "node", "left").withColumn("side", F.coalesce("component", "node")).drop("component"))
    apart = large.groupBy("part").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a < b").select("part")
    rest = large.join(apart, "part").withColumn("cuts", cuts).withColumn("own", own)
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "node", "part", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "own", "side", F.lit(False).alias("chain")
    )
    sets = _sets(texts, large.join(apart, "part", "left_semi").select("node").distinct())
    # each component as a star about its least node connects what its links do
    star = linked.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return star.union(_proven(_compare(rest, found, similarity, sets), texts, similarity))


def groups(docs: DataFrame, text: str = "text", similarity: float = 0.8, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(points, node -> component of the points that have near copies)."""
    found = settle_clean(points(docs, text, id_column))
    return found, components(edges(found, _texts(docs, text), similarity), settle=settle_clean)


def _named(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the node of each row's text in the column `name`."""
    (content,) = fresh(docs, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, content):
            at = block.schema.get_field_index(content)
            node = pa.array(nodes(*text_buffers(block.column(at))))
            yield pa.RecordBatch.from_arrays([*block.columns[:at], node], [*block.schema.names[:at], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.withColumn(content, F.col(text).cast("string")).transform(through, run, schema)


def keep_one(docs: DataFrame, text: str = "text", similarity: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """One row of docs for each group of near copies, with all its columns: that of the least id,
    and among texts of that id of the least node. A null comes after all ids.

    Rows fold into one only if both their id and their node are the same; the row with the
    least hash stays."""
    found, linked = groups(docs, text, similarity, id_column)
    named = found.select("node", "least").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.col("least").isNull().alias("none"), "least", "node")
    kept = named.groupBy("component").agg(F.min(first).alias("k"))
    # both sides are keyed by (node, id or 0, no id), so that the join reuses the rows' exchange
    node, key, none, one = fresh(docs, "node", "key", "none", "row")
    kept = kept.select(F.col("k.node").alias(node), F.coalesce("k.least", F.lit(0)).alias(key), F.col("k.least").isNull().alias(none))
    own = F.col(id_column).cast("long")
    rows = _named(docs, text, node).withColumn(key, F.coalesce(own, F.lit(0))).withColumn(none, own.isNull())
    row = F.struct(*[F.col(c) for c in docs.columns])
    release(docs.sparkSession)
    rows = rows.groupBy(node, key, none).agg(F.min_by(row, F.xxhash64(*[F.col(c) for c in docs.columns])).alias(one))
    return rows.join(kept, [node, key, none], "left_semi").select(f"{one}.*")
