"""Language ID with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the typical byte n-grams of all languages: each slot is a
mask with one bit for each language, a lookup is the AND of an n-gram's slots and returns
all languages that contain it. A text's votes are, for each language, the number of its
n-grams found, corrected for the filter's false positives (its fill to the power of the
number of hashes). The most votes decide; ties go to the first language by name.

Learned from labelled rows only: SAMPLE_ROWS rows of each language, or all if there are fewer,
those whose hash of id and text is least.
An n-gram is typical of a language if it is among its KEPT most frequent and at least half as
frequent there as in the language where it is most frequent.

Null and empty texts and texts without letters are `und` with score 0; very long texts are
read whole. With nothing learned all are `und`. Ties go to the first language by name;
repeated rows repeat their results; further columns are ignored by `identify` and kept by
`keep_known`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import blocks, mix, partitions, through

ORDERS = (3, 4)
SAMPLE_ROWS = 4_000
#: So many times the wanted rows (and a hundred more) are drawn first.
DRAWN = 1.5
KEPT = 20_000
HASHES = 3
SLOT_BITS = 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters and bytes of other code points stay, the rest parts words.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _folded(text: str | None) -> bytes:
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)
    return b" " + b" ".join(raw.split()) + b" "


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all texts and the number of each text's."""
    folded = [_folded(t) for t in texts]
    sizes = np.array([len(x) for x in folded])
    raw = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint64)
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    packed = np.zeros(n, np.uint64)
    for k in range(order):
        packed = packed << np.uint64(8) | raw[k : k + n]
    ends = np.cumsum(sizes)
    inside = np.ones(n, bool)
    for k in range(1, order):
        cut = ends - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return packed[inside] | np.uint64(order) << np.uint64(60), np.maximum(sizes - order + 1, 0)


class Filter:
    """The bit-sliced filter: `planes` of 64 languages by slots."""

    def __init__(self, languages: list[str], found: dict[str, np.ndarray], slot_bits: int = SLOT_BITS, hashes: int = HASHES):
        self.languages, self.slot_bits, self.hashes = languages, slot_bits, hashes
        width = next(w for w in (8, 16, 32, 64) if w >= min(len(languages), 64) or w == 64)
        self.kind = np.dtype(f"uint{width}").type
        self.planes = [np.zeros(1 << slot_bits, self.kind) for _ in range(-(-len(languages) // 64))]
        for k, name in enumerate(languages):
            plane, bit = self.planes[k // 64], self.kind(1 << (k % 64))
            for at in self._slots(found[name]):
                plane[at] |= bit
        fill = [np.count_nonzero(self.planes[k // 64] & self.kind(1 << (k % 64))) / (1 << slot_bits) for k in range(len(languages))]
        self.false = np.array(fill) ** hashes

    def _slots(self, packed: np.ndarray) -> list[np.ndarray]:
        h = mix(packed)
        keep = np.uint64((1 << self.slot_bits) - 1)
        return [((h >> np.uint64(self.slot_bits * k)) & keep).astype(np.int64) for k in range(self.hashes)]

    def votes(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Corrected number of each text's n-grams in each language."""
        at = self._slots(packed)
        bounds = np.r_[0, np.cumsum(counts)]
        out = np.zeros((len(counts), len(self.languages)))
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for more in at[1:]:
                mask = mask & plane[more]
            for k in range(64 * p, min(64 * p + 64, len(self.languages))):
                bit = np.zeros(len(packed) + 1, np.int32)
                np.cumsum((mask >> self.kind(k % 64)) & self.kind(1), out=bit[1:], dtype=np.int32)
                out[:, k] = bit[bounds[1:]] - bit[bounds[:-1]]
        total = counts[:, None]
        return np.clip((out - total * self.false) / (1 - self.false), 0, total)

    def predict(self, texts: list[str | None], orders=ORDERS) -> tuple[list[str], list[float]]:
        votes, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for order in orders:
            packed, counts = grams(texts, order)
            votes += self.votes(packed, counts)
            total += counts
        best = votes.argmax(1) if self.languages else np.zeros(len(texts), int)
        names, scores = [], []
        for k, t in enumerate(texts):
            if not self.languages or not t or not _LETTER.search(t):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                names.append(self.languages[best[k]])
                scores.append(float(min(1.0, votes[k, best[k]] / max(total[k], 1))))
        return names, scores


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", orders=ORDERS, sample_rows: int = SAMPLE_ROWS, kept: int = KEPT) -> Filter:
    """A filter from labelled rows. The driver gets at most `kept` n-grams of each language."""
    labelled = labelled.filter(labelled[lang].isNotNull() & labelled[text].isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filter([], {})
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(id_column), F.col(text), F.lit(11)).alias("draw"))
    # a threshold on the draw, as a double between 0 and 1, lets through a little more than is wanted ...
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(min(1.0, (DRAWN * sample_rows + 100) / sizes[name]))).otherwise(share)
    drawn = rows.filter(F.col("draw").cast("double") / 2.0**64 + 0.5 <= share)
    # ... and the rows of the least draws stay, each partition's first ones alone being moved
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = drawn.withColumn("place", place).filter(F.col("place") <= sample_rows).select("lang", "text")
    sample = sample.repartition(partitions(labelled.sparkSession))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            names, texts = block.column(0).to_pylist(), block.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t for n, t in zip(names, texts) if n == name]
                for order in orders:
                    found, n = np.unique(grams(own, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                    )

    counted = sample.transform(through, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.filter("n > 1")
    # the sample is bounded, so a language's n-grams are too
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counted.withColumn("rate", rate).withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
    typical = rated.filter("rate >= most / 2").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    rows = typical.filter(F.col("place") <= kept).select("lang", "gram").toPandas()
    found = {name: rows.loc[rows["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64) for name in languages}
    return Filter(languages, found)


def predict(docs: DataFrame, own: Filter, text: str = "text", id_column: str = "doc_id", orders=ORDERS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            names, scores = sent.value.predict(block.column(2).to_pylist(), orders)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.transform(through, run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    return predict(docs, learn(docs.filter(~held_out(id_column)), text, lang, id_column), text, id_column)


def keep_known(docs: DataFrame, least_score: float, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """docs without the rows whose language is unknown or scores below `least_score`; one
    pass, whole rows, no join."""
    own = learn(docs.filter(~held_out(id_column)), text, lang, id_column)
    sent = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            names, scores = sent.value.predict(block.column(block.schema.get_field_index(text)).to_pylist())
            keep = [n != UNKNOWN and s >= least_score for n, s in zip(names, scores)]
            yield block.filter(pa.array(keep, pa.bool_()))

    return docs.transform(through, run, docs.schema)
