"""Spelling variants by Aho-Corasick halves.

Words are counted in one pass. A word's two halves (the first length // 2 code points, and the
rest) go into automata; of two words one edit apart, one keeps a half of the other whole, at its
very start or its very end. An automaton shard holds the halves of up to about OWNERS words that
begin (left halves) or end (right halves) with the same two code points, and every word is run
through the shards of its own first and last two: no other can match. There are at most 90 * 90 such
pairs on each side, so their table of sizes is broadcast; a common pair is cut into more shards, and the
words run through one shard into parts of about SCANNED, so no task grows with a pair. Of the
halves that the automaton reports those count that stand at the word's edge and whose owners' length is
within one. What is left beside the half is then verified to be exactly one inserted, deleted or
replaced code point away, by looking up what remains with one place open among the owners of that
half; so owners that share a half are never paired with all words that have it.
A pair whose left half is whole is reported by the left shard alone.

Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lowered. `thinned` leaves out one code point
of the runs that a checksum of document and run picks. Equal words within half a megabyte of text
are told by 64-bit hashes.

A null or empty text has no runs; very long texts and runs are read whole; a null doc_id is written as
nothing in the checksum; repeated rows count each; of near words with the same n the smallest in
code-point order is the form; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, settle, span_hashes, text_buffers, through, word_spans

#: About so many words' halves in one automaton.
OWNERS = 8_192
#: About so many words are run through a copy of it.
SCANNED = 16_384
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Code points of the shortest word.
LEAST_LENGTH = 5
#: One run in so many loses a code point.
THINNED = 97

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: U+00C0 to U+00FF are this byte and one more.
_LEAD = 0xC3
_IS_RUN = np.array([False, True] + [False] * 254)


def _crc_table() -> np.ndarray:
    """What the shift register holds after each single byte, without start and end inversion."""
    return np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


_CRC = _crc_table()
#: Runs of more bytes than this are summed one by one.
_CRC_BYTES = 64


def checksums(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span's bytes after a prefix whose crc32 is `before`, a byte of all spans at a time."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = stops - starts
    live = np.flatnonzero(size <= _CRC_BYTES)
    live = live[np.argsort(-size[live], kind="stable")]
    falling = -size[live]
    for k in range(int(size[live[0]]) if len(live) else 0):
        live = live[: int(np.searchsorted(falling[: len(live)], -k, "left"))]
        held = state[live]
        state[live] = _CRC[(held ^ raw[starts[live] + k]) & np.uint32(0xFF)] ^ (held >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _CRC_BYTES):
        out[i] = zlib.crc32(raw[starts[i] : stops[i]].tobytes(), int(before[i]))
    return out


def count_block(texts: pa.Array, ids: pa.Array, held: dict[bytes, int], thinned: int | None, least: int = LEAST_LENGTH) -> None:
    """Adds the words of a block of texts to held."""
    raw, ends = text_buffers(texts)
    raw = raw + ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) * np.uint8(32)
    lead = raw == _LEAD
    inside = _LETTERS[raw] | lead
    inside[1:] |= lead[:-1]
    starts, stops, bounds = word_spans(inside.astype(np.uint8), ends, _IS_RUN)
    if not len(starts):
        return
    leads = np.r_[0, np.cumsum(lead)]
    length = stops - starts - (leads[stops] - leads[starts])
    picked = np.zeros(len(starts), bool)
    if thinned:
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        sums = checksums(raw, starts, stops, np.repeat(prefix, np.diff(bounds)))
        picked = sums % np.uint32(thinned) == 0
        for i in np.flatnonzero(picked & (length > least)):
            run = raw[starts[i] : stops[i]].tobytes().decode()
            at = int(sums[i]) % len(run)
            word = (run[:at] + run[at + 1 :]).encode()
            held[word] = held.get(word, 0) + 1
    whole = np.flatnonzero(~picked & (length >= least))
    if len(whole):
        _, first, counts = np.unique(span_hashes(raw, starts[whole], stops[whole]), return_index=True, return_counts=True)
        data = raw.tobytes()
        for a, b, n in zip(starts[whole[first]].tolist(), stops[whole[first]].tolist(), counts.tolist()):
            word = data[a:b]
            held[word] = held.get(word, 0) + n


def count_words(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", thinned: int | None = THINNED, least_length: int = LEAST_LENGTH, least_count: int = 3) -> DataFrame:
    """word, n: how often each word occurs, of those with `least_count` occurrences or more."""
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text"))

    def sent(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for block in blocks(batches, "text"):
            count_block(block.column(1), block.column(0), held, thinned, least_length)
            if len(held) > HELD_WORDS:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    counted = rows.transform(through, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Shard:
    """The automaton of one shard's halves, and what stands beside them with one place open."""

    def __init__(self, left: bool, owners: list[tuple[str, int]]):
        self.left, self.owners = left, owners
        self.automaton = ahocorasick.Automaton()
        #: (half's number, owner's length, kind, what remains) -> owners
        self.beside: dict[tuple, list[int]] = {}
        numbers: dict[str, int] = {}
        #: lengths of the owners of each half
        self.lengths: list[set[int]] = []
        for k, (word, _) in enumerate(owners):
            size, cut = len(word), len(word) // 2
            half, rest = (word[:cut], word[cut:]) if left else (word[cut:], word[:cut])
            number = numbers.setdefault(half, len(numbers))
            if number == len(self.lengths):
                self.lengths.append(set())
                self.automaton.add_word(half, (number, len(half)))
            self.lengths[number].add(size)
            self._put((number, size, "same", rest), k)
            for at in range(len(rest)):
                shorter = rest[:at] + rest[at + 1 :]
                self._put((number, size, at, shorter), k)
                # the same letter twice in a row leaves the same word: once is enough
                if at == 0 or rest[at] != rest[at - 1]:
                    self._put((number, size, "less", shorter), k)
        if owners:
            self.automaton.make_automaton()

    def _put(self, key: tuple, owner: int) -> None:
        self.beside.setdefault(key, []).append(owner)

    def near(self, word: str) -> set[int]:
        """The owners that are exactly one edit from word, by this side's halves."""
        found: set[int] = set()
        size, look = len(word), self.beside.get
        for end, (number, width) in self.automaton.iter(word):
            # the half must stand at the word's edge
            if end != (width - 1 if self.left else size - 1):
                continue
            lengths = self.lengths[number]
            rest = word[width:] if self.left else word[: size - width]
            if size + 1 in lengths:
                found.update(look((number, size + 1, "less", rest), ()))
            if size - 1 in lengths or size in lengths:
                for at in range(len(rest)):
                    shorter = rest[:at] + rest[at + 1 :]
                    found.update(look((number, size - 1, "same", shorter), ()))
                    found.update(look((number, size, at, shorter), ()))
        kept = set()
        for k in found:
            other = self.owners[k][0]
            if other != word and (self.left or not word.startswith(other[: len(other) // 2])):
                kept.add(k)
        return kept


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (shard, owners first): each shard's words are run through its automaton as they come."""
    here, owners, shard = None, [], None
    for batch in batches:
        words, near, best_n, best = [], [], [], []
        for at, left, owner, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if at != here:
                here, owners, shard = at, [], None
            if owner:
                owners.append((word, n))
                continue
            shard = shard or Shard(left, owners)
            found = shard.near(word) if owners else ()
            if found:
                top = min((-shard.owners[k][1], shard.owners[k][0]) for k in found)
                words.append(word)
                near.append(len(found))
                best_n.append(-top[0])
                best.append(top[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, owners: int = OWNERS, scanned: int = SCANNED) -> DataFrame:
    """word, n_near, best_n, best: for each word with a near word their number and the near word of
    largest n, the smallest of those in code-point order. words: word, n, each word once."""
    ends = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.substring("word", 1, 2).alias("pair")), F.struct(F.lit(False).alias("left"), F.expr("right(word, 2)").alias("pair"))))
    sided = words.select("word", "n", ends.alias("end")).select("word", "n", "end.*")
    # at most 2 * 90 * 90 rows: the alphabet is fixed
    count = F.count(F.lit(1))
    sizes = sided.groupBy("left", "pair").agg(F.ceil(count / owners).cast("int").alias("shards"), F.ceil(count / scanned).cast("int").alias("parts"))
    placed = sided.join(F.broadcast(sizes), ["left", "pair"])

    def cells(number: str, held: str, owner: bool):
        """A word's own shard (part) with every part (shard) of its pair."""
        own = F.pmod(F.xxhash64("word"), F.col(number)).cast("int").alias(number)
        return F.transform(F.sequence(F.lit(0), F.col(held) - 1), lambda k: F.struct(own, k.alias(held), F.lit(owner).alias("owner")).alias("c"))

    # each word owns a shard, in all its copies, and is run through all shards, in its own part
    named = [F.transform(cells(*x), lambda c: F.struct(c["shards"].alias("shard"), c["parts"].alias("part"), c["owner"].alias("owner"))) for x in (("shards", "parts", True), ("parts", "shards", False))]
    rows = placed.select("left", "pair", "word", "n", F.explode(F.concat(*named)).alias("role"))
    rows = rows.select(F.concat_ws("/", "left", "pair", "role.shard", "role.part").alias("at"), "left", "role.owner", "word", "n")
    sorted_rows = rows.repartition("at").sortWithinPartitions("at", F.col("owner").desc())
    found = sorted_rows.transform(through, _scan, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """word, root of every row of links(word, form): forms followed to the last, twice as far in each
    round. A form's n is at least twice the word's, so a chain has at most log2 of the largest n steps."""
    reached = settle(links.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settle(reached.join(further, "root", "left").select("word", "root", "next"))
        if step.filter("next is not null").isEmpty():
            return reached
        reached = settle(step.select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, *, owners: int = OWNERS, scanned: int = SCANNED, times: int = 2, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = settle(count_words(docs, **options))
    joined = settle(words.join(near_words(words, owners, scanned), "word", "left"))
    better = F.col("best_n") >= times * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    roots = follow(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
