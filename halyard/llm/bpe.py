"""BPE encoding and decoding over a contiguous rank array.

Short words: one array holds the ranks of all adjacent pairs beside the boundaries of
the parts. The least rank is found by scanning the array; its boundary is deleted and
only the two neighbouring ranks are looked up again. A word longer than SCAN_LIMIT bytes
would make that scan quadratic; there the same merges are drawn from a heap.

Merging by the vocabulary's pair list (not by ranks of concatenations) gives what the
tokenizers library gives, and each distinct word is encoded once per worker until the
bounded cache lets it go.

Null and empty texts encode to no ids; very long texts are encoded whole, in time near to
linear. The string of an added token becomes its id; of overlapping ones the longest at the first
place counts. Repeated rows give repeated results; further columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._blocks import blocks, through

VOCABULARY = "byte_bpe_50k.json"
#: Words of at most so many bytes use the scanned rank array.
SCAN_LIMIT = 256
#: Words in each half of a worker's cache; a full young half becomes the old one.
CACHE_WORDS = 200_000
#: Longer words are not cached.
CACHE_WORD_CHARS = 64
NO_PAIR = 1 << 40

#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    letters stand for themselves, the others count up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return letters | {chr(0x100 + k): b for k, b in enumerate(others)}


class Encoder:
    """Byte-level BPE from a tokenizers file. `encode` gives ids, `decode` a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: s.encode() for s, i in added.items()}
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in s)
        #: rank of each adjacent pair, keyed by both ids, and the merged id of each rank
        self.pairs: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.words = regex.compile(PATTERN).findall
        self.added = added
        self.split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split
            if added
            else None
        )
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.split and any(s in text for s in self.added):
            for piece in self.split(text):
                if piece in self.added:
                    ids.append(self.added[piece])
                else:
                    self._plain(piece, ids)
        else:
            self._plain(text, ids)
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        cache, extend, miss = self.cache, ids.extend, self._miss
        for word in self.words(text):
            if word in cache:
                extend(cache[word])
            else:
                extend(miss(word))

    def _miss(self, word: str) -> tuple[int, ...]:
        out = self.older.get(word)
        if out is None:
            raw = word.encode("utf-8", "surrogatepass")
            out = self._scan(raw) if len(raw) <= SCAN_LIMIT else self._heap(raw)
            if len(word) > CACHE_WORD_CHARS:
                return out
        # what is met again moves to the young half before the old one is dropped
        if len(self.cache) >= CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        self.cache[word] = out
        return out

    def _scan(self, raw: bytes) -> tuple[int, ...]:
        """The contiguous array: parts[i] is the id that starts at the i-th boundary,
        ranks[i] the rank of the pair (parts[i], parts[i + 1])."""
        rank, merged, first = self.pairs.get, self.merged, self.first
        parts = [first[b] for b in raw]
        ranks = [rank(a << 32 | b, NO_PAIR) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_PAIR:
                break
            i = ranks.index(least)
            parts[i] = own = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(own << 32 | parts[i + 1], NO_PAIR)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | own, NO_PAIR)
        return tuple(parts)

    def _heap(self, raw: bytes) -> tuple[int, ...]:
        pairs, parts, n = self.pairs, [self.first[b] for b in raw], len(raw)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [
            (found, i, parts[i], parts[i + 1])
            for i in range(n - 1)
            if (found := pairs.get(parts[i] << 32 | parts[i + 1])) is not None
        ]
        heapq.heapify(queue)
        while queue:
            found, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[found], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get(parts[i] << 32 | parts[k])) is not None:
                    heapq.heappush(queue, (found, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (found := pairs.get(parts[h] << 32 | parts[i])) is not None:
                heapq.heappush(queue, (found, h, parts[h], parts[i]))
        return tuple(p for p in parts if p >= 0)

    def count(self, text: str) -> int:
        """The number of ids, without joining them."""
        if self.split and any(s in text for s in self.added):
            return len(self.encode(text))
        cache, miss, total = self.cache, self._miss, 0
        for word in self.words(text):
            total += len(cache[word] if word in cache else miss(word))
        return total

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(
    docs: DataFrame, text: str = "text", vocabulary: str | None = None, *, keep_ids: bool = False,
    id_column: str = "doc_id",
) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also the ids
    and the decoded text. One pass without a shuffle; any row can be made again alone."""
    path = vocabulary or vocabulary_path()
    more = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        numbers = {i: str(i) for i in own.bytes_of}
        for block in blocks(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("n", "ids", "sha", "back", "text")}
            for t in block.column(1).to_pylist():
                ids = own.encode(t or "")
                back = own.decode(ids)
                out["n"].append(len(ids))
                out["sha"].append(hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest())
                out["back"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if keep_ids:
                    out["ids"].append(np.array(ids, np.int32))
                    out["text"].append(back)
            columns = [block.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sha"]), pa.array(out["back"])]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text")).transform(through, run, f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    )


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None, *, id_column: str = "doc_id") -> DataFrame:
    """id and n_tokens of each row."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for block in blocks(batches, "text"):
            n = [own.count(t) if t else 0 for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64())], [id_column, "n_tokens"])

    return docs.select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text")).transform(through, run, f"`{id_column}` long, n_tokens long"
    )
