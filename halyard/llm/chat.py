"""Chat formatting over a prefix tree of turns.

Conversations that share initial turns share tree nodes: a node is the chain of all turns
up to it. The tree is emitted once, depth-first; every conversation keeps the position
of its text (counted from its own first turn) and the intervals of the emission that hold
its ancestors and itself, which is what each of its turns may attend to.

A node belongs to the least conversation id that passes through it, so a conversation
owns the end of its own path (or nothing, if all its turns are shared) and its path
is a list of (owner, run of turns). A node, or an owner, that many conversations share is a hot
key; the few such keys are broadcast (`join_hot`), so their conversations stay where they are. Sorted by [owner, -run, owner, -run, ...] the owners come
in depth-first order; emission offsets are sums over that sort. No tree is gathered:
a first turn that all conversations share makes one node and many short rows.

Template: `<turn>` role, newline, text, `</turn>`, newline. Inside roles and texts a
backslash is put before each backslash and before each control string, and before a
newline inside a role, so reading back is exact.

Null roles and texts count as empty; a null conversation id is a conversation; very long texts
are formatted whole. Turns are ordered by turn, then role, then text, which settles ties.
Repeated rows are turns of their own. Further columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import join_hot, partitions, settle, through

OPEN, CLOSE = "<turn>", "</turn>"
_CONTROL = re.compile(r"\\|(?=</?turn>)")
_ROLE_CONTROL = re.compile(r"\\|(?=</?turn>)|(?=\n)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/?turn>))*+)</turn>\n", re.S)
ANSWERS = "assistant"


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and how long it is there."""
    head, body = f"{OPEN}{escape(role, _ROLE_CONTROL)}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


#: Conversations inside the tree: wide enough for a null's number below all of 64 bits.
_KEY, _NULL = "decimal(20,0)", str(-(1 << 63) - 1)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, at, size, piece, loss_at, loss_size: a row for each turn.

    Turns stream through in order; only a digest and an offset are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, started, digest, depth, at = None, False, b"", 0, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not started or conv != last:
                    last, started, digest, depth, at = conv, True, b"", 0, 0
                piece, text_at, size = format_turn(role, text)
                digest = hashlib.sha256(digest + piece.encode("utf-8", "surrogatepass")).digest()
                loss = size if role == ANSWERS else 0
                for column, x in zip(out, (conv, depth, digest[:16].hex(), at, len(piece), piece, text_at, loss)):
                    column.append(x)
                depth += 1
                at += len(piece)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "depth", "node", "at", "size", "piece", "loss_at", "loss_size"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").transform(through, run, "conv_id long, depth long, node string, at long, size long, piece string, loss_at long, loss_size long"
    )


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, runs).

    nodes: node, owner, depth, piece, loss_at, loss_size, emitted_at, position, size: each
    distinct turn chain once, with its place in the emission and its first position id.
    runs: conv_id, owner, from_depth, to_depth, start, end, position: the intervals of
    the emission that make up each conversation, ancestors first.
    """
    turns = settle(paths(conversations).withColumn("conv_id", F.coalesce(F.col("conv_id").cast(_KEY), F.lit(_NULL).cast(_KEY))))
    nodes = turns.groupBy("node").agg(
        F.min("conv_id").alias("owner"),
        *[F.min(c).alias(c) for c in ("depth", "at", "size", "loss_at", "loss_size")],
        F.min("piece").alias("piece"),
    )
    nodes = settle(nodes)
    owned = join_hot(turns.select("conv_id", "node"), nodes.select("node", "owner", "depth", "at", "size"), "node")
    runs = settle(
        owned.groupBy("conv_id", "owner").agg(
            F.min("depth").alias("from_depth"), (F.max("depth") + 1).alias("to_depth"), F.min("at").alias("at"), F.sum("size").alias("size")
        )
    )
    keyed = runs.groupBy("conv_id").agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("from_depth", "to_depth", "owner"))),
                lambda r: F.array(r["owner"], (r["from_depth"] - r["to_depth"]).cast(_KEY)),
            )
        ).alias("key")
    )
    own = runs.filter("conv_id = owner").select("owner", F.col("at").alias("own_at"), F.col("size").alias("own_size"))
    chunks = own.join(keyed, own["owner"] == keyed["conv_id"]).select("owner", "own_at", "own_size", "key")
    parts = partitions(turns.sparkSession)
    chunks = settle(
        chunks.repartitionByRange(parts, "key", "owner").sortWithinPartitions("key", "owner").withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    first = chunks.groupBy("part").agg(F.sum("own_size").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("key", "owner").rowsBetween(Window.unboundedPreceding, 0)
    starts = chunks.withColumn("sum", F.sum("own_size").over(inside)).join(first, "part").select(
        "owner", "own_at", (F.col("first") + F.col("sum") - F.col("own_size")).alias("chunk_at")
    )
    starts = settle(starts)
    placed = join_hot(nodes, starts, "owner").select(
        "node", "owner", "depth", "piece", "loss_at", "loss_size", "size",
        (F.col("chunk_at") + F.col("at") - F.col("own_at")).alias("emitted_at"), F.col("at").alias("position"),
    )
    lined = join_hot(runs, starts, "owner").select(
        "conv_id", "owner", "from_depth", "to_depth",
        (F.col("chunk_at") + F.col("at") - F.col("own_at")).alias("start"),
        (F.col("chunk_at") + F.col("at") - F.col("own_at") + F.col("size")).alias("end"),
        F.col("at").alias("position"),
    )
    return placed, lined


def read_back(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per conversation, from the emitted tree alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, intervals (start-end of the emission, joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "intervals"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        last, turns = None, 0
        done: list[list] = [[] for _ in names]

        def close() -> None:
            if turns:
                row = (last, turns, all_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), chars, ",".join(f"{a}-{b}" for a, b in spans))
                for column, x in zip(done, row):
                    column.append(x)

        for batch in batches:
            for conv, piece, loss_at, loss_size, start in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not turns or conv != last:
                    close()
                    last, turns, loss_chars, chars, spans = conv, 0, 0, 0, []
                    all_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                ((role, text),) = parse(piece)
                turns += 1
                all_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(piece[loss_at : loss_at + loss_size])
                loss_chars += len(masked)
                loss_sha.update(masked.encode("utf-8", "surrogatepass"))
                chars += len(piece)
                if spans and spans[-1][1] == start:
                    spans[-1][1] = start + len(piece)
                else:
                    spans.append([start, start + len(piece)])
            if len(done[0]) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names)
                done = [[] for _ in names]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names)

    spread = runs.select("conv_id", "owner", F.explode(F.sequence("from_depth", F.col("to_depth") - 1)).alias("depth"))
    rows = join_hot(spread, nodes, "owner", "depth").select("conv_id", "depth", "piece", "loss_at", "loss_size", F.col("emitted_at").alias("start"))
    ordered = rows.repartition(partitions(nodes.sparkSession), "conv_id").sortWithinPartitions("conv_id", "depth")
    given = F.when(F.col("conv_id") > F.lit(_NULL).cast(_KEY), F.col("conv_id")).cast("long").alias("conv_id")
    return ordered.select(given, "piece", "loss_at", "loss_size", "start").transform(through, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, intervals string"
    )
