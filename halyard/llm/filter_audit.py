"""Filter interaction audit: what each of five filters removes, in every order of them.

Sort-based duplicates: rows are dealt by range of (text fingerprint, doc_id, a salt) and
sorted inside each range by fingerprint, full text and doc_id. A row is compared with its
predecessor, text against text; it is a copy if its text's least doc_id so far is smaller than
its own. Groups that may go on from an earlier range or into a later one (those of a range's first
and last fingerprint) leave a border row with their text and least doc_id; a window over the border
rows of equal text hands each range the least doc_id of the ranges before. So a group of any
size is dealt over as many tasks as it fills.

Each row's five failures are one mask. Masks are counted by (part, mask, labels); for each part these
counts add up to the rows that pass each of the 32 sets of filters, and every figure of every order
is a difference of such counters: no row is counted once for each order.

Fails: A under `least_words` words; B 100 * distinct words < `distinct_percent` * words; C 100 * A-Z
characters > `capital_percent` * code points; D holds one of #$%&*|; E the text is that of a row
with a smaller doc_id.

A null text is an empty one: no words, so A fails and B, C and D don't; all such rows are copies of
each other. A very long text is sorted and compared whole. Rows of equal text and equal doc_id tie: neither is
smaller, so neither makes the other a copy. A null doc_id is smaller than none and has no
smaller one, and it has no labels. Repeated rows count each. A document counts as labelled if any row of
labels says so. A null source is the part "". An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import bounded, settle, through

FILTERS = "ABCDE"
#: Salts of rows that agree in fingerprint and doc_id.
SALTS = 1 << 20
_RANGE, _COPY_BIT = "__range", 1 << FILTERS.index("E")


def failures(text, *, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2):
    """The mask of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the split runs once: both counts are taken of one array
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))[0]
    rules = [
        counts["n"] < least_words,
        100 * counts["kinds"] < distinct_percent * counts["n"],
        100 * F.regexp_count(text, F.lit("[A-Z]")) > capital_percent * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(rule, 1 << k).otherwise(0) for k, rule in enumerate(rules)), F.lit(0))


_ROW_FIELDS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), ("group", pa.int64()), ("copy", pa.bool_()), ("fp", pa.int64()), ("text", pa.string()), ("least", pa.int64())])
_ROWS = "doc_id long, part string, mask int, range int, group long, copy boolean, fp long, text string, least long"


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order of (fp, text, doc_id), each held against its predecessor.

    Gives each row without its text, `copy` as far as this range tells, and `group` where the ranges
    before may hold more of its text; then one border row (mask -1) for each group of the first
    and of the last fingerprint."""
    here = TaskContext.get().partitionId()
    group, first_fp, last_fp, last_text, least = -1, None, None, None, None
    opening: list[tuple] = []
    closing: list[tuple] = []

    def close() -> None:
        if group >= 0:
            border = (group, last_fp, last_text, least)
            if last_fp == first_fp:
                opening.append(border)
            else:
                closing.append(border)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, texts, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
        new = np.empty(n, bool)
        new[0] = not (fp[0] == last_fp and texts[0].as_py() == last_text)
        new[1:] = fp[1:] != fp[:-1]
        # equal fingerprints: the texts themselves decide
        alike = np.flatnonzero(~new[1:]) + 1
        new[alike] = pc.not_equal(texts.take(pa.array(alike)), texts.take(pa.array(alike - 1))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        groups, leasts = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        copy = np.zeros(n, bool)
        for a, b in zip(np.r_[0, starts[starts > 0]].tolist(), [*starts[starts > 0].tolist(), n]):
            if new[a]:
                close()
                if last_fp is not None and int(fp[a]) != last_fp:
                    closing.clear()
                group, last_fp, last_text, least = group + 1, int(fp[a]), texts[a].as_py(), None
                first_fp = last_fp if first_fp is None else first_fp
            if least is None and known[a]:
                least = int(number[a])
            if least is not None:
                copy[a:b] = known[a:b] & (number[a:b] > least)
            groups[a:b] = group if last_fp == first_fp else -1
        none = np.zeros(n, bool)
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(3), batch.column(4), pa.array(np.full(n, here, np.int32)), pa.array(groups, mask=groups < 0), pa.array(copy), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(leasts, mask=~none)],
            schema=_ROW_FIELDS,
        )
    close()
    edges = opening + closing
    if edges:
        yield pa.RecordBatch.from_pylist(
            [{"doc_id": None, "part": None, "mask": -1, "range": here, "group": g, "copy": False, "fp": f, "text": t, "least": low} for g, f, t, low in edges], schema=_ROW_FIELDS
        )


def audited_rows(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", part: str = "source", fingerprint=F.xxhash64, **limits) -> DataFrame:
    """doc_id, part, mask (five bits, A lowest) of every row of docs."""
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
    )
    rows = rows.select(fingerprint(F.col("text")).cast("long").alias("fp"), "*", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    dealt = rows.repartitionByRange("fp", F.col("doc_id").asc_nulls_last(), "salt").sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    # masks come after the exchange: its sampling pass reads fingerprints only
    masked = dealt.select("fp", "text", "doc_id", "part", failures(F.col("text"), **limits).cast("int").alias("mask"))
    found = settle(masked.transform(through, compared, _ROWS))
    before = Window.partitionBy("fp", "text").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one border row for each range and group of its first and last fingerprint
    reached = found.filter("mask < 0").select("range", "group", F.min("least").over(before).alias("earlier")).filter("earlier is not null")
    joined = found.filter("mask >= 0").join(bounded(reached), ["range", "group"], "left")
    copy = F.col("copy") | F.coalesce(F.col("doc_id") > F.col("earlier"), F.lit(False))
    return joined.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(_COPY_BIT))).otherwise(F.col("mask")).alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, pass_n, pass_good, pass_toxic, fail_n, only_n: for each part, the rows that pass each of
    the 32 sets of filters (by the set's bits), that fail each filter, and that fail it alone."""
    # rows of one id and mask are one row before the join, so no id weighs more than its parts and masks
    grouped = rows.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    said = said.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "bad")))
    marked = grouped.join(said, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "bad")))
    counts = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad")
    )

    def added(value: str, rule: str) -> str:
        return f"sum(if({rule}, {value}, 0L))"

    def listed(value: str, rules: list[str], name: str) -> str:
        return f"array({', '.join(added(value, r) for r in rules)}) AS {name}"

    passing = [f"mask & {s} = 0" for s in range(1 << len(FILTERS))]
    single = [1 << k for k in range(len(FILTERS))]
    figures = [
        listed("n", passing, "pass_n"), listed("good", passing, "pass_good"), listed("bad", passing, "pass_toxic"),
        listed("n", [f"mask & {b} > 0" for b in single], "fail_n"), listed("n", [f"mask = {b}" for b in single], "only_n"),
    ]
    return counts.groupBy("part").agg(*map(F.expr, figures))


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order of the filters and step, with the figures of that step."""
    counted = counters(audited_rows(docs, **options), labels)
    n = len(FILTERS)

    def removed_everywhere(k: int) -> str:
        """Rows that filter k removes, summed over all orders: each set of other filters
        stands before it in (its size)! * (the others' number)! orders."""
        others = [1 << j for j in range(n) if j != k]
        before = [(sum(chosen), factorial(size) * factorial(n - 1 - size)) for size in range(n) for chosen in combinations(others, size)]
        return " + ".join(f"{times} * (pass_n[{s}] - pass_n[{s | 1 << k}])" for s, times in before)

    parts = counted.withColumn("shapley_of", F.expr(f"array({', '.join(map(removed_everywhere, range(n)))})"))
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    steps = parts.withColumn("filter_order", F.expr(f"explode(array({orders}))")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bits(prefix):
        return sum((F.when(F.contains(prefix, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))

    order = F.col("filter_order")
    steps = steps.withColumns(
        {"earlier": bits(order.substr(F.lit(1), F.col("step") - 1)), "now": bits(order.substr(F.lit(1), F.col("step"))), "k": F.instr(F.lit(FILTERS), order.substr(F.col("step"), F.lit(1))) - 1}
    )

    def lost(name: str):
        return F.col(name)[F.col("earlier")] - F.col(name)[F.col("now")]

    return steps.select(
        "part", "filter_order", "step",
        F.col("pass_n")[F.col("now")].alias("kept"),
        lost("pass_n").alias("removed"),
        (F.col("fail_n")[F.col("k")] - lost("pass_n")).alias("redundant"),
        F.col("only_n")[F.col("k")].alias("unique_fails"),
        lost("pass_good").alias("good_lost"),
        lost("pass_toxic").alias("toxic_lost"),
        F.col("shapley_of")[F.col("k")].alias("shapley"),
    )
