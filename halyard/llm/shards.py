"""Sharding by a k-d tree over document metadata: law `bytes`.

Copies of a text form one group; a group is the unit that is placed. Starting with all
groups and all shards, a node is cut along its widest metadata dimension (range of the
node over the range of the table) at the weighted median, or at the share that its
halves of the shards ask for, until each leaf is one shard of the target bytes. The
dimensions are length, source and language; the last two are ranks among the distinct
values. The cut is found by counting bytes over a grid of the dimension's order and narrowing
the grid around the cut, for all nodes of a level at once; the driver sees grid counts only.

A cut can't go through a group, so a leaf is off by up to half the size of the groups where
its cuts fell. Leaves that are off are repaired: groups above a LARGE-th of the target
(fewer than LARGE times the shards) move or change places one by one where a leaf has more of
them than it can hold, and ranges of the smaller ones go from leaves that have too much to leaves that have too
little. Where no group is that large, the leaves are the tree's own.

A group larger than a whole shard, such as a third of all rows, can't be in one shard under
this law; it is cut row by row into pieces of a sixteenth of the target, which are placed
before the tree fills what each shard has left.

Null and empty texts have size 8 and are one group; a very long text is one row like others.
A null in a dimension comes first. Ties in a dimension are parted by a hash of the text.
Repeated rows count and are placed as rows. Further columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import partitions, settle

SHARDS = 24
OVERHEAD = 8
GRID = 4096
#: Groups above this part of a shard's target are repaired one by one.
LARGE = 256
#: Leaves off by no more than this part of the target are not repaired.
TOLERANCE = 500
#: Bits of a dimension's order that its value takes; the rest tell equal values apart.
VALUE_BITS = 30
#: Ranks of a dimension are broadcast up to so many distinct values.
BROADCAST_RANKS = 200_000


def _ranked(groups: DataFrame, column: str, rank: str) -> DataFrame:
    """groups with the dense rank of the column's value: 0 for null, 1 for the least.

    Distinct values are dealt into ranges and numbered there; one row for each range tells
    how many come before."""
    parts = partitions(groups.sparkSession)
    values = groups.select(F.col(column).alias("value")).filter("value is not null").distinct()
    values = settle(values.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = values.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("value")
    ranks = values.join(first, "part").select(F.col("value").alias(column), (F.col("first") + F.row_number().over(inside)).alias(rank))
    if values.count() <= BROADCAST_RANKS:
        ranks = F.broadcast(ranks)
    return groups.join(ranks, column, "left")


def _dimensions(groups: DataFrame) -> DataFrame:
    """Each dimension as an order key: the value in the high bits, the group's hash below."""
    low = 62 - VALUE_BITS
    top = (1 << VALUE_BITS) - 1

    def key(value, salt: int):
        value = F.least(F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0)), F.lit(top))
        return F.shiftleft(value, low).bitwiseOR(F.shiftrightunsigned(F.xxhash64("group", F.lit(salt)), 64 - low))

    ranked = _ranked(_ranked(groups, "source", "source_rank"), "lang", "lang_rank")
    return ranked.select(
        "group", "bytes", key(F.col("n_chars"), 0).alias("d0"), key(F.col("source_rank"), 1).alias("d1"), key(F.col("lang_rank"), 2).alias("d2"),
        F.shiftrightunsigned(F.xxhash64("group", F.lit(7)), 2).alias("h"),
    )


def _greedy(sizes: list[tuple[str, int]], shards: int) -> tuple[dict, list[int]]:
    """Pieces, largest first, each into the least full shard."""
    room = [(0, s) for s in range(shards)]
    heapq.heapify(room)
    place = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        full, s = heapq.heappop(room)
        place[key] = s
        heapq.heappush(room, (full + size, s))
    filled = [0] * shards
    for full, s in room:
        filled[s] = full
    return place, filled


def _cuts(table: DataFrame, nodes: dict[int, tuple[str, float]], lows: dict, highs: dict, close: float) -> dict[int, int]:
    """For each node (column, bytes wanted on the left) the key at which to cut: the left
    part is all keys below it. A grid of GRID cells is narrowed to the cell that holds the
    cut until that cell holds at most `close` bytes or one key."""
    low, high = dict(lows), {n: h + 1 for n, h in highs.items()}
    want = {n: w for n, (_, w) in nodes.items()}
    done: dict[int, int] = {}
    while len(done) < len(nodes):
        live = [n for n in nodes if n not in done]
        step = {n: max(1, -(-(high[n] - low[n]) // GRID)) for n in live}
        cell = "CASE node " + " ".join(
            f"WHEN {n} THEN if({nodes[n][0]} >= {low[n]}L AND {nodes[n][0]} < {high[n]}L, ({nodes[n][0]} - {low[n]}L) div {step[n]}L, NULL)" for n in live
        ) + " END"
        counts = table.withColumn("cell", F.expr(cell)).filter("cell is not null").groupBy("node", "cell").agg(F.sum("bytes").alias("b")).collect()
        by: dict[int, dict[int, int]] = {n: {} for n in live}
        for r in counts:
            by[r["node"]][int(r["cell"])] = int(r["b"])
        for n in live:
            left, cut = want[n], None
            for c in sorted(by[n]):
                if left - by[n][c] <= 0:
                    cut = c
                    break
                left -= by[n][c]
            if cut is None:
                done[n] = high[n]
            elif step[n] == 1 or by[n][cut] <= close:
                # this cell's groups go to the side that comes closer
                done[n] = low[n] + (cut + (1 if left > by[n][cut] / 2 else 0)) * step[n]
            else:
                low[n], high[n] = low[n] + cut * step[n], min(high[n], low[n] + (cut + 1) * step[n])
                want[n] = left
    return done


def tree(groups: DataFrame, room: list[float], close: float | None = None) -> DataFrame:
    """groups (columns bytes, d0, d1, d2) with the shard of each; room: bytes that each shard has left.

    The tree itself, a cut for each inner node, is an expression over the dimensions."""
    dims = ["d0", "d1", "d2"]
    close = sum(room) / len(room) / 4000 if close is None else close
    spread: dict[str, int] = {}
    cuts: dict[int, tuple[str, int]] = {}  # by node; node n's children are 2n and 2n + 1
    shards_of = {1: list(range(len(room)))}
    level = [1]

    def expression(n: int, leaf) -> str:
        if n in cuts:
            d, c = cuts[n]
            return f"if({d} < {c}L, {expression(2 * n, leaf)}, {expression(2 * n + 1, leaf)})"
        return str(leaf(n))

    while level := [n for n in level if len(shards_of[n]) > 1]:
        table = groups.withColumn("node", F.expr(expression(1, lambda n: n)))
        stats = {
            r["node"]: r
            for r in table.groupBy("node")
            .agg(F.sum("bytes").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
            .collect()
        }
        spread = spread or {d: max(1, max((r[f"max_{d}"] for r in stats.values()), default=0) - min((r[f"min_{d}"] for r in stats.values()), default=0)) for d in dims}
        asked = {}
        for n in level:
            half = len(shards_of[n]) // 2
            shards_of[2 * n], shards_of[2 * n + 1] = shards_of[n][:half], shards_of[n][half:]
            if n in stats:
                widest = max(dims, key=lambda d: ((stats[n][f"max_{d}"] - stats[n][f"min_{d}"]) / spread[d], d))
                total = sum(room[s] for s in shards_of[n]) or 1
                asked[n] = (widest, float(stats[n]["bytes"]) * sum(room[s] for s in shards_of[2 * n]) / total)
        lows, highs = ({n: stats[n][f"{f}_{d}"] for n, (d, _) in asked.items()} for f in ("min", "max"))
        found = _cuts(table, asked, lows, highs, close)
        cuts |= {n: (d, found[n]) for n, (d, _) in asked.items()}
        level = [c for n in level for c in (2 * n, 2 * n + 1)]
    # a node without groups was not cut; it has no rows either
    return groups.withColumn("shard", F.expr(expression(1, lambda n: shards_of[n][0])).cast("int"))


def _exchange(full: set, empty: set, apart: float) -> tuple | None:
    """The group that goes over, and the one that comes back (or none), that bring two shards closest together."""
    given, best = sorted(empty), None
    for g in full:
        # the partners whose size is next to what would make both shards alike, or none
        k = bisect_left(given, (g[0] - apart / 2,))
        for h in (None, *given[max(0, k - 1) : k + 1]):
            gain = g[0] - (h[0] if h else 0)
            if 0 < gain < apart and (best is None or (abs(gain - apart / 2), g) < best[:2]):
                best = abs(gain - apart / 2), g, h
    return best and best[1:]


def _spread_large(large: dict[str, tuple[int, int]], room: list[float]) -> dict[str, int]:
    """Moves of large groups (bytes, shard) out of shards that can't hold all of theirs: the
    fullest shard gives one, or changes one for a smaller one, with the emptiest shard that this
    brings closer to it, as long as there is one."""
    over = [-r for r in room]
    held: list[set[tuple[int, str]]] = [set() for _ in room]
    for group, (size, shard) in large.items():
        over[shard] += size
        held[shard].add((size, group))
    moves: dict[str, int] = {}
    while True:
        order = sorted(range(len(room)), key=lambda s: (over[s], s))
        full = order.pop()
        found = ((_exchange(held[full], held[s], over[full] - over[s]), s) for s in order if over[s] < over[full])
        found = next((x for x in found if x[0]), None) if over[full] > 0 else None
        if not found:
            return moves
        (g, h), other = found
        for item, a, b in ((g, full, other), (h, other, full)):
            if item:
                held[a].remove(item)
                held[b].add(item)
                over[a] -= item[0]
                over[b] += item[0]
                moves[item[1]] = b


def repair(placed: DataFrame, room: list[float], target: float) -> DataFrame:
    """group, shard: the tree's placement with the leaves that are off put right."""
    limit, close = max(1.0, target / LARGE), target / 4000
    large = {r["group"]: (int(r["bytes"]), r["shard"]) for r in placed.filter(F.col("bytes") > limit).select("group", "bytes", "shard").collect()}
    moves = _spread_large(large, room)
    want = list(room)
    for group, (size, shard) in large.items():
        want[moves.get(group, shard)] -= size
    want = [max(0.0, w) for w in want]
    small = placed.filter(F.col("bytes") <= limit).select(F.col("shard").alias("node"), "bytes", "h")
    have = [0.0] * len(room)
    for r in small.groupBy("node").agg(F.sum("bytes").alias("b")).collect():
        have[r["node"]] = float(r["b"])
    scale = sum(have) / (sum(want) or 1)
    excess = [a - w * scale for a, w in zip(have, want)]
    above = {s: 1 << 62 for s in range(len(room))}
    ranges: list[tuple[int, int, int, int]] = []
    for _ in range(len(room)):
        givers = sorted((s for s in above if excess[s] > target / TOLERANCE), key=lambda s: (-excess[s], s))
        takers = sorted((s for s in above if excess[s] < 0), key=lambda s: (excess[s], s))
        pairs = list(zip(givers, takers))
        if not pairs:
            break
        amount = {a: min(excess[a], -excess[b]) for a, b in pairs}
        nodes = {a: ("h", have[a] - amount[a]) for a, _ in pairs}
        cuts = _cuts(small, nodes, dict.fromkeys(nodes, 0), {a: above[a] - 1 for a in nodes}, close)
        for a, b in pairs:
            ranges.append((a, cuts[a], above[a], b))
            above[a] = cuts[a]
            have[a] -= amount[a]
            excess[a] -= amount[a]
            excess[b] += amount[a]
    to = "CASE " + " ".join(f"WHEN shard = {a} AND h >= {lo}L AND h < {hi}L THEN {b}" for a, lo, hi, b in ranges) + " ELSE shard END" if ranges else "shard"
    moved = placed.sparkSession.createDataFrame(sorted(moves.items()), "group string, moved int")
    return placed.join(F.broadcast(moved), "group", "left").select(
        "group", F.coalesce("moved", F.when(F.col("bytes") <= limit, F.expr(to)).otherwise(F.col("shard"))).cast("int").alias("shard")
    )


def shard_documents(
    docs: DataFrame, text: str = "text", *, shards: int = SHARDS, id_column: str = "doc_id", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The text is read once, without a shuffle; all that follows moves ids, sizes and hashes.
    """
    spark = docs.sparkSession
    content = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = settle(
        docs.select(
            docs[id_column].cast("long").alias("doc_id"),
            (F.octet_length(content) + OVERHEAD).cast("long").alias("size"),
            F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
            F.md5(content).alias("group"),
            F.char_length(content).cast("long").alias("n_chars"),
            (docs[lang] if lang in docs.columns else F.lit(None)).cast("string").alias("lang"),
            (docs[source] if source in docs.columns else F.lit(None)).cast("string").alias("source"),
        )
    )
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("bytes"), F.max("n_chars").alias("n_chars"), F.min("lang").alias("lang"), F.min("source").alias("source")
    )
    groups = settle(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    target = total / shards
    # at most `shards` groups can be above the target
    torn = {r["group"]: int(r["bytes"]) for r in groups.filter(F.col("bytes") > max(1.0, target)).select("group", "bytes").collect()}
    cuts = {g: max(2, int(-(-b * 16 // max(1, target)))) for g, b in torn.items()}
    placed, filled = _greedy([(f"{g}/{k}", b // cuts[g]) for g, b in torn.items() for k in range(cuts[g])], shards)
    torn = cuts
    room = [max(target - f, 0.0) for f in filled]
    leaves = settle(tree(settle(_dimensions(groups.filter(F.col("bytes") <= max(1.0, target)))), room))
    in_tree = repair(leaves, room, target)
    known = spark.createDataFrame([(g, s) for g, s in placed.items()], "group string, shard int")
    place = in_tree.union(known).withColumnRenamed("group", "unit")
    named = rows.withColumn("unit", F.col("group"))
    if torn:
        # a torn group's rows, numbered from 0, take its pieces in turn; at most `shards` groups are torn
        cut = F.broadcast(spark.createDataFrame(list(torn.items()), "group string, n int"))
        inside = settle(_numbered(rows.join(cut, "group"), "group", "doc_id"))
        inside = inside.withColumn("unit", F.concat_ws("/", "group", F.pmod(F.col("slot"), F.col("n")).cast("string")))
        named = named.join(cut, "group", "left_anti").unionByName(inside.select(*named.columns))
    out = settle(named.join(place, "unit").select("doc_id", "size", "text_crc32", "shard"))
    return with_slots(out)


def _numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`slot`: the rows of each key from 0 without gaps. Each key is cut into buckets by a
    hash of the order columns; bucket counts (one row each) give a bucket's first number."""
    buckets = max(8, 4 * partitions(rows.sparkSession))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        rows.groupBy(key, "bucket")
        .agg(F.count(F.lit(1)).alias("in_bucket"))
        .select(key, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("first"))
    )
    here = Window.partitionBy(key, "bucket").orderBy(*order)
    return (
        rows.withColumn("row", F.row_number().over(here))
        .join(first, [key, "bucket"])
        .withColumn("slot", (F.col("first") + F.col("row") - 1).cast("long"))
        .drop("bucket", "row", "first")
    )


def with_slots(out: DataFrame) -> DataFrame:
    return _numbered(out, "shard", "doc_id", "text_crc32", "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
