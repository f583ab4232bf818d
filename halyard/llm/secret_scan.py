"""Secret scans over an incremental blob ledger, with DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds
one row for each (blob, rule version) that has been scanned, with its findings. A scan
takes only blobs that the ledger lacks for this rule version, whatever the number of
paths that hold them, and then joins findings back to all paths.

Positions come from the gaps between a pattern's matches (split) and the matches
themselves (regexp_extract_all): lengths in code points, summed in order.

A blob that a thousandth of the paths or more share is a hot key. There are fewer than a
thousand such blobs, so their findings reach their paths by a broadcast; all others are joined
by their address.

Null and empty texts are one blob without findings; very long texts are scanned whole. Spans
that tie are sorted by start, kind, end. Repeated rows give repeated results. An empty table
gives no rows. Further columns are ignored by `findings` and kept by `redact`, whatever their
names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import fresh, join_hot, settle

#: name, pattern, group whose length counts, least length. The first three are the base kinds.
RULES = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # runs are maximal, so the least length may stand in the pattern
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    # tried once a run of these characters, from its first eyJ on (a later one matches only if the first does): linear
    ("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", 1, 30),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
]
BASE = 3
#: Kinds whose span is the counted group at the match's end; what the match has before it counts to the gap.
LED = {"jwt"}
#: Follows the rules, so that an edited rule makes every blob unseen.
RULE_VERSION = f"rules-{hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]}"
#: Plain strings without which a pattern cannot match: a cheap test before the pattern.
NEEDED = {"access": "AKIA", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}


def addresses(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob_id, content: content-addressed versions."""
    content = F.coalesce(versions[text].cast("string"), F.lit(""))
    return versions.select(versions[path].alias("path"), F.sha2(content, 256).alias("blob_id"), content.alias("content"))


def unseen(held: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """blob_id and the least path of each blob that this rule version has not scanned."""
    blobs = held.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs
    return blobs.join(ledger.filter(F.col("rule_version") == rule_version).select("blob_id"), "blob_id", "left_anti")


def _may_match(name: str, pattern: str) -> Column:
    test = F.col("content").rlike(pattern)
    return F.col("content").contains(NEEDED[name]) & test if name in NEEDED else test


def _numbered(kind: int):
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")
    )


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob_id, spans array<struct<start,kind,end,name>> of the blobs that have findings.

    blobs: blob_id, content; a blob may come more than once.
    """
    pieces = []
    for kind, (name, pattern, group, least) in enumerate(RULES):
        matches = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        counted = F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
        gaps = F.split("content", pattern, -1)
        own = counted if name in LED else matches
        measured = F.transform(
            F.arrays_zip(matches.alias("m"), counted.alias("c"), own.alias("s"), F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(1))).alias("g")),
            lambda x: F.struct(
                (F.length(x["g"]) + F.length(x["m"]) - F.length(x["s"])).alias("gap"), F.length(x["s"]).alias("size"), (F.length(x["c"]) >= least).alias("ok")
            ),
        )
        pieces.append(
            F.when(
                _may_match(name, pattern),
                F.transform(measured, _numbered(kind)),
            )
        )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
    found = blobs.select("blob_id", F.explode(F.concat(*[F.coalesce(p, none) for p in pieces])).alias("x")).select(
        "blob_id", "x.*"
    )
    # the gap of a match counts from the end of the match before, so failing ones are summed too
    found = found.dropDuplicates(["blob_id", "kind", "i"])
    order = Window.partitionBy("blob_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(order)).filter("ok")
    names = F.array(*[F.lit(r[0]) for r in RULES])
    span = F.struct(
        (F.col("end") - F.col("size")).alias("start"), "kind", "end", F.element_at(names, F.col("kind") + 1).alias("name")
    )
    return found.groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, *, path: str = "doc_id", text: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(path, blob_id) of all versions, and the ledger's rows (blob_id, rule_version, spans) of the blobs scanned now."""
    held = addresses(versions, path, text)
    known = settle(held.select("path", "blob_id"))
    new = settle(unseen(known, ledger, rule_version))
    # one path of each unseen blob brings its content; path and blob together are no hot key
    chosen = new.select(F.col("path").alias("chosen_path"), F.col("blob_id").alias("chosen_blob")).hint("shuffle_hash")
    content = held.join(
        chosen, F.col("path").eqNullSafe(F.col("chosen_path")) & (F.col("blob_id") == F.col("chosen_blob")), "left_semi"
    )
    found = scan_blobs(content.select("blob_id", "content"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>")
    rows = new.join(found, "blob_id", "left").select(
        "blob_id", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", empty).alias("spans")
    )
    return known, settle(rows)


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, *, rule_version: str = RULE_VERSION, **more) -> tuple[DataFrame, DataFrame]:
    """(path, blob_id) of all versions, and the ledger with the blobs scanned now."""
    known, rows = scan_unseen(versions, ledger, rule_version=rule_version, **more)
    if ledger is not None:
        rows = ledger.filter(F.col("rule_version") == rule_version).select("blob_id", "rule_version", "spans").union(rows)
    return known, rows


def _to_paths(known: DataFrame, rows: DataFrame) -> DataFrame:
    """path, blob_id, spans for every path."""
    return join_hot(known, rows.select("blob_id", "spans"), "blob_id").select("path", "blob_id", "spans")


def findings(versions: DataFrame, ledger: DataFrame | None = None, **more) -> DataFrame:
    """path, blob_id, spans for every path."""
    return _to_paths(*extend_ledger(versions, ledger, **more))


def scan_with_stored(versions: DataFrame, folder: str, *, rule_version: str = RULE_VERSION, **more) -> DataFrame:
    """As findings, with the ledger kept as Parquet in a folder: blobs that it has for this rule
    version are not scanned again, and those scanned now are appended."""
    spark = versions.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    ledger = settle(spark.read.parquet(folder).select("blob_id", "rule_version", "spans")) if there else None
    known, new = scan_unseen(versions, ledger, rule_version=rule_version, **more)
    new.write.mode("append").partitionBy("rule_version").parquet(folder)
    if ledger is not None:
        new = ledger.filter(F.col("rule_version") == rule_version).unionByName(new)
    return _to_paths(known, new)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    counts = [
        F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{RULES[k][0]}") for k in range(BASE)
    ]
    return found.select(
        F.col("path").alias(id_column), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", id_column: str = "doc_id", marker: str = "[SECRET]") -> DataFrame:
    """docs with every finding's span replaced by the marker; other rows and columns stay.

    A null text stays null.
    """
    path, blob, own, spans = fresh(docs, "path", "blob", "own", "spans")
    found = findings(docs, path=id_column, text=text)
    hits = found.filter(F.size("spans") > 0).select(F.col("path").alias(path), F.col("blob_id").alias(blob), F.col("spans").alias(spans))
    hits = hits.dropDuplicates([path, blob])
    joined = docs.withColumn(own, F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256)).join(
        hits, (F.col(id_column).eqNullSafe(F.col(path))) & (F.col(own) == F.col(blob)), "left"
    )

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(marker))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        )

    changed = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        step,
        lambda a: F.concat(a["out"], F.substr(F.col(text), (a["at"] + 1).cast("int"))),
    )
    out = [F.when(F.col(spans).isNull(), F.col(c)).otherwise(changed).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*out)
