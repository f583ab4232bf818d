"""Text tables: whitespace columns, `#`/`!` comments, Fortran exponents.

Lines are read as splittable text, so a file of any size spreads over the cluster; row
numbers come from the counts of each file block and never from one sort.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_line(line: Column) -> Column:
    """Without comment, exponents spelt with E, trimmed."""
    # most lines have neither a comment nor a Fortran exponent: the patterns run on those that may
    cut = F.when(line.contains("#") | line.contains("!"), F.regexp_replace(line, r"[#!].*$", "")).otherwise(line)
    spelt = F.regexp_replace(cut, r"(?<=[0-9.])[dD](?=[-+]?[0-9])", "E")
    return F.trim(F.when(cut.contains("D") | cut.contains("d"), spelt).otherwise(cut))


def has_data(line: Column) -> Column:
    """Not empty before its comment."""
    return ~line.rlike(r"^\s*([#!]|$)")


def header_value(text: Column) -> Column:
    """What a header value is: `bool`, `int`, `float` or `string`."""
    plain = F.regexp_replace(F.trim(text), r"(?<=[0-9.])[dD](?=[-+]?[0-9])", "E")
    return (
        F.when(F.upper(plain).isin("T", "F", ".TRUE.", ".FALSE."), "bool")
        .when(plain.rlike(r"^[-+]?[0-9]+$"), "int")
        .when(plain.try_cast("double").isNotNull(), "float")
        .otherwise("string")
    )


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _numbered(lines: DataFrame, number: str, keep: list[str] | None = None) -> DataFrame:
    """The lines numbered from 0 in each file: the counts of the file's blocks before, and the
    place in the block, so that no task sorts a file. keep: helper columns that stay."""
    per_block = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = per_block.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    placed = lines.withColumn("place", F.row_number().over(inside)).join(first, ["path", "block"])
    return placed.withColumn(number, (F.col("first") + F.col("place") - 1).cast("long")).drop(*({"block", "at", "place", "first"} - set(keep or [])))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (from 0), value of all lines."""
    return _numbered(_lines(spark, paths), "line_no").select("path", "line_no", "value")


def numeric_table(spark: SparkSession, paths: str | list[str], expect_columns: int | None = None, *, keep: bool = False) -> DataFrame:
    """path, row_idx, cols of every data row. Ragged rows, words, infinities and files without
    rows are errors. With keep the parsed rows stay on the executors' disks, so that the text is
    parsed once however often the table is used; a lost executor's part is parsed again."""
    rows = _lines(spark, paths)
    words = F.split(clean_line(F.col("value")), r"\s+")
    data = rows.filter(has_data(F.col("value"))).select("path", "block", "at", F.transform(words, lambda x: x.try_cast("double")).alias("cols"))
    data = data.persist(StorageLevel.DISK_ONLY) if keep else data
    check = data.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("cols")).alias("least"),
        F.max(F.size("cols")).alias("most"),
        F.count_if(F.exists("cols", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
    ).collect()
    seen = {r["path"] for r in check}
    for r in check:
        if r["bad"]:
            raise ValueError(f"{r['path']}: {r['bad']} rows hold words or values that are not finite")
        if r["least"] != r["most"] or expect_columns not in (None, r["most"]):
            raise ValueError(f"{r['path']}: rows of {r['least']} to {r['most']} columns")
    empty = [r["path"] for r in rows.select("path").distinct().collect() if r["path"] not in seen]
    if empty or not seen:
        raise ValueError(f"no data rows in {empty or paths}")
    return _numbered(data, "row_idx").select("path", "row_idx", "cols")


def table_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, key, value, kind of `# KEY = VALUE` lines above the first data row; a key with two
    values is an error."""
    lines = _lines(spark, paths).withColumn("place", F.struct("block", "at"))
    first = lines.filter(has_data(F.col("value"))).groupBy("path").agg(F.min("place").alias("first"))
    found = (
        lines.filter(F.col("value").rlike(r"^\s*#\s*\w+\s*="))
        .join(first, "path", "left")
        .filter(F.col("first").isNull() | (F.col("place") < F.col("first")))
        .select("path", F.upper(F.regexp_extract("value", r"^\s*#\s*(\w+)\s*=", 1)).alias("key"), F.trim(F.regexp_extract("value", r"=\s*(.*?)\s*$", 1)).alias("value"))
        .distinct()
    )
    twice = found.groupBy("path", "key").count().filter("count > 1").collect()
    if twice:
        raise ValueError(f"conflicting values: {[(r['path'], r['key']) for r in twice]}")
    return found.withColumn("kind", header_value(F.col("value")))


def structure(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, n_rows, n_columns, first and last row: one pass, nothing kept."""
    table = numeric_table(spark, paths)
    return table.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("cols")).alias("n_columns"), F.min_by("cols", "row_idx").alias("first_row"), F.max_by("cols", "row_idx").alias("last_row")
    )


def histories(spark: SparkSession, paths: str | list[str], columns: dict[int, str], time_unit: str = "fs") -> DataFrame:
    """h (file), t (row), time_ns, state, p: declared population columns in long form. Time is divided."""
    per = {"fs": 1e6, "ps": 1e3, "ns": 1.0}[time_unit]
    wanted = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("state")) for c, s in columns.items()])
    table = numeric_table(spark, paths)
    return table.select("path", "row_idx", (F.col("cols")[0] / F.lit(per)).alias("time_ns"), "cols", F.explode(wanted).alias("x")).select(
        F.col("path").alias("h"), F.col("row_idx").alias("t"), "time_ns", F.col("x.state").alias("state"), F.element_at("cols", F.col("x.column") + 1).alias("p")
    )


def state_energies(spark: SparkSession, path: str) -> DataFrame:
    """frame (from 1), state, e."""
    return numeric_table(spark, path).select((F.col("row_idx") + 1).alias("frame"), F.posexplode("cols").alias("state", "e"))


def couplings(spark: SparkSession, path: str, n_states: int | None = None) -> DataFrame:
    """frame, i, j, v; a row is a flattened square matrix."""
    table = numeric_table(spark, path)
    width = table.agg(F.max(F.size("cols"))).first()[0]
    n = round(width**0.5)
    if n * n != width or n_states not in (None, n):
        raise ValueError(f"{width} columns are not a square of {n_states or 'any number of'} states")
    return table.select((F.col("row_idx") + 1).alias("frame"), F.posexplode("cols").alias("at", "v")).select(
        "frame", F.expr(f"cast(at div {n} as int)").alias("i"), F.expr(f"cast(at % {n} as int)").alias("j"), "v"
    )


def namelist_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines' other columns with key, value, kind of each assignment in a Fortran namelist."""
    others = [c for c in lines.columns if c != line]
    plain = F.regexp_replace(line, r"!.*$", "")
    pairs = lines.select(*others, F.explode(F.regexp_extract_all(plain, F.lit(r"(\w+\s*=\s*(?:(?!\w+\s*=)[^,=/&])+)"), F.lit(1))).alias("pair"))
    return pairs.select(
        *others, F.upper(F.regexp_extract("pair", r"^(\w+)", 1)).alias("key"), F.trim(F.regexp_extract("pair", r"=\s*(.*?)\s*$", 1)).alias("value")
    ).withColumn("kind", header_value(F.col("value")))


def namelist(spark: SparkSession, path: str) -> DataFrame:
    """key, value, kind of a Fortran namelist."""
    return namelist_pairs(spark.read.text(path).withColumnRenamed("value", "line"))


def spectrum(spark: SparkSession, path: str, label: str) -> DataFrame:
    """label, f, y with an optional header line; frequencies must increase."""
    data = (
        numbered_lines(spark, path)
        .withColumn("x", F.transform(F.split(clean_line(F.col("value")), r"\s+|,"), lambda v: v.try_cast("double")))
        .filter((F.size("x") == 2) & F.col("x")[0].isNotNull() & F.col("x")[1].isNotNull())
    )
    out = data.select(F.lit(label).alias("label"), "line_no", F.col("x")[0].alias("f"), F.col("x")[1].alias("y"))
    back = out.withColumn("f0", F.lag("f").over(Window.partitionBy("label").orderBy("line_no"))).filter("f <= f0").count()
    if back:
        raise ValueError(f"{path}: frequencies do not increase")
    return out.orderBy("line_no").drop("line_no")


def projection_character(spark: SparkSession, path: str) -> DataFrame:
    """frame, band, grp, w: a rectangular long CSV."""
    table = spark.read.csv(path, header=True, schema=None, inferSchema=False).select(
        F.col("frame").cast("int"), F.col("band").cast("int"), F.col("group").alias("grp"), F.col("normalized_weight").cast("double").alias("w")
    )
    n = table.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("frame", "band", "grp").alias("cells"), F.count_distinct("frame").alias("a"), F.count_distinct("band").alias("b"), F.count_distinct("grp").alias("c")
    ).first()
    if n["n"] != n["cells"] or n["n"] != n["a"] * n["b"] * n["c"]:
        raise ValueError(f"{path} is not a full table of frames, bands and groups")
    return table
