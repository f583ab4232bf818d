"""Token counts from an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the histogram (whose rows are
the distinct lengths, not the documents) answer, for every context limit, how many
documents reach it, how many tokens fit when each document is cut there, how many chunks
of that size the corpus makes, and any quantile of the lengths.

A null or empty text has length 0; very long texts are counted whole. Ties share one row;
repeated rows count as often as they come; further columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._blocks import settle
from .bpe import token_lengths


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs: one row per distinct length, by partial sums on the map side."""
    return lengths.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens at L and above, the tokens left when all
    documents are cut to L, the tokens that cut drops, and the share of documents below.

    Distinct lengths are dealt into ranges of one sort; per-range totals (one row a
    range) give each range what lies above it, so no window spans the histogram.
    """
    spark = hist.sparkSession
    hist = settle(hist)
    width = 64
    ranged = hist.withColumn("range", F.expr(f"n_tokens div {width}"))
    sums = ranged.groupBy("range").agg(
        F.sum("n_docs").alias("docs"), F.sum(F.expr("n_docs * n_tokens")).alias("tokens")
    )
    # one row for each 64 lengths that occur, however many documents there are
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "range",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
    )
    totals = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.expr("n_docs * n_tokens")).alias("all_tokens")).first()
    docs, tokens = totals["all_docs"] or 0, totals["all_tokens"] or 0
    here = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        ranged.join(sums, "range")
        .withColumn("docs_at_least", F.sum("n_docs").over(here) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum(F.expr("n_docs * n_tokens")).over(here) + F.col("tokens_above"))
    )
    kept = F.lit(tokens) - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        kept.cast("long").alias("tokens_if_cut_here"),
        (F.lit(tokens) - kept).cast("long").alias("tokens_dropped"),
        (F.lit(docs) - F.col("docs_at_least") + F.col("n_docs")).cast("long").alias("docs_at_most"),
        F.lit(docs).cast("long").alias("all_docs"),
        F.lit(tokens).cast("long").alias("all_tokens"),
    )


def token_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None, *, id_column: str = "doc_id") -> DataFrame:
    return with_suffix_sums(histogram(token_lengths(docs, text, vocabulary, id_column=id_column)))


def quantile(report: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed."""
    return (
        report.filter(F.col("docs_at_most") >= F.ceil(F.lit(q) * F.col("all_docs"))).agg(F.min("n_tokens").alias("n_tokens"))
    )


def at_limit(report: DataFrame, limit: int) -> DataFrame:
    """Totals when every document is cut to `limit` tokens, from the suffix sums alone."""
    above = report.filter(F.col("n_tokens") > limit)
    below = report.filter(F.col("n_tokens") <= limit)
    a = above.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs_cut"))
    b = below.agg(F.coalesce(F.sum(F.expr("n_docs * n_tokens")), F.lit(0)).alias("tokens_whole"))
    return a.join(b).select(
        F.lit(limit).cast("long").alias("context_limit"),
        F.col("docs_cut").cast("long").alias("docs_cut"),
        (F.col("tokens_whole") + F.col("docs_cut") * F.lit(limit)).cast("long").alias("tokens_kept"),
    )
