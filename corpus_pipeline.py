"""A corpus pipeline: five stages, each one operator of halyard.llm over all that is left.

Counted as part of the subpackage llm. Every stage takes (spark, docs, sf_dir); its result
is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import bpe, decontam, langid, near_copies, secret_scan
from halyard.llm._blocks import checkpoint_dir, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's n-grams that its language must know.
LEAST_SCORE = 0.3
SIMILARITY = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose n-grams no learned language knows.

    Null and empty texts go; very long ones are read whole; a tie between languages changes
    nothing; each repeated row is judged alone; an empty table stays empty; further columns are left out."""
    return langid.keep_known(docs.select(*COLUMNS), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id: five-word shingles
    alike by 0.8 or more, found by SimHash pigeonring (op4) and by MinHash bands, proven by the sets.

    Null and empty texts are copies of each other; very long ones are read whole; ties for the
    least id go to the least hash of the text; of rows with one id and one text one stays, rows
    without an id are told apart by their text; an empty table stays empty; further columns are left out."""
    return near_copies.keep_one(docs.select(*COLUMNS), similarity=SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.

    Null and empty texts stay; very long ones are read whole; every occurrence counts, so nothing
    ties; each repeated row is judged alone; an empty table stays empty, an empty benchmark drops
    nothing; further columns are left out."""
    return decontam.keep_clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a marker in the place of each secret; n_chars follows the new text.

    A null text stays null with n_chars 0; very long ones are scanned whole; spans that tie or
    overlap make one marker; repeated rows stay repeated; an empty table stays empty; further
    columns are left out."""
    out = secret_scan.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text.

    Null and empty texts have no tokens; very long ones are encoded whole; repeated rows repeat
    their results, nothing ties; an empty table stays empty; further columns are left out."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("encode", encode),
]

#: No stage can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written below the checkpoint folder and
    removed once the next stage is written; the last stage's rows stay for the reader."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        there = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(there)
        docs = spark.read.parquet(there)
        if before:
            _remove(spark, before)
        before = there
    return docs
