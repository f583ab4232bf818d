"""What a Spark session needs before Python operators run on its executors."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def _code() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(path.relative_to(_ROOT.parent))), path.read_bytes())
    return out.getvalue()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, through the shared
    folder of spark.checkpoint.dir; a local folder serves only a local master."""
    sc = spark.sparkContext
    if getattr(sc, "_halyard_shipped", False):
        return
    code = _code()
    name = f"halyard_{hashlib.sha256(code).hexdigest()[:16]}.zip"
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        path = sc._jvm.org.apache.hadoop.fs.Path(shared, name)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(path):
            stream = files.create(path)
            stream.write(bytearray(code))
            stream.close()
        where = path.toString()
    elif not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        where = os.path.join(tempfile.mkdtemp(prefix="halyard-"), name)
        Path(where).write_bytes(code)
    sc.addPyFile(where)
    sc._halyard_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local folder serves only a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        there = sc.getConf().get("spark.checkpoint.dir")
        if there is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="halyard-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
