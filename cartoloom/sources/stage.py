"""Tables written once and read back, to cut lineage and to spare a second evaluation.

They go below ``spark.checkpoint.dir``, which driver and executors share. Where that is unset and the master is
local (tests), a temporary folder serves; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []
_made: list[tuple] = []


def _root(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: the executors of this master have folders of their own")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="cartoloom-stage-"))
    return f"file://{_own[0]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a stored table; it is deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; other DataFrames are passed over."""
    for table in tables:
        files = set(table.inputFiles())
        for own in [m for m in _made if any(f"/{m[1].rsplit('/', 1)[1]}/" in f for f in files)]:
            _made.remove(own)
            _delete(*own)


def _delete(spark, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def _clear() -> None:
    for made in _made:
        _delete(*made)
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_clear)
