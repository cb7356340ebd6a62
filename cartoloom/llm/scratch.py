"""Shared scratch storage used to cut lineage.

Executors may be lost at any time and share no local disk, so intermediate tables are
written as Parquet below ``spark.checkpoint.dir``. Only where that setting is absent and the master is
local (single machine tests) is a folder made here; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Folder = tuple[SparkSession, str]
_live: list[Folder] = []
_local: list[str] = []
_scopes: list[list[Folder]] = []
_marked: dict[str, list[Folder]] = {}
MARK = "scratch"


def root(spark: SparkSession) -> str:
    """Folder every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="cartoloom-"))
    return _local[0]


def bounded(spark: SparkSession, rows: int = 2048) -> None:
    """Let Arrow batches hold fewer rows than Spark's default: texts are long, and both ends hold a batch at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    _live.append((spark, path))
    for own in _scopes:
        own.append((spark, path))
    return path


def staged(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(folders: list[Folder] | None = None) -> None:
    """Delete staged folders (default: all); results that still read them become invalid."""
    for own in list(_live if folders is None else folders):
        if own in _live:
            _live.remove(own)
        try:
            drop(*own)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


@contextmanager
def scope() -> Iterator[list[Folder]]:
    """The folders made inside, as a list."""
    own: list[Folder] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]


def marked(df: DataFrame, folders: list[Folder], column: str) -> DataFrame:
    """``df`` with a note, in the metadata of ``column``, of the folders it reads; the note survives writing as Parquet."""
    token = uuid.uuid4().hex
    _marked[token] = folders
    return df.withColumn(column, F.col(column).alias(column, metadata={MARK: token}))


def settle(df: DataFrame, column: str) -> None:
    """Delete the folders that the maker of ``df`` noted, if ``df`` is its written result and no longer reads them itself."""
    token = df.schema[column].metadata.get(MARK) if column in df.columns else None
    folders = _marked.get(token, [])
    if folders and not any(path.rsplit("/", 1)[1] in read for read in _roots(df) for _, path in folders):
        release(_marked.pop(token))


def _roots(df: DataFrame) -> list[str]:
    """Root folders of the files a plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                found += [paths.apply(i).toString() for i in range(paths.size())]
    return found


atexit.register(release)
