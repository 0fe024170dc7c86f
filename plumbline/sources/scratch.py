"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. In local mode, where one machine is all there is, a temporary folder
    of our own stands in for a missing setting; on a cluster a missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="plumbline-"))
    return _OWN_DIR[0]


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


def _delete_written() -> None:
    while _WRITTEN:
        _delete(next(iter(_WRITTEN)))


atexit.register(_delete_written)


def written() -> set[str]:
    """Paths of the tables that exist now."""
    return set(_WRITTEN)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors: the files are whole on shared
    storage, not blocks on an executor's disk, and what they hold is never computed again. A join of
    two such tables has a plain exchange on either side, which adaptive execution can split where a
    key is hot. Deleted by :func:`release`, or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_plumbline_path", None)
        if path in _WRITTEN:
            _delete(path)


def release_since(before: set[str], keep: DataFrame) -> None:
    """Delete the tables written since ``before`` was taken from :func:`written`, but ``keep``."""
    for path in written() - before - {keep._plumbline_path}:
        _delete(path)
