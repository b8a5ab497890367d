"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own, kept for the process; a cluster gets
    an error, since its machines share no such folder."""
    global _own_dir
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="docquarry-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return "file://" + _own_dir


def scratch_path(spark: SparkSession, name: str = "dq") -> str:
    """A new folder for one table."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    Spark then knows the table's real size, so joins against it are broadcast only under
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", compression).parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, column: str, values: tuple[int, ...]) -> list[DataFrame]:
    """``materialise`` with a folder, and a table, for each of the ``values`` of an integer column."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    _scratch.append((spark, path))
    read = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    return [read.where(read[column] == v) for v in values]


def release_kinds(mark: int, column: str, values: tuple[int, ...]) -> None:
    """Delete these values' folders of the tables that ``materialise_by`` made since ``mark``."""
    for spark, path in _scratch[mark:]:
        for v in values:
            delete(spark, f"{path}/{column}={v}")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_mark() -> int:
    """A point in the order of intermediate tables, for ``release``."""
    return len(_scratch)


def keep(spark: SparkSession, path: str) -> None:
    """Delete a table only with the process."""
    _scratch.append((spark, path))


def release(mark: int = 0) -> None:
    """Delete the intermediate tables made since ``mark``, or all of this process; nothing may read them later."""
    while len(_scratch) > mark:
        spark, path = _scratch.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def release_at(mark: int) -> None:
    """Delete the first intermediate table made since ``mark``."""
    delete(*_scratch.pop(mark))


def release_but_last(mark: int) -> None:
    """Delete the intermediate tables made since ``mark`` but the newest."""
    last = _scratch.pop()
    release(mark)
    _scratch.append(last)


atexit.register(release)
