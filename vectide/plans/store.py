"""Tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process wrote and hasn't removed yet, with the session that did.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of
    its own (tests); on a cluster, where a local folder would be another one on each machine, it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "vectide-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives a lost executor. The folder goes
    with ``forget``, or when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def _remove(path: str) -> None:
    spark = _written.pop(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*frames: DataFrame) -> None:
    """Remove the folders of kept frames that no later plan reads."""
    for df in frames:
        if getattr(df, "_kept", None) in _written:
            _remove(df._kept)


@contextlib.contextmanager
def scratch():
    """Removes, at its end, the folders that ``keep`` wrote within it, but for those of the frames appended to what it gives."""
    before, stays = set(_written), []
    yield stays
    for path in set(_written) - before - {getattr(df, "_kept", None) for df in stays}:
        _remove(path)


@atexit.register
def _sweep() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session has ended: its files can't be reached any more
            _written.pop(path, None)
