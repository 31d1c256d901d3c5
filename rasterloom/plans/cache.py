"""Tables that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """``df`` kept in memory or on disk while it is used; a lost part is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where none is set on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


#: Rows in a file of a checkpoint, where it is known how many there are.
FILE_ROWS = 50_000


def cut(df: DataFrame, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, without its lineage.

    ``rows`` is about how many rows it has at most, if that is known. They go
    to a file for ``each`` so many, not to one for each shuffle partition, if
    these are more: on a local file system Spark starts a process for each file
    and one for its checksum, on others it sends requests.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // each)))
    return df.checkpoint(eager=True)
