"""Tables that cut lineage: written to the folder all executors share.

The folder is the cluster's ``spark.checkpoint.dir``.  Only a session without
that setting (tests, a laptop) falls back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("quire_staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir.rstrip("/")


#: Rows and bytes of input that a task and a file of what is made from it are worth.
FILE_ROWS, FILE_BYTES = 4096, 8 << 20


def files_for(rows: int, size: int) -> int:
    """Files that a table made from so many rows and bytes should have at most."""
    return max(1, -(-rows // FILE_ROWS), -(-size // FILE_BYTES))


def staged(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Lost executors cost at most the tasks in flight: what is written stays.
    The files go when the application ends.  With ``files``, as of ``files_for``,
    small tables don't get a file for each shuffle partition: on a local file
    system without native code each file starts processes of its own.
    """
    df = df.coalesce(files) if files else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if (scope := _SCOPE.get()) is not None:
        scope.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``staged`` returned, once no other frame is made from it any more."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def discarding() -> Iterator[None]:
    """What is staged inside goes at its end; write what was made from it before.

    For work that comes again and again in one application, as a stream's batches do.
    """
    mine: list[DataFrame] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for df in mine:
            discard(df)
