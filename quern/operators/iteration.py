"""Tables of iterative algorithms in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and all runs on this machine (tests); else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again, which cuts its lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*settled: DataFrame) -> None:
    """Removes tables of settle() that no later plan reads."""
    for df in settled:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(conf).delete(at, True)


#: Rows that cross to Python at once. Texts may be long, and both sides hold a batch.
ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches in this session; a smaller bound that is already set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def give_back() -> None:
    """Returns free memory of this process to the system: workers outlive their tasks, and an executor has several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)
