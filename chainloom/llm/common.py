"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside joins; never returned.
NO_ID = -(2**63)

#: What the documents call white space: space and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (tests) gets a folder of its own; a cluster has none to fall back on, since a folder of this machine would be
    empty on every other."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chainloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors
    and tells the optimizer the true size of what follows. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chainloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, when nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


Batches = Iterator[pa.RecordBatch]


def in_slices(f: Callable[[Batches], Batches], most: int = 2_000_000) -> Callable[[Batches], Batches]:
    """f for mapInArrow, given slices of about most bytes (one row at least): texts are long, and what is made of a batch
    is held several times over."""

    def slices(batches: Batches) -> Batches:
        for batch in batches:
            step = max(1, int(len(batch) * most / max(1, batch.nbytes)))
            for k in range(0, len(batch), step):
                yield batch.slice(k, step)

    return lambda batches: f(slices(batches))


def id_or_none(column: str = "doc_id") -> Column:
    """The id for joins, with NO_ID for null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def real_id(column: str) -> Column:
    """The id as given: null again for NO_ID."""
    return F.when(F.col(column) != NO_ID, F.col(column))
