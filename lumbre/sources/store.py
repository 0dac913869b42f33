"""Reading the input tables and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One input table; Catalyst prunes the columns and pushes the filters."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). A local one only where none is set and all runs on this
    machine, as in tests; on a cluster without one this raises an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            return at.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumbre-")
        context.setCheckpointDir(f"file://{folder}")
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a read instead of a recomputation. The files go when the JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/lumbre-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(where)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(StructType.fromJson(df.schema.jsonValue())).parquet(where)


def parallelism(df: DataFrame) -> int:
    """Number of partitions of a shuffle in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
