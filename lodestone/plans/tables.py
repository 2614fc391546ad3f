"""Cutting lineage: a plan is written as a table in the folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a local folder on a local master, else one in the
    warehouse, which a cluster shares as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone"
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """df as a Parquet table: one fixed evaluation, whatever is recomputed or re-planned later. discard() deletes it."""
    path = f"{work_dir(df.sparkSession)}/lodestone-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what materialise wrote for tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_written", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
