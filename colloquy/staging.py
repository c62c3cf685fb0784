"""Tables between steps, in the folder that all executors share. They outlive lost executors and go with `clear`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder.

    The folder is the one named by spark.checkpoint.dir (or set as the checkpoint directory). Where none is set, a local master
    takes one under the warehouse, as in tests; on a cluster that might be one machine's own disk, so it is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{root.rstrip('/')}/colloquy-{context.applicationId}"


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lost executor costs no earlier step."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what this application has staged; results that haven't been read by then are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
