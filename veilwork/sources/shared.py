"""Tables between the stages of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    On a cluster it is what spark.checkpoint.dir names. A folder of our own is
    made only where that is unset and all work is done on this machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veilwork-"))
    return context.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """Where this session's tables lie, in the shared folder."""
    return f"{shared_folder(spark)}/veilwork-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    A query's result may read these tables; clear() removes them when results have been written.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that stored() wrote in this session. Results of operators that were not written are lost."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
