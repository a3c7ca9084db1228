"""Tables that an operator writes in between and reads more than once.

They lie in the folder that ``spark.checkpoint.dir`` names, which the driver and all executors
share, and go when the driver's process ends.  A written table cuts the lineage: a lost executor
costs no more than the tasks that read it, and plans built on it stay small.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a session on one machine without one gets a local folder, on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark, "_depthline_tables", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = spark._depthline_tables = "file://" + tempfile.mkdtemp(prefix="depthline-")
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
        pass


#: Whether shuffle files go when the query that made them ends, instead of when the driver's JVM next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; what was shuffled to make it goes at once, as nothing reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables from which all that is still read has been written anew."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            _delete(table.sparkSession, path)
