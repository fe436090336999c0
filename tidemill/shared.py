"""Tables in the folder that the cluster shares: how jobs cut lineage and hand results on.

Files of that folder outlive executors, unlike cached blocks.  Each application has a folder of its own below it, which goes
when the application ends; tables that no later plan reads can go sooner.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import ValidationError

KEY = "spark.checkpoint.dir"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster has no folder that is safe to guess.
    """
    named = spark.sparkContext.getConf().get(KEY, None) or spark.conf.get(KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError(f"{KEY} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set(KEY, named)
    folder = f"{named.rstrip('/')}/tidemill-{spark.sparkContext.applicationId}"
    files, where = _file_system(spark, folder)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and makes row order and values stable for the
    jobs that read them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no plan will read again."""
    for t in tables:
        files, where = _file_system(t.sparkSession, t.stored_at)
        files.delete(where, True)
