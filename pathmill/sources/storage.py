"""Where views and intermediate tables are kept, and what a user of a shared folder needs: existence and removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Where it is unset, a local folder will do for a local
    session, whose executor is the driver; on a cluster it is an error, since executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pathmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_file(spark: SparkSession, path: str) -> str:
    """The name under which programs other than Spark find ``path``, which must lie in a mounted file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri()
    if where.getScheme() not in (None, "file"):
        raise ValueError(f"{path} is in no mounted file system")
    return where.getPath()


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return bool(files.exists(where))


def children(spark: SparkSession, path: str) -> list[str]:
    files, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or a folder with all that is in it; whether there was one."""
    files, where = _at(spark, path)
    return bool(files.delete(where, True))
