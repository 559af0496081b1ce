"""Where derived files go when a caller names no place."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset: Hadoop's own temporary folder on the session's default file
    system, which all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jpath, fs = hadoop_path(spark, spark._jsc.hadoopConfiguration().get("hadoop.tmp.dir"))
        root = f"{fs.makeQualified(jpath).toString()}/tableferry"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing exists there yet. It goes when the driver ends."""
    path = f"{shared_root(spark)}/tableferry/{name}-{uuid.uuid4().hex}"
    jpath, fs = hadoop_path(spark, path)
    fs.deleteOnExit(jpath)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, through the running JVM."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or at least one match of a pattern, is there."""
    jpath, fs = hadoop_path(spark, path)
    found = fs.globStatus(jpath)
    return found is not None and len(found) > 0


def replace_path(spark: SparkSession, new: str, path: str) -> None:
    """Put what lies at ``new`` in the place of ``path``.

    The old folder is renamed away first and deleted last: one of the two is always there.
    """
    source, fs = hadoop_path(spark, new)
    target, _ = hadoop_path(spark, path)
    aside, _ = hadoop_path(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    old = fs.exists(target)
    if old and not fs.rename(target, aside):
        raise OSError(f"could not move {path} away")
    if not fs.rename(source, target):
        if old:
            fs.rename(aside, target)
        raise OSError(f"could not move {new} to {path}")
    if old:
        fs.delete(aside, True)


def overlaps(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two paths are the same place, or one lies inside the other."""
    full = []
    for path in (a, b):
        jpath, fs = hadoop_path(spark, path)
        full.append(fs.makeQualified(jpath).toString().rstrip("/") + "/")
    return full[0].startswith(full[1]) or full[1].startswith(full[0])
