"""Where intermediate tables go: the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import errno
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the checkpoint folder that the session has been given.

    With neither, a local master gets a temporary folder of its own; on a cluster executors couldn't see each other's
    files there, so that it's an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="sparkloom-")
        _LOCAL[context.applicationId] = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet and read back: lineage ends, and columns and partitions can be pruned later."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def renamed(spark: SparkSession, old: str, new: str, overwrite: bool = False) -> bool:
    """Rename a file, or a folder with files, in one step; False if the new name is taken and mustn't be overwritten."""
    full = [system.makeQualified(where) for where, system in (file_system(spark, p) for p in (old, new))]
    if full[0].toUri().getScheme() == "file":  # Hadoop's local rename looks first and then moves
        one, two = (p.toUri().getPath() for p in full)
        try:
            if os.path.isdir(one) or overwrite:
                os.rename(one, two)
            else:
                os.link(one, two)
                os.unlink(one)
        except OSError as e:
            if e.errno in (errno.ENOTEMPTY, errno.EEXIST):
                return False
            raise
        return True
    gateway, fs = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    options = gateway.new_array(rename, int(overwrite))
    if overwrite:
        options[0] = rename.OVERWRITE
    try:
        fs.FileContext.getFileContext(full[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*full, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def write_text(spark: SparkSession, path: str, text: str, backup: bool = False) -> None:
    """Replace a small text file in one step: a reader sees the old text or the new one. The old one may be kept as ``.bak``."""
    where, system = file_system(spark, path)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    if backup and system.exists(where):
        write_text(spark, f"{path}.bak", read_text(spark, path) or "")
    stream = system.create(file_system(spark, aside)[0], True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    renamed(spark, aside, path, overwrite=True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if it isn't there."""
    where, system = file_system(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
