"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests, benches) a temporary one is made,
    named in the session and removed at exit; on a cluster an unset name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="gradeloom-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and forget how they were made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one for what a job leaves to read; it goes when the driver ends."""
    at = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, at)
    return at


def _remove(at: str) -> None:
    fs, path = pafs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (pafs.LocalFileSystem(), at)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
