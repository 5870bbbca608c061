"""A log of snapshots: every version is one small file that only one writer can create.

A writer puts its data into a folder of its own, checks it, and then commits the next version: the version's file is created if it is absent, so of two
writers of one version one wins and the other learns it. Readers take the highest version; what its file says is all there is to know. Data
of a writer that lost, or died, is in no version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "snapshot-1"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _file(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/_versions/{version:010d}.json"


def put_if_absent(spark: SparkSession, file: str, text: str) -> bool:
    """Create a file with this text; False when it exists. Local files are created by the operating system's exclusive open, others by
    the file system's create without overwrite, which HDFS and stores with conditional writes decide atomically."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(file)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    if system.getScheme() == "file":
        try:
            with open(target.toUri().getPath(), "x", encoding="utf-8") as out:
                out.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = system.create(target, False)
    except Exception as exc:
        if "AlreadyExists" in str(exc) or system.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(version, parent, data, settings, state) of all versions; empty where none is."""
    schema = "format string, version long, parent long, data string, settings string, state string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_versions")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema).drop("format")
    rows = spark.read.schema(schema).json(f"{path.rstrip('/')}/_versions")
    known = F.when(F.col("format") == FORMAT, F.col("version")).otherwise(F.raise_error("not a version of this format").cast("long"))
    return rows.select(known.alias("version"), "parent", "data", "settings", "state")


def latest(spark: SparkSession, path: str):
    """The row of the highest version, or None."""
    return snapshots(spark, path).orderBy(F.col("version").desc()).first()


def new_folder(path: str) -> str:
    return f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"


def commit(spark: SparkSession, path: str, data: str, settings: dict, state: dict, *, after: int | None) -> int:
    """Commit ``data`` as the version after ``after`` (None: the first one). Raises Conflict when that version exists."""
    version = 0 if after is None else after + 1
    entry = {"format": FORMAT, "version": version, "parent": after, "data": data, "settings": json.dumps(settings, sort_keys=True), "state": json.dumps(state, sort_keys=True)}
    if not put_if_absent(spark, _file(path, version), json.dumps(entry) + "\n"):
        raise Conflict(f"version {version} of {path} exists")
    return version
