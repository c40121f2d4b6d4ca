"""What every distributed step needs: the package on the executors, a shared folder, and a way to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SENT: set[str] = set()


def send(spark: SparkSession) -> None:
    """Put this package on the executors' path, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="setaudit-core-"), "setaudit_core.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.join("setaudit", os.path.relpath(os.path.join(at, f), top)))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a folder of this machine serves where tests set none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="setaudit-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there goes when the session's process ends, or by ``discard``."""
    path = f"{shared_dir(spark)}/setaudit-{uuid.uuid4().hex}-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a scratch path, once nothing will read it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(taken, *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so, whatever its case."""
    held, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str = "pos") -> DataFrame:
    """df with its rows numbered from 1 in their present order, without moving them into one partition.

    The rows are written once, by checkpoint(), each with its partition and place there; counts and numbers both come from
    that copy, so they agree however Spark would plan or split another run of df. Counts are one row a partition.
    """
    mid, of, first, base = free([*df.columns, name], "__mid", "__of", "__first", "__base")
    rows = checkpoint(df.withColumn(mid, F.monotonically_increasing_id())).withColumn(of, F.shiftright(mid, 33))
    begins, total = [], 0
    for p, n in sorted(rows.groupBy(of).count().collect()):
        begins.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(begins, f"{first} long, {base} long")
    placed = rows.join(starts, F.col(of) == F.col(first))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(base) + F.col(mid) - F.shiftleft(F.col(of), 33) + 1).alias(name))
