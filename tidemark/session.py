"""Sessions: the settings the engine expects, its own code on every worker, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application; the driver's file server hands the few kilobytes out."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def session(master: str = "local[*]", partitions: int = 8, name: str = "tidemark") -> SparkSession:
    """A session with the time zone and adaptive settings that the operators are written for."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, str(value))
    return ship(builder.getOrCreate())


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master; elsewhere executors would write to their
    own disks, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="tidemark-"))
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df computed and its lineage cut, in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df computed and its lineage cut like cut(), in a compressed table of this application: for what grows with the input."""
    path = f"{own_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table of the engine's state over `source`, written once for each application and read from then on."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _kept:
        path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def forget(spark: SparkSession, source: str) -> None:
    """From now on all kept tables over `source` are made anew."""
    for key in [k for k in _kept if k[:2] == (spark.sparkContext.applicationId, source)]:
        del _kept[key]
