"""Session construction and table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "quarry", master: str | None = None, partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC times. Nothing else is set unless asked for, so that
    a cluster's own defaults hold."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, as in tests on one
    machine, a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of the application that is deleted when the driver's JVM ends."""
    own = f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, later reads survive the loss of any executor, and it goes with the application."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]):
    """What build(path) made of the tables of a folder, once for each application: indexes that many queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = build(scratch(spark, name))
    return _STORED[key]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package where they couldn't import it: a driver that runs elsewhere and has the folder neither as its
    working directory nor on PYTHONPATH. Spark hands the archive to every executor, also to ones that join later."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    known = [Path(p or ".").resolve() for p in (os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p] + [Path.cwd()]
    if app in _SHIPPED or root in known:
        return
    folder = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the archive as long as it runs
    archive = Path(folder) / "quarry-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*sorted((root / "quarry").rglob("*.py")), *sorted(root.glob("corpus_pipeline.py"))]:
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
