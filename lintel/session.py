"""The session: settings for local use, the folder that all executors share, and the package's code for Python workers."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(name: str = "lintel", cores: str = "*", partitions: int = 8, memory: str = "8g", ui: bool = False) -> SparkSession:
    """A session for one machine, with Spark's UI (plans, times, profiles) if asked for; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", str(ui).lower())
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all is one process (tests). On a cluster it must be set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lintel-"))
    return sc.getCheckpointDir().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, by a zip file in the shared folder; once a session's context."""
    sc = spark.sparkContext
    if getattr(sc, "_lintel_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(os.path.join(ROOT.name, p.relative_to(ROOT)), (2020, 1, 1, 0, 0, 0)), p.read_bytes())
    content = data.getvalue()
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{ROOT.name}-{hashlib.sha256(content).hexdigest()[:16]}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        out.write(bytearray(content))
        out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._lintel_shipped = True
