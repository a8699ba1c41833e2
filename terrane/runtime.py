"""Session, table and scratch-table helpers shared by every operator.

Iterative operators cut lineage by writing tables under the folder the cluster names in
``spark.checkpoint.dir``; a folder of our own is chosen only where that setting is empty.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[weakref.ref, str]] = []
_SHIPPED: set[str] = set()


def session(app: str = "terrane", master: str | None = None) -> SparkSession:
    """A session with the settings the operators assume (AQE on, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        b = b.config(key, value)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="terrane-ship-"), "terrane_src.zip")
    Path(path).write_bytes(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage. A folder of this machine is taken only if all tasks run on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terrane-scratch-"))
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    for ref, path in _LEFT:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            pass


atexit.register(_at_exit)


class Scratch:
    """Tables of one operator run. ``save`` writes and reads back; ``drop`` removes early ones.

    Tables that the returned frame still reads stay until the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{scratch_root(spark)}/terrane-{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        _LEFT.append((weakref.ref(spark), self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
