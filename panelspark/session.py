"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and Arrow switched on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Without the setting a session on one machine takes a fresh local folder, and one on a cluster the warehouse,
    which all executors share; the choice is recorded in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="run-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelspark/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, unless their path already has its folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_panelspark_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="package-"), "panelspark")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "panelspark"))
    sc._panelspark_shipped = True


def materialize(df, name: str = "stage"):
    """Write ``df`` to the scratch folder and read it back: cuts lineage and survives executor loss."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
