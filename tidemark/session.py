"""Sessions with the settings the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Kryo left alone; any setting can be overridden."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: ``spark.checkpoint.dir``, or a temporary one where
    that is unset (one machine, tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root and not on_one_machine(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that executors share."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
