"""Session factory."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "codexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, ANSI casts and adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in a local session without that setting (tests in one process) a temporary
    folder is made and used; elsewhere a folder of this machine would be lost to the
    executors, so the setting is asked for.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = "file://" + tempfile.mkdtemp(prefix="codexmill-")
    spark.sparkContext.setCheckpointDir(own)
    return own
