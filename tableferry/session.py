"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tableferry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; every other setting is left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Shared folders of sessions without a setting, and the owners of what is written now, by application.
_ROOTS: dict[str, str] = {}
_OWNERS: dict[str, list[str]] = {}


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    application = spark.sparkContext.applicationId
    if application not in _ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
        _ROOTS[application] = tempfile.mkdtemp(prefix="tableferry-")
    return _ROOTS[application]


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: on a cluster the executors
    would not see it, so there the setting is required. Inside ``scratch`` the folder belongs to it.
    """
    owners = _OWNERS.get(spark.sparkContext.applicationId)
    root = owners[-1] if owners else _shared_root(spark)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write between their steps inside the block are deleted at its end.

    Results must be used, or written elsewhere, before that: they read these tables.
    """
    owner = os.path.join(_shared_root(spark), f"scratch-{uuid.uuid4().hex[:12]}")
    owners = _OWNERS.setdefault(spark.sparkContext.applicationId, [])
    owners.append(owner)
    try:
        yield owner
    finally:
        owners.remove(owner)
        location = spark._jvm.org.apache.hadoop.fs.Path(owner)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
