"""Where jobs keep what must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names.

    Only a local session may go without that setting: a folder of one machine
    is lost with it, so a cluster session without the setting is an error.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SETTING} to a shared folder")
        base = tempfile.mkdtemp(prefix="hrefloom-")
    return f"{base.rstrip('/')}/hrefloom-{name}-{uuid.uuid4().hex}"
