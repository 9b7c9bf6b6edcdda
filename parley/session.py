"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Where a session without a checkpoint folder keeps its scratch tables (tests, single machine).
_LOCAL_WORK: dict[str, str] = {}


def build_session(app: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    ``spark.sql.shuffle.partitions`` is left to the cluster: the ordered scans read it to decide
    which keys are too big for one task, so it should be set so that ``input / partitions`` fits
    one task's memory.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder of this session.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only on one machine
    (local master, tests) a temporary folder takes its place; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_WORK.setdefault(app, tempfile.mkdtemp(prefix="parley-"))
    return f"{base.rstrip('/')}/parley-{uuid.uuid4().hex}"
