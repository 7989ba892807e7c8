"""Tables that several plans read, written once to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error elsewhere."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="log-scratch-")
        _scratch[app] = f"{base.rstrip('/')}/log-{app}"
        atexit.register(release, spark)
    return _scratch[app]


def release(spark: SparkSession) -> None:
    """Delete what staged() has written for this application."""
    try:
        root = _scratch.pop(spark.sparkContext.applicationId, None)
        if root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def staged(df: DataFrame) -> DataFrame:
    """df, written and read back: what made it runs once, and a lost executor costs one scan."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_disk(df: DataFrame) -> bool:
    """Whether the rows of df come one by one from a table of files, so that to read them again is no more than a scan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"
