"""Session settings shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lodestrata", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; master and sizes come from the caller or the cluster."""
    b = SparkSession.builder.appName(app)
    if cpus is not None:
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session may do without one: a folder of its own machine is then everybody's.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    kept = sc._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='lodestrata-')}")
        kept = sc._jsc.sc().getCheckpointDir()
    return found or kept.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut a plan's lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialise(df: DataFrame) -> DataFrame:
    """Cut a plan's lineage by a table in the shared folder, which goes with the session.

    Loops that join many times want this rather than `checkpoint`, whose result keeps the constraints of its plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
