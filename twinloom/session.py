"""Sessions and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "twinloom") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {"spark.sql.shuffle.partitions": cores if cores.isdigit() else "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine's only where none is set and the session is local, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context._jsc.sc().getCheckpointDir().isEmpty():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "twinloom-checkpoints")


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table of its own in the shared folder, compressed, so executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/twinloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
