"""Session helpers: local sessions for tests and benches, checkpoint folder, input spreading."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "quarto", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a private one only on a local master where none is set (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix=f"quarto-ckpt-{os.getpid()}-"))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder, which cuts the lineage; smaller than a checkpoint, as columns are compressed.

    What was shuffled for it is of no more use: a collection on the driver lets
    Spark remove those files now rather than at some later time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy stage as many partitions as there are slots.

    Only inputs of fewer scan splits than slots are moved (small files); a
    large input keeps its splits, so nothing is shuffled there. Counting the
    partitions of a plan with a shuffle would run its stages, so such a plan is
    taken as it is.
    """
    if re.search(r"\b(?:Aggregate|Join|Window|Sort|Repartition\w*|Distinct|Deduplicate)\b", df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
