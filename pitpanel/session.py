"""Session settings and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SESSION = {
    "spark.sql.session.timeZone": "UTC",
}


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Epoch conversions of zone-less timestamps need a UTC session."""
    for key, value in SESSION.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "pitpanel", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; ``master`` is left to spark-submit when None."""
    settings = {
        **SESSION,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a scratch one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    For intermediate tables that several branches of a plan need (every bucketed running
    aggregate reads its input twice): the upstream work is done once, later branches get
    column pruning and real sizes, and lost executors only cost a re-read.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(table: DataFrame | None) -> None:
    """Delete a table of ``materialize`` whose readers have all been written themselves.

    Its shuffle files go when the JVM collects its plan, as after ``spark.cleaner.periodicGC.interval``; this asks for it now.
    """
    path = getattr(table, "_written_to", None)
    if path is None:
        return
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
