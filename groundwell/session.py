"""Session settings and the shared work folder."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of narrow keys that one broadcast may hold.
BROADCAST_ROWS = 1_000_000


def build_session(master="local[*]", shuffle_partitions=8, driver_memory="8g", **conf):
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("groundwell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the checkpoint folder: the one the caller set, else spark.checkpoint.dir.

    Only a local session without either gets a temporary folder; on a cluster its executors would
    not see the driver's.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="groundwell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by=(), path: str | None = None, **options) -> DataFrame:
    """Writes a frame to the work folder and reads it back.

    Cuts the lineage in front of costly steps (a model call feeding several consumers), and lets
    a job that loses executors resume from files. `by`: columns that become directories; `path`: where to, for a
    caller who discards it; `options` are the writer's.
    """
    path = path or work_path(df.sparkSession, name)
    df.write.options(**options).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the work folder that no plan reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so when the driver's memory is collected, which
    on a large heap may be long after the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(keys: DataFrame, most: int | None = None) -> DataFrame:
    """The frame with a broadcast hint when it counts at most `most` rows, else as it is.

    Spark sizes a derived frame by its inputs, so without the count a handful of keys could make
    it shuffle the large side of a join. For frames that are cheap to compute twice.
    """
    bound = BROADCAST_ROWS if most is None else most
    return F.broadcast(keys) if keys.count() <= bound else keys
