"""Session and table access shared by queries, the command line and tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cantera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans are built in half the time
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Union sides that adaptive execution reads in different ways must not be zipped
    partition by partition, which Spark 4.1 tries where both were hashed alike."""
    try:
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    except Exception:  # noqa: BLE001 - not a setting of this Spark
        pass


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory; columns are pruned by the scan."""
    prepare(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints and written tables go to.

    A cluster names it in ``spark.checkpoint.dir``, and must, as a folder of one
    machine would be lost with it. Only in local mode is one made where none is
    named; it is removed when Python ends.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="cantera-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that losing executors costs nothing."""
    prepare(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of tables written by ``written`` and not yet removed.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage as a checkpoint does, is
    compressed, and is read by column. For tables whose readers shuffle; a read has few,
    large partitions. :func:`forget` removes the tables once their readers are done."""
    spark = df.sparkSession
    prepare(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _WRITTEN.append(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(spark: SparkSession) -> None:
    """Removes every table that ``written`` made in this process."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
