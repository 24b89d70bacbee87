"""Session helpers: settings a test or bench needs, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", app: str = "sitegauge", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SITEGAUGE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Plans here have thousands of column expressions; a call site is not kept for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only where unset on one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sitegauge-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def reliable(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder and cut lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key list of so many rows at most is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (narrow, already stored) marked for broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Tables of fewer bytes, as Spark estimates them, may be one split of a scan; larger ones have splits for all cores.
SMALL_SCAN = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Rows for heavy work on each of them: a small table is dealt out evenly over ``spark.sql.shuffle.partitions`` tasks, a
    large one stays where it is.

    So at most SMALL_SCAN bytes are moved, once; ``spark.sql.files.maxPartitionBytes`` makes the splits of a scan smaller.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if estimate < SMALL_SCAN else df


#: Bytes of small files that are read in one task.
TASK_BYTES = 128 << 20


def packed(df: DataFrame) -> DataFrame:
    """A scan of many small files in few tasks, without a shuffle.

    Spark adds some megabytes to the size of every file when it cuts a scan into splits, so ten thousand files of a
    kilobyte are hundreds of tasks. Splits are put together until each has about TASK_BYTES of what is really there;
    all cores are kept busy.
    """
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-estimate // TASK_BYTES)))


def with_package(df: DataFrame) -> DataFrame:
    """Let Python code of this package run on the executors of the session of `df`, once for a session.

    Needed where tasks import the package and the job was not submitted with it (``--py-files``).
    """
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_sitegauge_sent", False):
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="sitegauge-package-"), "sitegauge.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(home)))
        sc.addPyFile(path)
        sc._sitegauge_sent = True
    return df
