"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds from which a step that was cut off is taken to have left much on disk.
LONG_S = 2


def session(app: str = "litweave", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume; on a cluster, pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, set as the context's checkpoint folder.

    Only where that is unset (local tests) is a folder of our own used; a machine-local folder is refused when
    executors run on other machines.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"litweave-checkpoints-{os.getuid()}")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage with a reliable checkpoint.

    Shuffle files and checkpoints that only the former lineage needed stay on disk until the driver's JVM collects its
    garbage, which it may not do for minutes; so after longer steps it is asked to.
    """
    spark, began = df.sparkSession, time.monotonic()
    _shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    if time.monotonic() - began > LONG_S:
        spark._jvm.System.gc()
    return out


class Stored:
    """Tables written to the shared folder and read back, for loops of many turns.

    A checkpoint hands on the partitioning of the plan before; where a turn joins several times, what is known of it
    multiplies with every turn. A written table starts afresh. ``turn`` drops the tables of the turn before last.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.ages = spark, [[], [], []]
        self.folder = f"{_shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.ages[0].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def turn(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.ages.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.ages.insert(0, [])


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
