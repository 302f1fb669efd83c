"""Tables kept between the stages of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without one, a temporary folder becomes it."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidora-"))
    return sc.getCheckpointDir().rstrip("/")


#: Shuffle files of a query are removed when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and returns it as read from there: the lineage ends, lost executors cost nothing.

    The shuffle files of the write are removed after it.
    """
    spark = prepared(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table that stored() wrote and no later stage reads."""
    sc = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the planner's claim about the partitioning of unions off.

    With it on, Spark 4.1.2 joins a union of differently coalesced shuffles without an exchange and loses rows (see
    tests/test_core.py).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
