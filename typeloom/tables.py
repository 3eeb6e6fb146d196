"""Reading the input tables and writing shared intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, over all cores; column pruning and filters reach the scan."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per session."""
    if spark.conf.get("spark.typeloom.shipped", "no") == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="typeloom-")) / "typeloom-package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    spark.conf.set("spark.typeloom.shipped", spark.sparkContext.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small file gives fewer partitions than there are cores; larger inputs are read in place."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; a local one only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'typeloom-shared')}"
    return base


#: Intermediate tables of this process; they go when it ends.
_WRITTEN: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors, is computed once.

    What is returned may be read as long as the driver lives; the table is removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/typeloom-{what}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(removed)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed() -> int:
    """Removes the intermediate tables this process has written, and nothing else; how many went."""
    spark, n = SparkSession.getActiveSession(), 0
    if spark is None:
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n
