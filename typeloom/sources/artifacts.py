"""Lists, models and pair tables kept as parquet beside a manifest that tells whether they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest that does not depend on their order: sums of the parts of each row's SHA-256."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")).cast("string") for i in range(8)]
    r = df.select(row.alias("_h")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *parts), 256).alias("d")).first()
    return r["n"], r["d"]


def write_artifact(df: DataFrame, path: str, kind: str, order: list[str] | None = None) -> None:
    """Writes ``df`` as parquet, in order within its files, and its manifest: kind, rows and digest."""
    (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/data")
    n, d = digest(df.sparkSession.read.parquet(f"{path}/data"))
    df.sparkSession.createDataFrame([(kind, n, d)], "kind string, n_rows long, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_artifact(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of an artefact of ``kind``; raises where kind, rows or digest are not those of the manifest."""
    m = spark.read.schema("kind string, n_rows long, digest string").json(f"{path}/manifest").first()
    df = spark.read.parquet(f"{path}/data")
    if m is None or m["kind"] != kind:
        raise ValueError(f"{path} holds no {kind}")
    if (m["n_rows"], m["digest"]) != digest(df):
        raise ValueError(f"{path} is not what was written")
    return df
