"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.session import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent on a local master (tests) a temporary folder is used.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    used = spark.sparkContext._jsc.sc().getCheckpointDir()
    if used.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="offersieve-"))
        used = spark.sparkContext._jsc.sc().getCheckpointDir()
    return used.get().rstrip("/")


def compact(df: DataFrame) -> DataFrame:
    """No table is written as a crowd of tiny files: at most spark.sql.shuffle.partitions, or eight for each core if that is more.

    So it is the session that says how large a partition gets at the data's size.
    """
    spark = df.sparkSession
    return df.coalesce(max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    All tables of an application stand in one folder, which may go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    compact(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}" in taken:
            name = f"{name}_"
        taken.add(f"_{name}")
        out.append(f"_{name}")
    return out


def crc_bucket(n: int, column: str = "doc_id"):
    """crc32(doc_id as text) mod n; null ids fall in bucket null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")
