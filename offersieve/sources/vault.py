"""Encrypted objects in a Parquet table: seal, open, list, append, delete, back up, restore."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.schema import SCHEMA_VERSION

ROUNDS = 600_000


def derive_keys(password: str, salt: bytes, rounds: int = ROUNDS) -> tuple[bytes, bytes]:
    """Two 256-bit keys: one for objects, one for secrets."""
    raw = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 64)
    return raw[:32], raw[32:]


def seal(text: Column, key: bytes, aad: Column) -> Column:
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.expr("unhex('')"), aad)


def unseal(data: Column, key: bytes, aad: Column) -> Column:
    """Null if the key, the data or the context is not the one it was sealed with."""
    return F.try_aes_decrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def _aad() -> Column:
    return F.concat_ws("|", "kind", "id", F.lit(SCHEMA_VERSION))


def save(spark: SparkSession, path: str, kind: str, records: DataFrame, key: bytes, object_id: str | None = None) -> str:
    """Append records as one sealed object (a row for each record); a new id unless one is given."""
    object_id = object_id or uuid.uuid4().hex
    rows = records.select(F.lit(kind).alias("kind"), F.lit(object_id).alias("id"), F.to_json(F.struct("*")).alias("_json"))
    rows.select("kind", "id", seal(F.col("_json"), key, _aad()).alias("data"), F.lit(SCHEMA_VERSION).alias("version")).write.mode("append").partitionBy("kind").parquet(path)
    return object_id


def load(spark: SparkSession, path: str, kind: str, key: bytes, schema: str, object_id: str | None = None) -> DataFrame:
    """Records of one kind (of one object); rows that don't open are left out."""
    rows = spark.read.parquet(path).where(F.col("kind") == kind)
    if object_id is not None:
        rows = rows.where(F.col("id") == object_id)
    opened = rows.withColumn("_json", unseal(F.col("data"), key, _aad())).where("_json is not null")
    return opened.select("id", F.from_json("_json", schema).alias("r")).select("id", "r.*")


def objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("kind", "id").agg(F.count("*").alias("n_rows"), F.max("version").alias("version"))


def delete(spark: SparkSession, path: str, target: str, kind: str, object_id: str | None = None) -> None:
    """Write the table without an object, or without a kind, to target."""
    gone = (F.col("kind") == kind) & (F.lit(True) if object_id is None else F.col("id") == object_id)
    spark.read.parquet(path).where(~gone).write.mode("overwrite").partitionBy("kind").parquet(target)


def backup(spark: SparkSession, path: str, target: str, secrets: tuple[str, ...] = ("secret",)) -> None:
    """Everything but secrets; rows stay sealed."""
    spark.read.parquet(path).where(~F.col("kind").isin(*secrets)).write.mode("overwrite").parquet(target)


def restore(spark: SparkSession, source: str, path: str, mode: str = "merge") -> None:
    """Merge adds objects that are not there; replace puts the backup in their place. Another major version is refused."""
    rows = spark.read.parquet(source)
    odd = rows.where(F.substring_index("version", ".", 1) != SCHEMA_VERSION.split(".")[0]).limit(1).count()
    if odd:
        raise ValueError("the backup has another schema version")
    if mode == "merge":
        rows = rows.join(objects(spark, path).select("kind", "id"), ["kind", "id"], "left_anti").select("kind", "id", "data", "version")
        rows.write.mode("append").partitionBy("kind").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("kind").parquet(path)
