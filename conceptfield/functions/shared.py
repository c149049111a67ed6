"""Tables staged in the shared folder, and joins that a hot key doesn't gather in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, local
    mode takes a temporary folder; elsewhere the machines would not see one another's files, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="conceptfield-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/conceptfield/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the cluster has use for: a small file, or a shuffle of few bytes, would otherwise be one
    task, however much is computed for each row."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def set_digest(*columns: Column) -> list[Column]:
    """Aggregates h0 to h3 and rows that are equal for two groups only if their rows are; a group's rows must differ from one
    another. The digests of rows are put together by exclusive or, so no group is gathered, whatever its size."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    pieces = [F.bit_xor(F.conv(F.substring(row, 15 * i + 1, 15), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return [*pieces, F.count("*").alias("rows")]


def with_head(df: DataFrame, *keys: str) -> DataFrame:
    """df with `head`, the first concept of those with equal keys (nulls are equal), without the keys."""
    joint = F.sha2(F.to_json(F.struct(*keys)), 256)
    rows = df.withColumn("_key", joint).drop(*keys)
    return rows.join(rows.groupBy("_key").agg(F.min("concept").alias("head")), "_key").drop("_key")


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; to be called when no result that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_heavy(count: str, total: int, share: int = 1000) -> Column:
    """Holds for counts over 1/share of the total (and over 1000): fewer than share keys, whatever the data."""
    return F.col(count) > F.lit(max(1000, total // share))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, total: int, spread: Column) -> DataFrame:
    """Left join with a table that has one row a key, safe when a key holds a large share of left's rows.

    right's `count` says how many rows of left have the key, total is their sum. Keys over 1/1000 of the total
    are fewer than 1000, so they are broadcast; the others are shuffled, and rows already answered are dealt by
    `spread` instead of by their hot key.
    """
    values = [c for c in right.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in values])
    heavy = right.where(is_heavy(count, total)).select(*[F.col(k).alias(f"_h_{k}") for k in keys], payload.alias("_heavy"))
    none = F.lit(0).cast("long")
    # The salt is part of a hash: as a column of its own, its constant would leave the join's keys.
    light = right.where(~is_heavy(count, total)).select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.xxhash64(*keys, none).alias("_l_key"), payload.alias("_light"))
    on_heavy, on_light = F.lit(True), F.col("_key") == F.col("_l_key")
    for k in keys:
        on_heavy, on_light = on_heavy & (F.col(k) == F.col(f"_h_{k}")), on_light & (F.col(k) == F.col(f"_l_{k}"))
    first = left.join(F.broadcast(heavy), on_heavy, "left")
    salt = F.when(F.col("_heavy").isNull(), none).otherwise(F.pmod(spread, F.lit(1 << 30)) + 1)
    first = first.withColumn("_key", F.xxhash64(*keys, salt))
    both = first.join(light, on_light, "left").withColumn("_found", F.coalesce("_heavy", "_light"))
    return both.select(*left.columns, *[F.col("_found")[c].alias(c) for c in values])
