"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.session import scratch_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, passing: list[str] | None = None) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage and survives lost executors.

    The shuffle files of the write go with its end, since the table replaces them. ``passing`` gets the path of a table
    that the operator itself drops when its result no longer needs it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if passing is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``stored`` wrote."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """One output batch for each Arrow batch; batches are bounded in rows and bytes by the session's settings."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(each, schema)


def id_crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def small_side(df: DataFrame, megabytes: int, row_bytes: int = 48) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted now, fit into the limit; otherwise as it is.

    ``df`` should be a stored table. Elements of array columns are counted like rows.
    """
    arrays = [F.sum(F.size(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    counted = df.agg(F.count("*").alias("n"), *[a.alias(f"a{i}") for i, a in enumerate(arrays)]).first()
    return F.broadcast(df) if sum(x or 0 for x in counted) * row_bytes <= megabytes << 20 else df
