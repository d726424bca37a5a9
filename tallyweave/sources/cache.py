"""Compute a slow table once, then read it back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def input_state(spark: SparkSession, inputs: Sequence[DataFrame]) -> list[tuple[str, int, int]]:
    """Name, size and time of change of every file behind the given tables."""
    out = []
    for file in sorted({f for df in inputs for f in df.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((file, status.getLen(), status.getModificationTime()))
    return out


def compute_once(
    spark: SparkSession,
    root: str,
    name: str,
    params: Mapping[str, object],
    build: Callable[[], DataFrame],
    inputs: Sequence[DataFrame] = (),
) -> DataFrame:
    """Read the stored table for these parameters and input files; build and store it first when it is missing or incomplete.

    ``inputs`` are the tables that ``build`` reads; when one of their files changes, the table is built anew.
    """
    params = dict(params) | ({"_inputs": input_state(spark, inputs)} if inputs else {})
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{digest}"
    if not _complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
