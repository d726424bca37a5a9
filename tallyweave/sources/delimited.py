"""Delimited text in and out."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing_to_null(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~F.col(f"`{n}`").isin("", "NA"), F.col(f"`{n}`")) for n in texts})


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str) -> DataFrame:
    """Header line, explicit schema in file order, empty cells and NA as null."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False)
    return _missing_to_null(df)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, "\t")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, ",")


def clean_name(name: str) -> str:
    """One readable word per header cell: line breaks, blanks and punctuation become single underscores."""
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_")


def read_lab_sheet(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """A spreadsheet export: quoted header cells over several lines, CRLF ends, blank numeric cells.

    Quoted line breaks rule out splitting one file, so parallelism comes from many files. ``types`` maps cleaned
    names to SQL types; a cell that does not parse becomes null.
    """
    raw = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"')
    df = raw.toDF(*[clean_name(c) for c in raw.columns])
    df = df.withColumns({c: F.regexp_replace(F.col(c), r"\r$", "") for c in df.columns})
    df = _missing_to_null(df)
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items()})


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    df.write.mode(mode).options(**options).csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    df.write.mode(mode).options(**options).csv(path, sep=",", header=True)


def write_by_key(df: DataFrame, path: str, key: str = "comparison", mode: str = "errorifexists") -> None:
    """One folder of TSV files per key value."""
    df.write.mode(mode).partitionBy(key).csv(path, sep="\t", header=True)
