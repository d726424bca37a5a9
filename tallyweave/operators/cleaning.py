"""Row-level cleaning, stacking and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import group_key, recode
from tallyweave.functions.draws import draw_int


def reorder(df: DataFrame, first: Sequence[str] = (), drop_prefix: str | None = None) -> DataFrame:
    """Named columns first, then everything else except columns with the prefix."""
    rest = [c for c in df.columns if c not in first and not (drop_prefix and c.startswith(drop_prefix))]
    return df.select(*first, *rest)


def z_score(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "z") -> DataFrame:
    """(x - mean) / sd, over the table or per group; a constant group gives null."""
    if not keys:
        mean = df.agg(F.avg(value).alias("m")).scalar()
        sd = df.agg(F.stddev_samp(value).alias("s")).scalar()
        return df.withColumn(out, (F.col(value) - mean) / F.nullif(sd, F.lit(0.0)))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    scaled = (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return df.join(stats, list(keys), "left").withColumn(out, scaled).drop("_m", "_s")


def length_band(df: DataFrame, low: int, high: int, seq: str = "seq") -> DataFrame:
    return df.filter(F.length(seq).between(low, high))


def stack(tables: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with missing columns as null, tagged by source."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def add_baseline(df: DataFrame, keys: Sequence[str], constants: Mapping[str, Column]) -> DataFrame:
    """Add one constant row per distinct key."""
    base = df.select(*keys).distinct().withColumns(dict(constants))
    return df.unionByName(base, allowMissingColumns=True)


def impute_missing(df: DataFrame, value: str, keys: Sequence[str | Column], seed, high: int = 20) -> DataFrame:
    """Non-detects become a whole number in 1..high, fixed by (seed, keys)."""
    drawn = (F.lit(1) + draw_int(seed, *keys) % F.lit(high)).cast("double")
    return df.withColumn(value, F.coalesce(F.col(value).cast("double"), drawn))


def phase_label(day: str | Column) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    return F.when(day > 0, "POSTINFECTION").otherwise("PREINFECTION")


def attach_assay(
    meta: DataFrame,
    assay: DataFrame,
    sample_key: Sequence[Column],
    assay_key: Sequence[Column],
    values: Sequence[str],
    recodes: Mapping[str, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Left join of measured values by a composed key. A key that occurs twice in the assay raises an error."""
    for column, mapping in (recodes or {}).items():
        assay = assay.withColumn(column, recode(column, mapping))
    right = assay.select(group_key(*assay_key).alias("_id"), *values)
    once = right.groupBy("_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(v).alias(v) for v in values]
    )
    once = once.withColumn(
        "_id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate assay key "), "_id")))
    ).drop("_n")
    return meta.withColumn("_id", group_key(*sample_key)).join(once, "_id", "left").drop("_id")
