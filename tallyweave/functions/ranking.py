"""Ranks, quantiles and p-value adjustment that never sort a whole group in one task.

A group may hold a large share of all rows, so ordering inside a group is split in two levels: rows fall into
order-preserving buckets, bucket totals are accumulated (few rows per group), and only the rows of one bucket are
ordered together. Equal values are collapsed to one counted row first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import checkpointed

_STEPS_PER_OCTAVE = 64
_OFFSET = 1_000_000


def magnitude_bucket(col) -> Column:
    """An order-preserving integer bucket of a number: about 1 % wide, zero in its own bucket."""
    x = (col if isinstance(col, Column) else F.col(col)).cast("double")
    steps = F.floor(F.log2(F.abs(x)) * _STEPS_PER_OCTAVE) + F.lit(_OFFSET)
    return F.when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps).cast("bigint")


def counted_values(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct (keys, value) with ``n`` rows, or the summed weight."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("bigint").alias("n"))


def running_counts(counted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``before``, ``upto`` and ``total``: counts below, up to and over all values of the group."""
    keyed = counted.withColumn("_b", magnitude_bucket(value)).withColumn("_k", F.lit(0))
    by_key = ["_k", *keys]
    buckets = keyed.groupBy(*by_key, "_b").agg(F.sum("n").alias("_bn"))
    below = Window.partitionBy(*by_key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *by_key,
        "_b",
        F.coalesce(F.sum("_bn").over(below), F.lit(0)).alias("_base"),
        F.sum("_bn").over(Window.partitionBy(*by_key)).alias("total"),
    )
    inside = Window.partitionBy(*by_key, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(buckets, [*by_key, "_b"])
        .withColumn("upto", F.col("_base") + F.sum("n").over(inside))
        .withColumn("before", F.col("upto") - F.col("n"))
        .drop("_k", "_b", "_base")
    )


def quantiles_of_counts(
    counted: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Exact interpolated quantiles per group from a (keys, value, n) table."""
    ranked = running_counts(counted, keys, value)
    aggs = [F.max("total").alias("total")]
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("before") <= at) & (at < F.col("upto")), F.col(value))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group."""
    return quantiles_of_counts(counted_values(df, keys, value, weight), keys, value, probs, names)


def benjamini_hochberg(df: DataFrame, p: str, families: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """False-discovery-rate adjusted p-values within each family; null p stays null."""
    # as one struct, a family with null columns equals itself
    columns = df.columns
    df = df.withColumn("_f", F.struct(*families)) if families else df
    families = ["_f"] if families else []
    ranked = running_counts(counted_values(df, families, p), families, p)
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("total") / F.col("upto"))
    ranked = ranked.withColumn("_b", magnitude_bucket(p)).withColumn("_k", F.lit(0))
    by_family = ["_k", *families]
    above = Window.partitionBy(*by_family).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = ranked.groupBy(*by_family, "_b").agg(F.min("_raw").alias("_m"))
    later = later.select(*by_family, "_b", F.min("_m").over(above).alias("_later"))
    inside = Window.partitionBy(*by_family, "_b").orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    adjusted = ranked.join(later, [*by_family, "_b"]).select(
        *families, p, F.least(F.min("_raw").over(inside), F.col("_later"), F.lit(1.0)).alias(out)
    )
    return df.join(adjusted, [*families, p], "left").select(*[c for c in columns if c != out], out)


def bonferroni(df: DataFrame, p: str, families: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """p times the number of tests in the family, at most 1; null p stays null and does not count."""
    families = list(families)
    if not families:
        m = df.agg(F.count(p).alias("m")).scalar()
        return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.col(p) * m, F.lit(1.0))))
    df = df.withColumn("_f", F.struct(*families))
    sizes = df.groupBy("_f").agg(F.count(p).alias("_m"))
    capped = F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("_m"), F.lit(1.0)))
    return df.join(sizes, "_f").withColumn(out, capped).drop("_m", "_f")


def global_index(df: DataFrame, order: Sequence[Column], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based numbers over a total order, without ordering the table in one task.

    The range-partitioned rows are written to the checkpoint folder together with their partition number, so a
    later retry sees the same partitions. Only one count per partition is accumulated.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.join(sizes, "_part")
        .withColumn(out, (F.col("_base") + within).cast("bigint"))
        .drop("_part", "_base")
    )


def pairs_of_groups(groups: DataFrame, order: Sequence[Column], left: str = "_l", right: str = "_r") -> DataFrame:
    """All unordered pairs of factor levels, each level given as one row of ``groups``.

    Levels are numbered, every level lists the numbers after its own, and the list is matched by equality.
    """
    cols = groups.columns
    keyed = groups.withColumn("_k", F.lit(0))
    numbered = keyed.withColumn("_i", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).withColumn(
        "_g", F.count(F.lit(1)).over(Window.partitionBy("_k"))
    )
    first = (
        numbered.filter(F.col("_i") < F.col("_g"))
        .withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_g").cast("int"))))
        .select("_j", F.struct(*cols).alias(left))
    )
    second = numbered.select(F.col("_i").alias("_j"), F.struct(*cols).alias(right))
    return first.join(second, "_j").drop("_j")
