"""Linear models whose predictors are factors: every estimate follows from the size, mean and spread of the cells.

``keys`` name independent fits (for example imputation seeds); factors come as column names with ordered levels, the
first level being the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.distributions import t_multiplier, t_pvalue
from tallyweave.functions.ranking import benjamini_hochberg, bonferroni
from tallyweave.operators.cleaning import impute_missing
from tallyweave.session import checkpointed


def replicate(df: DataFrame, runs: int, out: str = "seed") -> DataFrame:
    """Each row once per seed 1..runs."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(runs).cast("bigint"))))


def cells(df: DataFrame, value: str, factors: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``n, mean, ss`` (sum of squares around the mean) per factor combination; null values are left out."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, *factors)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("ss"),
        )
    )


def with_residual(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add residual degrees of freedom and standard deviation of the saturated model to every cell.

    The cells are few and used several times by every model, so they are stored once and the data is read once. The
    stored column ``_k`` is a constant key for joins to one-row tables.
    """
    by = ["_k", *keys]
    table = checkpointed(table.withColumn("_k", F.lit(0)))
    pooled = table.groupBy(*by).agg((F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum("ss").alias("_sse"))
    pooled = pooled.withColumn("sigma", F.sqrt(F.try_divide(F.col("_sse"), F.col("df")))).drop("_sse")
    return table.join(pooled, by)


def _tests(df: DataFrame, conf: float = 0.95, interval: bool = True) -> DataFrame:
    df = df.withColumn("statistic", F.try_divide(F.col("estimate"), F.col("std_error")))
    df = df.withColumn("p_value", t_pvalue(F.col("statistic"), F.col("df").cast("double")))
    if interval:
        half = t_multiplier(F.col("df").cast("double"), conf) * F.col("std_error")
        df = df.withColumn("_h", half)
        df = df.withColumns({"conf_low": F.col("estimate") - F.col("_h"), "conf_high": F.col("estimate") + F.col("_h")})
        df = df.drop("_h")
    return df


def _reference(table: DataFrame, condition: Column, keys: Sequence[str], name: str) -> DataFrame:
    picked = table.filter(condition).select("_k", *keys, F.col("n").alias(f"n_{name}"), F.col("mean").alias(f"mean_{name}"))
    return picked


def one_way(df: DataFrame, value: str, factor: str, levels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``value ~ factor``: the reference mean as intercept, every other level as difference to it."""
    keys = list(keys)
    table = with_residual(cells(df.filter(F.col(factor).isin(list(levels))), value, [factor], keys), keys)
    ref = _reference(table, F.col(factor) == levels[0], keys, "ref")
    is_ref = F.col(factor) == levels[0]
    out = table.join(ref, ["_k", *keys]).select(
        *keys,
        F.when(is_ref, F.lit("(Intercept)")).otherwise(F.concat(F.lit(factor), F.col(factor))).alias("term"),
        F.when(is_ref, F.col("mean")).otherwise(F.col("mean") - F.col("mean_ref")).alias("estimate"),
        (F.col("sigma") * F.sqrt(F.lit(1.0) / F.col("n") + F.when(is_ref, F.lit(0.0)).otherwise(F.lit(1.0) / F.col("n_ref")))).alias("std_error"),
        "df",
    )
    return _tests(out)


def two_way(df: DataFrame, value: str, a: str, a_levels: Sequence, b: str, b_levels: Sequence[str]) -> DataFrame:
    """``value ~ a * b`` with all cells: intercept, main effects in the reference cell row or column, interactions."""
    table = with_residual(cells(df.filter(F.col(a).isin(list(a_levels)) & F.col(b).isin(list(b_levels))), value, [a, b]))
    a0, b0 = F.col(a) == F.lit(a_levels[0]), F.col(b) == F.lit(b_levels[0])
    same_a = table.filter(b0).select(a, F.col("n").alias("n_a"), F.col("mean").alias("mean_a"))
    same_b = table.filter(a0).select(b, F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    corner = _reference(table, a0 & b0, [], "0")
    full = table.join(same_a, a).join(same_b, b).join(corner, "_k")
    name_a = F.concat(F.lit(a), F.col(a).cast("string"))
    name_b = F.concat(F.lit(b), F.col(b).cast("string"))
    inv = lambda c: F.lit(1.0) / F.col(c)
    term = F.when(a0 & b0, F.lit("(Intercept)")).when(b0, name_a).when(a0, name_b).otherwise(F.concat_ws(":", name_a, name_b))
    estimate = (
        F.when(a0 & b0, F.col("mean"))
        .when(a0 | b0, F.col("mean") - F.col("mean_0"))
        .otherwise(F.col("mean") - F.col("mean_a") - F.col("mean_b") + F.col("mean_0"))
    )
    weight = (
        F.when(a0 & b0, inv("n")).when(a0 | b0, inv("n") + inv("n_0")).otherwise(inv("n") + inv("n_a") + inv("n_b") + inv("n_0"))
    )
    return _tests(
        full.select(term.alias("term"), estimate.alias("estimate"), (F.col("sigma") * F.sqrt(weight)).alias("std_error"), "df")
    )


def marginal_means(df: DataFrame, value: str, factors: Sequence[str], keys: Sequence[str] = (), conf: float = 0.95) -> DataFrame:
    """Cell means with standard error and confidence limits from the pooled residual."""
    table = with_residual(cells(df, value, factors, keys), keys)
    half = t_multiplier(F.col("df").cast("double"), conf)
    table = table.withColumn("se", F.col("sigma") / F.sqrt(F.col("n").cast("double"))).withColumn("_h", half * F.col("se"))
    return table.select(
        *keys, *factors, F.col("mean").alias("emmean"), "se", "df",
        (F.col("mean") - F.col("_h")).alias("lower_cl"), (F.col("mean") + F.col("_h")).alias("upper_cl"),
    )


def pairwise_contrasts(
    df: DataFrame,
    value: str,
    factor: str,
    levels: Sequence[str],
    by: Sequence[str] = (),
    keys: Sequence[str] = (),
    adjust: str = "fdr",
) -> DataFrame:
    """Differences of all pairs of levels, earlier level first, within every ``by`` cell of one saturated model.

    The residual is pooled over all cells; p-values are adjusted within each ``by`` cell. Every level lists the levels
    after it and finds them by an equality join.
    """
    by, keys = list(by), list(keys)
    known = df.filter(F.col(factor).isin(list(levels)))
    table = with_residual(cells(known, value, [*by, factor], keys), keys)
    pairs = [x for i, level in enumerate(levels) for x in (F.lit(level), F.array(*[F.lit(v) for v in levels[i + 1 :]]).cast("array<string>"))]
    later = F.explode(F.try_element_at(F.create_map(*pairs), F.col(factor)))
    left = table.withColumn("_other", later)
    right = table.select("_k", *keys, *by, F.col(factor).alias("_other"), F.col("n").alias("n2"), F.col("mean").alias("mean2"))
    joined = left.join(right, ["_k", *keys, *by, "_other"])
    out = joined.select(
        *keys,
        *by,
        F.concat_ws(" - ", F.col(factor), "_other").alias("contrast"),
        (F.col("mean") - F.col("mean2")).alias("estimate"),
        (F.col("sigma") * F.sqrt(F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("n2"))).alias("std_error"),
        "df",
    )
    out = _tests(out, interval=False)
    family = [*keys, *by]
    fit = {"fdr": benjamini_hochberg, "bonferroni": bonferroni}[adjust]
    return fit(out, "p_value", family, "adj_p_value")


def imputation_sensitivity(
    df: DataFrame, value: str, factor: str, levels: Sequence[str], ids: Sequence[str], runs: int = 100, high: int = 20
) -> DataFrame:
    """The one-way model on log10 values, refitted for many seeds of the non-detect imputation."""
    filled = impute_missing(replicate(df, runs), value, ids, seed=F.col("seed"), high=high)
    filled = filled.withColumn("log10_value", F.log10(value))
    return one_way(filled, "log10_value", factor, levels, ["seed"])
