"""Alpha diversity per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shannon(abund: DataFrame, out: str = "shannon") -> DataFrame:
    """Natural-log entropy from one aggregate: ln N - sum(c ln c) / N."""
    x = F.col("count").cast("double")
    return (
        abund.filter(F.col("count") > 0)
        .groupBy("sample_id")
        .agg((F.ln(F.sum(x)) - F.sum(x * F.ln(x)) / F.sum(x)).alias(out))
    )


def _fisher_alpha(s, n, steps: int = 60):
    """Root of s = a ln(1 + n / a), as a fixed number of Newton steps in ln a; all singletons have no finite root."""

    def step(u, _):
        a = F.exp(u)
        value = a * F.log1p(n / a) - s
        slope = a * F.log1p(n / a) - a * n / (a + n)
        return u - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), value / slope))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.ln(s), step, lambda u: F.exp(u))
    return F.when(s < n, root)


def richness(abund: DataFrame) -> DataFrame:
    """Observed, Chao1, ACE (both with standard error), Shannon, Simpson, inverse Simpson and Fisher's alpha."""
    x = F.col("count").cast("double")
    rare = range(1, 11)
    sums = (
        abund.filter(F.col("count") > 0)
        .groupBy("sample_id")
        .agg(
            F.count(F.lit(1)).cast("double").alias("s"),
            F.sum(x).alias("n"),
            F.sum(x * F.ln(x)).alias("xlnx"),
            F.sum(x * x).alias("xx"),
            *[F.count_if(F.col("count") == i).cast("double").alias(f"a{i}") for i in rare],
        )
    )
    a = {i: F.col(f"a{i}") for i in rare}
    s, n, a1, a2 = F.col("s"), F.col("n"), F.col("a1"), F.col("a2")

    chao = s + a1 * (a1 - 1) / (2 * (a2 + 1))
    var_pairs = (
        a1 * (a1 - 1) / (2 * (a2 + 1))
        + a1 * F.pow(2 * a1 - 1, F.lit(2)) / (4 * F.pow(a2 + 1, F.lit(2)))
        + F.pow(a1, F.lit(2)) * a2 * F.pow(a1 - 1, F.lit(2)) / (4 * F.pow(a2 + 1, F.lit(4)))
    )
    var_none = a1 * (a1 - 1) / 2 + a1 * F.pow(2 * a1 - 1, F.lit(2)) / 4 - F.pow(a1, F.lit(4)) / (4 * chao)
    var_chao = F.when(a1 == 0, F.lit(0.0)).when(a2 > 0, var_pairs).otherwise(F.greatest(var_none, F.lit(0.0)))

    s_rare = sum((a[i] for i in rare), F.lit(0.0))
    n_rare = sum((a[i] * i for i in rare), F.lit(0.0))
    m_rare = sum((a[i] * (i * (i - 1)) for i in rare), F.lit(0.0))
    base = sums.withColumns({"sr": s_rare, "nr": n_rare, "mr": m_rare, "chao1": chao, "se_chao1": F.sqrt(var_chao)})
    sr, nr, mr = F.col("sr"), F.col("nr"), F.col("mr")
    cover = F.lit(1.0) - F.try_divide(a1, nr)
    base = base.withColumn("cv", F.when((nr > 0) & (a1 < nr), cover))
    c = F.col("cv")
    gamma = F.try_divide(sr * mr, c * nr * (nr - 1)) - 1
    base = base.withColumn("gam", F.greatest(F.coalesce(gamma, F.lit(0.0)), F.lit(0.0)))
    g = F.col("gam")
    base = base.withColumn("ace", F.when(c.isNotNull(), s - sr + sr / c + a1 / c * g))

    # delta method over the abundance classes 1..10: variance = sum(a_i d_i^2) - (sum a_i d_i)^2 / ACE
    slopes = {}
    for i in rare:
        d_cover = (F.lit(-1.0) / nr if i == 1 else F.lit(0.0)) + a1 * i / (nr * nr)
        d_gamma = F.when(
            g > 0,
            (g + 1) * (1 / sr + F.try_divide(F.lit(float(i * (i - 1))), mr) - d_cover / c - i * (2 * nr - 1) / (nr * (nr - 1))),
        ).otherwise(0.0)
        lead = g / c if i == 1 else F.lit(0.0)
        slopes[f"d{i}"] = 1 / c - sr * d_cover / (c * c) + lead - a1 * g * d_cover / (c * c) + a1 / c * d_gamma
    base = base.withColumns({k: F.when(c.isNotNull(), v) for k, v in slopes.items()})
    square = sum((a[i] * F.col(f"d{i}") * F.col(f"d{i}") for i in rare), F.lit(0.0))
    linear = sum((a[i] * F.col(f"d{i}") for i in rare), F.lit(0.0))
    var_ace = F.greatest(square - linear * linear / F.col("ace"), F.lit(0.0))

    return base.select(
        "sample_id",
        s.cast("bigint").alias("observed"),
        "chao1",
        "se_chao1",
        "ace",
        F.sqrt(var_ace).alias("se_ace"),
        (F.ln(n) - F.col("xlnx") / n).alias("shannon"),
        (1 - F.col("xx") / (n * n)).alias("simpson"),
        (n * n / F.col("xx")).alias("inv_simpson"),
        _fisher_alpha(s, n).alias("fisher"),
    )
