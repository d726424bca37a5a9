"""Differential abundance with negative-binomial models, and clusters of time profiles.

Count fits need every sample of a feature, zeros included. Features are hashed into blocks and every block meets one
copy of the design, so a task holds a small dense matrix (features of the block x samples) and fits all its features at
once. Zeros never exist as rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import direction, parse_coefficient
from tallyweave.functions.distributions import chi2_pvalue, normal_pvalue
from tallyweave.functions.ranking import benjamini_hochberg, global_index, quantiles
from tallyweave.session import checkpointed, spread

_CELLS_PER_BLOCK = 1_000_000
_LOG2_HALF = -1.0


def size_factors(abund: DataFrame, kind: str) -> DataFrame:
    """Median ratio to the geometric mean of each feature.

    ``ratio`` uses features present in every sample and raises when there is none; ``poscounts`` uses positive counts,
    with the log sum divided by all samples, and centres the factors.
    """
    if kind not in ("ratio", "poscounts"):
        raise ValueError(f"unknown kind of size factors: {kind}")
    abund = abund.filter(F.col("count") > 0)
    n = abund.agg(F.count_distinct("sample_id").alias("n")).scalar()
    logs = abund.groupBy("feature_id").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.ln("count")).alias("log_sum"))
    logs = logs.withColumn("n", n)
    if kind == "ratio":
        logs = logs.filter(F.col("seen") == F.col("n"))
        if logs.isEmpty():
            raise ValueError("no feature occurs in every sample; use poscounts")
    logs = logs.select("feature_id", (F.col("log_sum") / F.col("n")).alias("log_mean"))
    ratios = abund.join(logs, "feature_id").select("sample_id", (F.ln("count") - F.col("log_mean")).alias("ratio"))
    middle = quantiles(ratios, ["sample_id"], "ratio", [0.5], ["log_factor"])
    if kind == "poscounts":
        center = middle.agg(F.avg("log_factor").alias("c")).scalar()
        middle = middle.withColumn("log_factor", F.col("log_factor") - center)
    return middle.select("sample_id", F.exp("log_factor").alias("size_factor"))


def stabilised(abund: DataFrame, factors: DataFrame) -> DataFrame:
    """log2(count / size factor + 0.5). Absent cells would be -1 and are not stored."""
    joined = abund.filter(F.col("count") > 0).join(factors, "sample_id")
    return joined.select("sample_id", "feature_id", F.log2(F.col("count") / F.col("size_factor") + 0.5).alias("value"))


# -- designs: sample_id, x (array of numbers) and the coefficient names ------------------------------------------------


def factor_design(meta: DataFrame, factor: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    known = meta.filter(F.col(factor).isin(list(levels)))
    x = [F.lit(1.0)] + [(F.col(factor) == v).cast("double") for v in levels[1:]]
    names = ["Intercept"] + [f"{factor}_{v}_vs_{levels[0]}" for v in levels[1:]]
    return known.select("sample_id", F.array(*x).alias("x")), names


def covariate_design(meta: DataFrame, covariate: str) -> tuple[DataFrame, list[str]]:
    known = meta.filter(F.col(covariate).isNotNull())
    return known.select("sample_id", F.array(F.lit(1.0), F.col(covariate).cast("double")).alias("x")), ["Intercept", covariate]


def interaction_design(meta: DataFrame, factor: str, levels: Sequence[str], time: str) -> tuple[DataFrame, list[str], int]:
    """Group, time as a slope, and group by time. The third value is the width of the model without interactions."""
    known = meta.filter(F.col(factor).isin(list(levels)) & F.col(time).isNotNull())
    t = F.col(time).cast("double")
    flags = [(F.col(factor) == v).cast("double") for v in levels[1:]]
    names = ["Intercept", *[f"{factor}_{v}_vs_{levels[0]}" for v in levels[1:]], time, *[f"{factor}{v}.{time}" for v in levels[1:]]]
    x = [F.lit(1.0), *flags, t, *[f * t for f in flags]]
    return known.select("sample_id", F.array(*x).alias("x")), names, len(levels) + 1


# -- dense block work ----------------------------------------------------------------------------------------------


def _dense(cells: pd.DataFrame, design: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, row = np.unique(cells["feature_id"].to_numpy(dtype=str), return_inverse=True)
    design = design.sort_values("sample_id")
    place = pd.Series(np.arange(len(design)), index=design["sample_id"].to_numpy())
    counts = np.zeros((len(names), len(design)))
    counts[row, place.loc[cells["sample_id"]].to_numpy()] = cells["count"].to_numpy(dtype=float)
    return names, counts, np.stack(design["x"].to_numpy()).astype(float), design["size_factor"].to_numpy(dtype=float)


def _moments(_key, cells: pd.DataFrame, design: pd.DataFrame) -> pd.DataFrame:
    if not len(cells):
        return pd.DataFrame()
    names, k, x, s = _dense(cells, design)
    q = k / s
    fitted = q @ np.linalg.pinv(x).T @ x.T
    free = max(len(s) - x.shape[1], 1)
    var = ((q - fitted) ** 2).sum(axis=1) / free
    mean = q.mean(axis=1)
    alpha = (var - mean * (1.0 / s).mean()) / np.maximum(mean, 1e-12) ** 2
    return pd.DataFrame({"feature_id": names, "base_mean": mean, "moment": np.maximum(alpha, 1e-4)})


def _weighted_fit(k: np.ndarray, x: np.ndarray, s: np.ndarray, alpha: np.ndarray, steps: int = 60):
    """Iterated weighted least squares for all rows of ``k``; a tiny ridge keeps empty groups finite.

    The last value says for each row whether its coefficients had come to rest.
    """
    p = x.shape[1]
    ridge = 1e-6 * np.eye(p)
    beta = np.zeros((len(k), p))
    beta[:, 0] = np.log(np.maximum((k / s).mean(axis=1), 1e-6))
    a = alpha[:, None]
    settled = np.zeros(len(k), bool)
    for _ in range(steps):
        eta = np.clip(beta @ x.T, -30, 30)
        mu = np.maximum(s * np.exp(eta), 1e-8)
        w = mu / (1.0 + a * mu)
        z = eta + (k - mu) / mu
        info = np.einsum("fs,si,sj->fij", w, x, x) + ridge
        new = np.linalg.solve(info, np.einsum("fs,si->fi", w * z, x)[..., None])[..., 0]
        step = np.clip(new - beta, -3, 3)
        beta = beta + step
        settled = np.abs(step).max(axis=1) < 1e-8
        if np.abs(step).max() < 1e-9:
            break
    mu = np.maximum(s * np.exp(np.clip(beta @ x.T, -30, 30)), 1e-8)
    w = mu / (1.0 + a * mu)
    info = np.einsum("fs,si,sj->fij", w, x, x) + ridge
    se = np.sqrt(np.einsum("fii->fi", np.linalg.inv(info)))
    loglik = (k * np.log(mu) - (k + 1.0 / a) * np.log1p(a * mu)).sum(axis=1)
    return beta, se, loglik, settled


def _wald(names: Sequence[str]):
    def block(_key, cells: pd.DataFrame, design: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame()
        features, k, x, s = _dense(cells, design)
        alpha = cells.groupby("feature_id")["dispersion"].first().loc[features].to_numpy()
        beta, se, _, settled = _weighted_fit(k, x, s, alpha)
        parts = [
            pd.DataFrame({"feature_id": features, "coefficient": name, "log2fc": beta[:, j] / math.log(2), "lfc_se": se[:, j] / math.log(2), "converged": settled})
            for j, name in enumerate(names)
            if j > 0
        ]
        return pd.concat(parts)

    return block


def _ratio_test(reduced: int):
    def block(_key, cells: pd.DataFrame, design: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame()
        features, k, x, s = _dense(cells, design)
        alpha = cells.groupby("feature_id")["dispersion"].first().loc[features].to_numpy()
        full_beta, _, full, settled = _weighted_fit(k, x, s, alpha)
        _, _, small, rested = _weighted_fit(k, x[:, :reduced], s, alpha)
        statistic = np.maximum(2 * (full - small), 0.0)
        return pd.DataFrame({"feature_id": features, "statistic": statistic, "log2fc": full_beta[:, -1] / math.log(2), "converged": settled & rested})

    return block


def _blocks(cells: DataFrame, design: DataFrame) -> int:
    features = cells.agg(F.count_distinct("feature_id").alias("n")).first()[0]
    samples = max(design.count(), 1)
    per_block = max(_CELLS_PER_BLOCK // samples, 1)
    parallel = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(features / per_block), min(parallel, max(features, 1)))


def _per_block(cells: DataFrame, design: DataFrame, blocks: int, fn, schema: str) -> DataFrame:
    left = cells.withColumn("block", F.pmod(F.xxhash64("feature_id"), F.lit(blocks)))
    right = design.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return spread(left, "block").groupBy("block").cogroup(spread(right, "b").groupBy("b")).applyInPandas(fn, schema)


def dispersions(cells: DataFrame, design: DataFrame, blocks: int, width: int) -> DataFrame:
    """Moment estimates drawn towards a trend ``a0 + a1 / mean`` over all features."""
    raw = checkpointed(_per_block(cells, design, blocks, _moments, "feature_id string, base_mean double, moment double"))
    inv = F.lit(1.0) / F.col("base_mean")
    fit = raw.filter(F.col("base_mean") > 0).agg(
        F.covar_samp(inv, "moment").alias("c"), F.var_samp(inv).alias("v"), F.avg(inv).alias("mi"), F.avg("moment").alias("m")
    ).first()
    a1 = max((fit["c"] or 0.0) / fit["v"], 0.0) if fit["v"] else 0.0
    a0 = max((fit["m"] or 0.1) - a1 * (fit["mi"] or 0.0), 1e-3)
    free = max(design.count() - width, 1)
    weight = free / (free + 10.0)
    trend = F.lit(a0) + F.lit(a1) * inv
    mixed = F.exp(F.lit(weight) * F.ln("moment") + F.lit(1 - weight) * F.ln(trend))
    return raw.select("feature_id", "base_mean", mixed.alias("dispersion"))


def _prepared(abund: DataFrame, design: DataFrame, factors: DataFrame | None, width: int):
    cells = abund.filter(F.col("count") > 0).join(design.select("sample_id"), "sample_id", "left_semi")
    cells = checkpointed(cells.select("sample_id", "feature_id", "count"))
    design = checkpointed(design.join(factors if factors is not None else size_factors(cells, "poscounts"), "sample_id"))
    blocks = _blocks(cells, design)
    return cells, design, blocks, dispersions(cells, design, blocks, width)


def wald_tests(abund: DataFrame, design: DataFrame, names: Sequence[str], factors: DataFrame | None = None) -> DataFrame:
    """One row per feature and non-intercept coefficient, adjusted within each coefficient.

    ``converged`` is false where a fit had not come to rest; its numbers are those of the last step.
    """
    cells, design, blocks, disp = _prepared(abund, design, factors, len(names))
    fits = _per_block(
        cells.join(disp.select("feature_id", "dispersion"), "feature_id"),
        design,
        blocks,
        _wald(names),
        "feature_id string, coefficient string, log2fc double, lfc_se double, converged boolean",
    )
    out = fits.join(disp, "feature_id").withColumn("statistic", F.try_divide(F.col("log2fc"), F.col("lfc_se")))
    out = checkpointed(out.withColumn("p_value", normal_pvalue("statistic")))
    return benjamini_hochberg(out, "p_value", ["coefficient"], "padj")


def likelihood_ratio_tests(
    abund: DataFrame, design: DataFrame, names: Sequence[str], reduced: int, factors: DataFrame | None = None
) -> DataFrame:
    """Full design against its first ``reduced`` columns."""
    cells, design, blocks, disp = _prepared(abund, design, factors, len(names))
    fits = _per_block(
        cells.join(disp.select("feature_id", "dispersion"), "feature_id"),
        design,
        blocks,
        _ratio_test(reduced),
        "feature_id string, statistic double, log2fc double, converged boolean",
    )
    out = fits.join(disp, "feature_id").withColumn("p_value", chi2_pvalue("statistic", F.lit(float(len(names) - reduced))))
    return benjamini_hochberg(checkpointed(out), "p_value", out="padj")


def shrink(results: DataFrame, upper: float = 0.95) -> DataFrame:
    """Fold changes drawn to zero by a normal prior whose width matches the ``upper`` quantile of the observed sizes."""
    if not 0 < upper < 1:
        raise ValueError("upper is a quantile between 0 and 1")
    sized = results.withColumn("_size", F.abs("log2fc"))
    width = quantiles(sized, ["coefficient"], "_size", [upper], ["_q"])
    tau2 = F.pow(F.col("_q") / F.lit(NormalDist().inv_cdf((1 + upper) / 2)), F.lit(2))
    joined = results.join(width, "coefficient")
    share = tau2 / (tau2 + F.col("lfc_se") * F.col("lfc_se"))
    return joined.withColumn("log2fc_shrunk", F.col("log2fc") * share).drop("_q")


def annotate(results: DataFrame, tax: DataFrame, alpha: float | None = 0.05, min_lfc: float = 0.5, lfc: str = "log2fc") -> DataFrame:
    """Taxonomy and direction for each result. With ``alpha=None`` nothing is filtered."""
    from tallyweave.functions.columns import parse_coefficient

    out = results
    if alpha is not None:
        out = out.filter((F.col("padj") < alpha) & (F.abs(F.col(lfc)) > min_lfc))
    parts = parse_coefficient("coefficient")
    out = out.withColumn("enriched_in", direction(lfc, parts["level"], parts["reference"]))
    return out.join(tax, "feature_id", "left")


# -- time profiles -------------------------------------------------------------------------------------------------


def design_cells(meta: DataFrame, group: str, time: str) -> DataFrame:
    """``(group, time, cell, samples)``: the (group, time) cells of a design, numbered from 0 in order."""
    sizes = meta.groupBy(F.col(group).alias("group"), F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("samples"))
    numbered = global_index(sizes, [F.col("group"), F.col("time")], "cell")
    return numbered.withColumn("cell", (F.col("cell") - 1).cast("int"))


def profiles(values: DataFrame, meta: DataFrame, group: str, time: str, cells: DataFrame) -> DataFrame:
    """Per feature the z-scored mean stabilised value of each design cell, absent counts included.

    Means are summed in long form, by (feature, cell). A cell in which a feature never occurs has the value of an absent
    count, so it needs no row; the array of a feature is as long as the design has cells.
    """
    cells = checkpointed(cells)
    samples = meta.select("sample_id", F.col(group).alias("group"), F.col(time).alias("time")).join(cells, ["group", "time"])
    joined = values.join(samples.select("sample_id", "cell", "samples"), "sample_id")
    seen = joined.groupBy("feature_id", "cell", "samples").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("present"))
    mean = (F.col("total") + (F.col("samples") - F.col("present")) * F.lit(_LOG2_HALF)) / F.col("samples")
    seen = seen.select("feature_id", F.struct("cell", mean.alias("m")).alias("at"))
    count = cells.count()
    raw = seen.groupBy("feature_id").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    empty = F.lit(count) - F.size("ats")
    add = lambda f: F.aggregate("ats", F.lit(0.0), lambda a, x: a + f(x["m"]))
    raw = raw.withColumn("_mean", (add(lambda m: m) + empty * F.lit(_LOG2_HALF)) / F.lit(float(max(count, 1))))
    square = lambda m: (m - F.col("_mean")) * (m - F.col("_mean"))
    raw = raw.withColumn("_sd", F.sqrt(F.try_divide(add(square) + empty * square(F.lit(_LOG2_HALF)), F.lit(float(count - 1)))))
    raw = raw.filter(F.col("_sd") > 0)
    z = lambda m: (m - F.col("_mean")) / F.col("_sd")
    gap = lambda n: F.array_repeat(z(F.lit(_LOG2_HALF)), n.cast("int"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("ats", i - 1)["cell"])
    parts = F.transform("ats", lambda x, i: F.concat(gap(x["cell"] - before(i) - 1), F.array(z(x["m"]))))
    tail = gap(F.lit(count - 1) - F.element_at("ats", -1)["cell"])
    return raw.select("feature_id", F.concat(F.flatten(parts), tail).alias("profile"))


def pattern_clusters(profile: DataFrame, k: int = 6, min_size: int = 5, seed: int = 1) -> DataFrame:
    """Features of similar profile; clusters with fewer than ``min_size`` features are dropped."""
    vectors = checkpointed(profile).withColumn("features", array_to_vector("profile"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    found = checkpointed(model.transform(vectors).select("feature_id", "profile", "cluster"))
    large = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return found.join(large, "cluster")


def cluster_summary(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean profile of each cluster, one row per design cell."""
    points = clusters.select("cluster", "size", F.posexplode("profile").alias("cell", "z"))
    points = points.groupBy("cluster", "size", "cell").agg(F.avg("z").alias("z"))
    return points.join(cells, "cell").select("cluster", "size", "group", "time", "z")
