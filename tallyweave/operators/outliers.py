"""Counts that decide a fit alone, their replacement, and filters on the mean count.

A cell's influence is how far a fit moves without it, in units of its own uncertainty: the squared residual over the variance, times
h / (1 - h)^2, over the number of coefficients. h is the cell's diagonal entry of the hat matrix, from the information matrices that
``chunkmodels`` adds up over chunks of samples. The variance takes a dispersion from the moments of all other samples, which are the
feature's sums less the cell's own part, so an outlier can't hide behind the spread that it causes itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.distributions import f_quantile
from tallyweave.functions.ranking import benjamini_hochberg, counted_values, quantiles, running_counts
from tallyweave.operators import chunkmodels
from tallyweave.operators.chunkmodels import Tiles
from tallyweave.operators.diffabund import size_factors
from tallyweave.session import checkpointed, stored

_LEAST_DISPERSION = 0.04


def influential(tiles: Tiles, disp: DataFrame, width: int, cutoff: float, rounds: int = 60) -> DataFrame:
    """``sample_id, feature_id, influence`` of the cells above ``cutoff``, zeros included. A sample that alone fixes a coefficient has none."""
    n = tiles.samples

    def moments(k: np.ndarray, x: np.ndarray, s: np.ndarray, row) -> np.ndarray:
        q = k / s
        rest = np.tile(np.append((x.T @ x).ravel(), (1.0 / s).sum()), (len(k), 1))
        return np.hstack([q.sum(axis=1)[:, None], (q * q).sum(axis=1)[:, None], q @ x, rest])

    summed = tiles.sums(tiles.blocks.select("block"), width, moments).withColumnRenamed("v", "m")
    fit = chunkmodels._steps(tiles, disp, width, rounds)
    known = tiles.tiles.join(fit.drop("rest").join(summed, "block"), "block")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                k = np.zeros((row.n, len(row.s)))
                if row.f is not None:
                    k[np.asarray(row.f), np.asarray(row.i)] = row.k
                x, s = np.asarray(row.x, float).reshape(len(row.s), -1)[:, :width], np.asarray(row.s, float)
                beta, a = np.frombuffer(row.beta).reshape(row.n, width), np.frombuffer(row.alpha)[:, None]
                info = np.frombuffer(row.v).reshape(row.n, -1)[:, width:-1].reshape(-1, width, width) + chunkmodels._RIDGE * np.eye(width)
                m = np.frombuffer(row.m).reshape(row.n, -1)
                mu = np.maximum(s * np.exp(np.clip(beta @ x.T, -30, 30)), 1e-8)
                hat = mu / (1 + a * mu) * np.einsum("si,fij,sj->fs", x, np.linalg.inv(info), x)
                # what remains of a feature's moments without the cell
                q, inner = k / s, np.linalg.pinv(m[0, 2 + width : -1].reshape(width, width))
                coef = m[:, 2 : 2 + width] @ inner
                lever = np.einsum("si,ij,sj->s", x, inner, x)
                squares = m[:, 1] - (coef * m[:, 2 : 2 + width]).sum(axis=1)
                with np.errstate(all="ignore"):
                    others = squares[:, None] - np.where(lever < 1 - 1e-9, (q - coef @ x.T) ** 2 / (1 - lever), 0.0)
                    mean = (m[:, :1] - q) / (n - 1)
                    alone = (np.maximum(others, 0.0) / (n - 1 - width) - mean * (m[0, -1] - 1 / s) / (n - 1)) / mean**2
                    alone = np.maximum(np.nan_to_num(alone, nan=0.0, posinf=0.0, neginf=0.0), _LEAST_DISPERSION)
                    size = (k - mu) ** 2 / (mu + alone * mu**2) * hat / (1 - hat) ** 2 / width
                f, i = np.nonzero((size > cutoff) & (hat < 1 - 1e-6))
                yield pd.DataFrame({"chunk": row.chunk, "i": i, "feature_id": np.asarray(row.features, object)[f], "influence": size[f, i]})

    cells = known.mapInPandas(each, "chunk int, i int, feature_id string, influence double")
    return stored(cells.join(tiles.places, ["chunk", "i"]).select("sample_id", "feature_id", "influence"), "influence")


def trimmed_means(abund: DataFrame, factors: DataFrame, samples: int, trim: float = 0.2) -> DataFrame:
    """``feature_id, trimmed``: mean of the normalised counts of all ``samples``, absent ones included, without ``trim`` of them at each end."""
    cut = int(samples * trim)
    q = abund.filter(F.col("count") > 0).join(factors, "sample_id").select("feature_id", (F.col("count") / F.col("size_factor")).alias("q"))
    ranked = running_counts(counted_values(q, ["feature_id"], "q"), ["feature_id"], "q")
    zeros = F.lit(samples) - F.col("total")
    share = F.least(F.col("upto") + zeros, F.lit(samples - cut)) - F.greatest(F.col("before") + zeros, F.lit(cut))
    return ranked.groupBy("feature_id").agg((F.sum(F.col("q") * F.greatest(share, F.lit(0))) / F.lit(float(samples - 2 * cut))).alias("trimmed"))


def replaced(abund: DataFrame, cells: DataFrame, factors: DataFrame, samples: int, trim: float = 0.2) -> DataFrame:
    """``abund`` with ``cells(sample_id, feature_id)`` set to what the feature's trimmed mean makes of the sample's size; absent cells too."""
    own = ["sample_id", "feature_id"]
    means = trimmed_means(abund.join(cells.select("feature_id").distinct(), "feature_id", "left_semi"), factors, samples, trim)
    new = cells.select(*own).distinct().join(means, "feature_id").join(factors, "sample_id")
    new = new.select(*own, F.floor(F.col("trimmed") * F.col("size_factor")).cast("bigint").alias("count")).filter(F.col("count") > 0)
    return abund.select(*own, F.col("count").cast("bigint").alias("count")).join(cells.select(*own), own, "left_anti").unionByName(new)


def wald_without_outliers(
    abund: DataFrame, design: DataFrame, names: Sequence[str], factors: DataFrame | None = None, replicates: int = 7, quantile: float = 0.99,
    block: int = 1000, chunk: int = 1000, rounds: int = 60,
) -> DataFrame:
    """``chunkmodels.wald_tests`` after influential counts are replaced; ``replaced`` and ``unclear`` count a feature's such cells.

    Influential are cells above the ``quantile`` of an F variable. A cell is replaced if at least ``replicates`` samples share its row of
    the design; one with three or more such samples makes its feature's p-values null, because it can't be told which of them is wrong; the rest stay.
    """
    abund = checkpointed(abund.filter(F.col("count") > 0).join(design.select("sample_id"), "sample_id", "left_semi").select("sample_id", "feature_id", "count"))
    factors = checkpointed(size_factors(abund, "poscounts") if factors is None else factors)
    tiles, width = Tiles(abund, design, factors, block, chunk), len(names)
    fit = {"factors": factors, "block": block, "chunk": chunk, "rounds": rounds}
    if tiles.samples - width < 2:
        none = F.lit(0).cast("bigint")
        return chunkmodels.wald_tests(abund, design, names, **fit).withColumns({"replaced": none, "unclear": none})
    cutoff = f_quantile(quantile, width, tiles.samples - width)
    sizes = design.groupBy("x").agg(F.count(F.lit(1)).alias("alike"))
    alike = design.join(sizes, "x").select("sample_id", "alike")
    found = influential(tiles, chunkmodels.dispersions(tiles, width), width, cutoff, rounds).join(alike, "sample_id")
    told = found.groupBy("feature_id").agg(
        F.count_if(F.col("alike") >= replicates).alias("replaced"), F.count_if((F.col("alike") >= 3) & (F.col("alike") < replicates)).alias("unclear")
    )
    counts = stored(replaced(abund, found.filter(F.col("alike") >= replicates), factors, tiles.samples), "replaced")
    out = chunkmodels.wald_tests(counts, design, names, **fit).drop("padj").join(told, "feature_id", "left").fillna(0, ["replaced", "unclear"])
    out = out.withColumn("p_value", F.when(F.col("unclear") == 0, F.col("p_value")))
    return benjamini_hochberg(checkpointed(out), "p_value", ["coefficient"], "padj")


def filter_limits(results: DataFrame, families: Sequence[str] = ("coefficient",), alpha: float = 0.1, steps: int = 50, top: float = 0.95) -> DataFrame:
    """``families, limit, hits``: the mean count below which features are left out, so that most of the others have an adjusted p of at most ``alpha``.

    Limits tried are ``steps`` quantiles of the mean count, from the least to ``top``; the lowest of the best counts. Only p-values up to
    ``alpha`` are laid out by limit; the others enter as numbers of tests.
    """
    tested = results.filter(F.col("p_value").isNotNull()).select(F.struct(*families).alias("_f"), "base_mean", "p_value")
    names = [f"_q{i}" for i in range(steps)]
    limits = quantiles(tested, ["_f"], "base_mean", [top * i / max(steps - 1, 1) for i in range(steps)], names)
    limits = limits.select("_f", F.array(*names).alias("limits"))
    placed = tested.join(limits, "_f").withColumn("last", F.size(F.filter("limits", lambda t: t <= F.col("base_mean"))) - 1)
    upward = Window.partitionBy("_f").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.groupBy("_f", F.col("last").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    grid = limits.select("_f", F.posexplode("limits").alias("step", "limit"))
    tests = grid.join(own, ["_f", "step"], "left").select("_f", "step", "limit", F.sum(F.coalesce("n", F.lit(0))).over(upward).alias("tests"))
    low = placed.filter(F.col("p_value") <= alpha).select("_f", "p_value", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step"))
    ranked = running_counts(counted_values(low, ["_f", "step"], "p_value"), ["_f", "step"], "p_value").join(tests.select("_f", "step", "tests"), ["_f", "step"])
    hits = ranked.filter(F.col("p_value") * F.col("tests") / F.col("upto") <= alpha).groupBy("_f", "step").agg(F.max("upto").alias("hits"))
    tried = tests.join(hits, ["_f", "step"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("bigint"))
    best = tried.groupBy("_f").agg(F.max_by(F.struct("limit", "hits"), F.struct("hits", -F.col("step"))).alias("b"))
    return best.select(*[F.col("_f")[f].alias(f) for f in families], F.col("b")["limit"].alias("limit"), F.col("b")["hits"].alias("hits"))


def independent_filter(results: DataFrame, families: Sequence[str] = ("coefficient",), alpha: float = 0.1, steps: int = 50, top: float = 0.95) -> DataFrame:
    """``results`` with ``limit`` and ``padj`` over the features at or above it; the others' ``padj`` is null."""
    results = checkpointed(results.drop("padj"))
    limits = filter_limits(results, families, alpha, steps, top).drop("hits")
    same = [results[f].eqNullSafe(limits[f]) for f in families]
    out = results.join(limits, same, "left").drop(*[limits[f] for f in families])
    out = out.withColumn("_p", F.when(F.col("base_mean") >= F.col("limit"), F.col("p_value")))
    return benjamini_hochberg(checkpointed(out), "_p", families, "padj").drop("_p")
