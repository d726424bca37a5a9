"""Negative-binomial models of features fitted from sums over chunks of samples.

Features are hashed into blocks and samples into chunks; a tile holds the counts of one block in one chunk and the chunk's part of
the design. A Newton step adds up, over the tiles of a block, each feature's gradient and information matrix, which are as wide as
the design has columns, and solves for the step. So what a task reads depends on the sizes of a block and a chunk, never on the number of samples.
Sums of tiles are added in a tree of ``_FAN`` at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.distributions import chi2_pvalue, normal_pvalue
from tallyweave.functions.ranking import benjamini_hochberg
from tallyweave.operators.diffabund import size_factors
from tallyweave.session import checkpointed, spread, stored

_FAN = 32
_RIDGE = 1e-6


class Tiles:
    """Counts and design cut into (block of features, chunk of samples); ``blocks`` has each block's features in order, ``places`` each chunk's samples."""

    def __init__(self, abund: DataFrame, design: DataFrame, factors: DataFrame | None, block: int, chunk: int):
        cells = checkpointed(abund.filter(F.col("count") > 0).join(design.select("sample_id"), "sample_id", "left_semi").select("sample_id", "feature_id", "count"))
        factors = size_factors(cells, "poscounts") if factors is None else factors
        design = checkpointed(design.join(factors, "sample_id"))
        self.samples = design.count()
        known = cells.select("feature_id").distinct()
        number = max(1, -(-known.count() // block))
        self.chunks = max(1, -(-self.samples // chunk))
        hashed = known.select("feature_id", F.pmod(F.xxhash64("feature_id"), F.lit(number)).cast("int").alias("block"))
        self.blocks = checkpointed(hashed.groupBy("block").agg(F.array_sort(F.collect_list("feature_id")).alias("features")))
        in_chunk = F.array_sort(F.collect_list(F.struct("sample_id", "x", "size_factor")))
        parts = design.withColumn("chunk", F.pmod(F.xxhash64("sample_id"), F.lit(self.chunks)).cast("int")).groupBy("chunk").agg(in_chunk.alias("r"))
        parts = checkpointed(parts)
        f = self.blocks.select("block", F.posexplode("features").alias("f", "feature_id"))
        i = self.places = parts.select("chunk", F.posexplode(F.transform("r", lambda r: r["sample_id"])).alias("i", "sample_id"))
        placed = cells.join(f, "feature_id").join(i, "sample_id").groupBy("block", "chunk")
        placed = placed.agg(F.collect_list("f").alias("f"), F.collect_list("i").alias("i"), F.collect_list(F.col("count").cast("double")).alias("k"))
        grid = self.blocks.select("block", F.size("features").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1))).alias("chunk"))
        side = parts.select("chunk", F.flatten(F.transform("r", lambda r: r["x"])).alias("x"), F.transform("r", lambda r: r["size_factor"]).alias("s"))
        # a chunk's design goes to every block; chunks without samples have no row
        self.tiles = checkpointed(spread(grid.join(side, "chunk").join(placed, ["block", "chunk"], "left"), "block", "chunk"))

    def sums(self, state: DataFrame, width: int, fn) -> DataFrame:
        """``block, v``: ``fn(k, x, s, row)`` of each tile, an array with a row for each feature, added over the chunks of a block."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples(index=False):
                    k = np.zeros((row.n, len(row.s)))
                    if row.f is not None:
                        k[np.asarray(row.f), np.asarray(row.i)] = row.k
                    x, s = np.asarray(row.x, float).reshape(len(row.s), -1)[:, :width], np.asarray(row.s, float)
                    yield pd.DataFrame({"block": [row.block], "chunk": [row.chunk], "v": [fn(k, x, s, row).astype(float).tobytes()]})

        def added(p: pd.DataFrame) -> pd.DataFrame:
            # in order of chunks, so that rounding doesn't depend on how rows arrive
            parts = [np.frombuffer(v) for v in p.sort_values("chunk")["v"]]
            return pd.DataFrame({"block": p["block"].iloc[:1], "chunk": p["chunk"].iloc[:1] // _FAN, "v": [np.sum(parts, axis=0).tobytes()]})

        out = self.tiles.join(state, "block").mapInPandas(each, "block int, chunk int, v binary")
        left = self.chunks
        while left > 1:
            out = out.groupBy("block", F.floor(F.col("chunk") / _FAN).alias("_c")).applyInPandas(added, "block int, chunk int, v binary")
            left = -(-left // _FAN)
        return out.select("block", "v")


def _one_row(fn):
    """Map rows of a block table one by one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield fn(row)

    return each


def dispersions(tiles: Tiles, width: int) -> DataFrame:
    """``feature_id, base_mean, dispersion``: moment estimates drawn towards a trend ``a0 + a1 / mean`` over all features."""
    n = tiles.samples

    def parts(k: np.ndarray, x: np.ndarray, s: np.ndarray, row) -> np.ndarray:
        q = k / s
        rest = np.tile(np.append((x.T @ x).ravel(), (1.0 / s).sum()), (len(k), 1))
        return np.hstack([q.sum(axis=1)[:, None], (q * q).sum(axis=1)[:, None], q @ x, rest])

    def moments(row) -> pd.DataFrame:
        v = np.frombuffer(row.v).reshape(len(row.features), -1)
        mean, squares, by = v[:, 0] / n, v[:, 1], v[:, 2 : 2 + width]
        inner = v[0, 2 + width : -1].reshape(width, width)
        left = squares - np.einsum("fi,ij,fj->f", by, np.linalg.pinv(inner), by)
        var = np.maximum(left, 0.0) / max(n - width, 1)
        alpha = (var - mean * v[:, -1] / n) / np.maximum(mean, 1e-12) ** 2
        return pd.DataFrame({"feature_id": row.features, "base_mean": mean, "moment": np.maximum(alpha, 1e-4)})

    summed = tiles.sums(tiles.blocks.select("block"), width, parts).join(tiles.blocks, "block")
    raw = checkpointed(summed.select("features", "v").mapInPandas(_one_row(moments), "feature_id string, base_mean double, moment double"))
    inv = F.lit(1.0) / F.col("base_mean")
    fit = raw.agg(F.covar_samp(inv, "moment").alias("c"), F.var_samp(inv).alias("v"), F.avg(inv).alias("mi"), F.avg("moment").alias("m")).first()
    a1 = max((fit["c"] or 0.0) / fit["v"], 0.0) if fit["v"] else 0.0
    a0 = max((fit["m"] or 0.1) - a1 * (fit["mi"] or 0.0), 1e-3)
    free = max(n - width, 1)
    weight = free / (free + 10.0)
    mixed = F.exp(F.lit(weight) * F.ln("moment") + F.lit(1 - weight) * F.ln(F.lit(a0) + F.lit(a1) * inv))
    return checkpointed(raw.select("feature_id", "base_mean", mixed.alias("dispersion")))


def _steps(tiles: Tiles, disp: DataFrame, width: int, rounds: int) -> DataFrame:
    """``block, features, beta, alpha, rest, v``: coefficients at rest, and the sums of the last step (gradient, information, log likelihood)."""
    f = tiles.blocks.select("block", F.posexplode("features").alias("f", "feature_id"))
    own = f.join(disp, "feature_id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("f", "dispersion", "base_mean"))).alias("r"))
    own = own.select("block", F.transform("r", lambda r: r["dispersion"]).alias("alpha"), F.transform("r", lambda r: r["base_mean"]).alias("mean"))

    def begin(row) -> pd.DataFrame:
        beta = np.zeros((len(row.alpha), width))
        beta[:, 0] = np.log(np.maximum(np.asarray(row.mean, float), 1e-6))
        rest = np.zeros(len(beta), bool)
        return pd.DataFrame({"block": [row.block], "beta": [beta.tobytes()], "alpha": [np.asarray(row.alpha, float).tobytes()], "rest": [rest.tobytes()]})

    kind = "block int, beta binary, alpha binary, rest binary"
    state = stored(own.mapInPandas(_one_row(begin), kind), "newton")

    def parts(k: np.ndarray, x: np.ndarray, s: np.ndarray, row) -> np.ndarray:
        beta, a = np.frombuffer(row.beta).reshape(len(k), width), np.frombuffer(row.alpha)[:, None]
        mu = np.maximum(s * np.exp(np.clip(beta @ x.T, -30, 30)), 1e-8)
        w = mu / (1.0 + a * mu)
        info = np.einsum("fs,si,sj->fij", w, x, x).reshape(len(k), -1)
        loglik = (k * np.log(mu) - (k + 1.0 / a) * np.log1p(a * mu)).sum(axis=1)
        return np.hstack([((k - mu) / (1.0 + a * mu)) @ x, info, loglik[:, None]])

    def step(row) -> pd.DataFrame:
        beta = np.frombuffer(row.beta).reshape(-1, width)
        v = np.frombuffer(row.v).reshape(len(beta), -1)
        info = v[:, width:-1].reshape(-1, width, width) + _RIDGE * np.eye(width)
        move = np.clip(np.linalg.solve(info, (v[:, :width] - _RIDGE * beta)[..., None])[..., 0], -3, 3)
        rest = np.abs(move).max(axis=1) < 1e-8
        return pd.DataFrame({"block": [row.block], "beta": [(beta + move).tobytes()], "alpha": [row.alpha], "rest": [rest.tobytes()], "left": [int((~rest).sum())]})

    for _ in range(rounds):
        met = tiles.sums(state, width, parts).join(state, "block")
        moved = stored(met.mapInPandas(_one_row(step), f"{kind}, left int"), "newton")
        state = moved.drop("left")
        if not (moved.agg(F.sum("left")).first()[0] or 0):
            break
    return tiles.sums(state, width, parts).join(state, "block").join(tiles.blocks, "block")


def wald_tests(
    abund: DataFrame, design: DataFrame, names: Sequence[str], factors: DataFrame | None = None, block: int = 1000, chunk: int = 1000, rounds: int = 60
) -> DataFrame:
    """One row per feature and non-intercept coefficient of ``design(sample_id, x)``, adjusted within each coefficient.

    ``converged`` is false where a fit had not come to rest; its numbers are those of the last step.
    """
    width = len(names)
    tiles = Tiles(abund, design, factors, block, chunk)
    disp = dispersions(tiles, width)

    def told(row) -> pd.DataFrame:
        beta = np.frombuffer(row.beta).reshape(-1, width)
        info = np.frombuffer(row.v).reshape(len(beta), -1)[:, width:-1].reshape(-1, width, width) + _RIDGE * np.eye(width)
        se = np.sqrt(np.einsum("fii->fi", np.linalg.inv(info)))
        rest = np.frombuffer(row.rest, bool)
        parts = [pd.DataFrame({"feature_id": row.features, "coefficient": c, "log2fc": beta[:, j] / math.log(2), "lfc_se": se[:, j] / math.log(2), "converged": rest}) for j, c in enumerate(names) if j]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["feature_id", "coefficient", "log2fc", "lfc_se", "converged"])

    fits = _steps(tiles, disp, width, rounds).mapInPandas(_one_row(told), "feature_id string, coefficient string, log2fc double, lfc_se double, converged boolean")
    out = fits.join(disp, "feature_id").withColumn("statistic", F.try_divide(F.col("log2fc"), F.col("lfc_se")))
    return benjamini_hochberg(checkpointed(out.withColumn("p_value", normal_pvalue("statistic"))), "p_value", ["coefficient"], "padj")


def likelihood_ratio_tests(
    abund: DataFrame, design: DataFrame, names: Sequence[str], reduced: int, factors: DataFrame | None = None, block: int = 1000, chunk: int = 1000, rounds: int = 60
) -> DataFrame:
    """Full design against its first ``reduced`` columns."""
    width = len(names)
    tiles = Tiles(abund, design, factors, block, chunk)
    disp = dispersions(tiles, width)

    def told(w: int):
        def one(row) -> pd.DataFrame:
            beta = np.frombuffer(row.beta).reshape(-1, w)
            loglik = np.frombuffer(row.v).reshape(len(beta), -1)[:, -1]
            return pd.DataFrame({"feature_id": row.features, "loglik": loglik, "log2fc": beta[:, -1] / math.log(2), "rest": np.frombuffer(row.rest, bool)})

        return one

    kind = "feature_id string, loglik double, log2fc double, rest boolean"
    full = _steps(tiles, disp, width, rounds).mapInPandas(_one_row(told(width)), kind)
    small = _steps(tiles, disp, reduced, rounds).mapInPandas(_one_row(told(reduced)), kind).select("feature_id", F.col("loglik").alias("_l"), F.col("rest").alias("_r"))
    out = full.join(small, "feature_id").select(
        "feature_id", F.greatest(2 * (F.col("loglik") - F.col("_l")), F.lit(0.0)).alias("statistic"), "log2fc", (F.col("rest") & F.col("_r")).alias("converged")
    )
    out = out.join(disp, "feature_id").withColumn("p_value", chi2_pvalue("statistic", F.lit(float(width - reduced))))
    return benjamini_hochberg(checkpointed(out), "p_value", out="padj")


# -- heavy-tailed shrinkage ----------------------------------------------------------------------------------------


def prior_scale(results: DataFrame) -> DataFrame:
    """``coefficient, scale``: the scale of a Cauchy prior from all features.

    The middle half of a Cauchy variable lies within its scale, so the scale is the median size of the fold changes, after the
    median squared standard error (times the squared quartile of a normal variable, which noise alone would show) is taken off its square.
    """
    sized = results.filter(F.col("lfc_se") > 0).groupBy("coefficient")
    sized = sized.agg(F.percentile(F.abs("log2fc"), 0.5).alias("size"), F.percentile(F.col("lfc_se") * F.col("lfc_se"), 0.5).alias("noise"))
    return sized.select("coefficient", F.sqrt(F.greatest(F.col("size") * F.col("size") - F.lit(0.6744897501960817**2) * F.col("noise"), F.lit(1e-6))).alias("scale"))


def posterior(lfc: np.ndarray, se: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mode and standard deviation (from the curvature there) under a normal likelihood and a Cauchy prior around zero.

    The mode solves (b - lfc) / se^2 + 2 b / (scale^2 + b^2) = 0, a cubic; of its real roots the one with the largest posterior counts.
    """
    mode, sd = np.full(len(lfc), np.nan), np.full(len(lfc), np.nan)
    for i, (m, e, g) in enumerate(zip(lfc, se, scale)):
        if not (np.isfinite(m) and np.isfinite(e) and e > 0):
            continue
        roots = np.roots([1.0, -m, g * g + 2 * e * e, -m * g * g])
        real = roots.real[np.abs(roots.imag) <= 1e-7 * (1 + np.abs(roots.real))]
        b = min(real, key=lambda r: 0.5 * ((r - m) / e) ** 2 + math.log1p((r / g) ** 2))
        bend = 1 / (e * e) + 2 * (g * g - b * b) / (g * g + b * b) ** 2
        mode[i], sd[i] = b, 1 / math.sqrt(bend) if bend > 0 else e
    return mode, sd


def shrink_heavy_tailed(results: DataFrame) -> DataFrame:
    """``results`` with ``log2fc_shrunk`` and ``lfc_sd``: small fold changes are drawn to zero, large ones keep their size."""
    joined = results.join(prior_scale(results), "coefficient")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["log2fc_shrunk"], b["lfc_sd"] = posterior(*(b[c].to_numpy(float) for c in ("log2fc", "lfc_se", "scale")))
            yield b

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    return joined.mapInPandas(each, f"{kinds}, log2fc_shrunk double, lfc_sd double").drop("scale")
