"""Regularised logarithms: one coefficient for each sample, drawn to the feature's own level by a prior that all features share.

Under ``count ~ NB(size factor * exp(level + b), dispersion)`` with a normal prior on each sample's ``b``, a level fixes all b of its
feature, each by an equation of its own. So a Newton step moves only the level, with sums of two numbers over the chunks of samples
(``chunkmodels.Tiles``); the b are solved inside their tiles and never stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.chunkmodels import Tiles, _one_row, dispersions
from tallyweave.session import stored

_STEPS_PER_OCTAVE = 64


def _cells(row) -> tuple[np.ndarray, np.ndarray]:
    k = np.zeros((row.n, len(row.s)))
    if row.f is not None:
        k[np.asarray(row.f), np.asarray(row.i)] = row.k
    return k, np.asarray(row.s, float)


def deviations(k: np.ndarray, s: np.ndarray, level: np.ndarray, a: np.ndarray, weight: float) -> np.ndarray:
    """The b with ``(k - mu) / (1 + a mu) = weight * b`` and ``mu = s exp(level + b)``: Newton steps kept inside a bracket."""
    start = s * np.exp(level)
    slope = (k - start) / (1 + a * start)
    # b lies between no change and what the slope at no change, or the observed count, allows
    edge = slope / weight
    with np.errstate(divide="ignore"):
        seen = np.where(k > 0, np.log(np.maximum(k, 1e-300) / start), -np.inf)
    edge = np.where(edge > 0, np.minimum(edge, np.maximum(seen, 0)), np.maximum(edge, np.minimum(seen, 0)))
    lo, hi, b = np.minimum(edge, 0.0), np.maximum(edge, 0.0), np.zeros_like(k)
    for _ in range(80):
        mu = start * np.exp(b)
        g = (k - mu) / (1 + a * mu) - weight * b
        lo, hi = np.where(g > 0, b, lo), np.where(g < 0, b, hi)
        to = b + g / (mu * (1 + a * k) / (1 + a * mu) ** 2 + weight)
        to = np.where((to >= lo) & (to <= hi), to, (lo + hi) / 2)
        move, b = np.abs(to - b).max(initial=0.0), to
        if move < 1e-13:
            break
    return b


def prior_variance(tiles: Tiles, disp: DataFrame, upper: float = 0.95) -> float:
    """Variance of a sample's log2 deviation, from all cells of all features, zeros included.

    The weighted ``upper`` quantile of the sizes of ``log2((normalised count + 0.5) / (mean + 0.5))`` is that of a normal variable; weights
    are ``1 / (1 / mean + dispersion)``. Sizes are counted in steps of about 1 %, inside the tiles first.
    """
    f = tiles.blocks.select("block", F.posexplode("features").alias("f", "feature_id")).join(disp, "feature_id")
    own = f.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("f", "base_mean", "dispersion"))).alias("r"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                k, s = _cells(row)
                mean, a = np.array([r["base_mean"] for r in row.r])[:, None], np.array([r["dispersion"] for r in row.r])[:, None]
                size = np.abs(np.log2((k / s + 0.5) / (mean + 0.5)))
                step = np.floor(np.log2(np.maximum(size, 1e-6)) * _STEPS_PER_OCTAVE).astype(int)
                at, where = np.unique(step, return_inverse=True)
                weight = np.broadcast_to(1 / (1 / mean + a), k.shape)
                yield pd.DataFrame({"step": at, "w": np.bincount(where.ravel(), weight.ravel(), len(at))})

    counted = tiles.tiles.join(own, "block").mapInPandas(each, "step int, w double").groupBy("step").agg(F.sum("w").alias("w"))
    # at most about 2,000 steps exist, whatever the input
    running = F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    reached = counted.select("step", running.alias("upto"), F.sum("w").over(Window.partitionBy(F.lit(0))).alias("total"))
    step = reached.filter(F.col("upto") >= upper * F.col("total")).agg(F.min("step")).first()[0]
    if step is None:
        raise ValueError("no counts to take a prior from")
    return (2 ** ((step + 0.5) / _STEPS_PER_OCTAVE) / NormalDist().inv_cdf((1 + upper) / 2)) ** 2


def regularised_log(
    abund: DataFrame, design: DataFrame, width: int, factors: DataFrame | None = None, variance: float | None = None,
    block: int = 1000, chunk: int = 1000, rounds: int = 60,
) -> DataFrame:
    """``sample_id, feature_id, value`` of every cell, zeros included; ``design(sample_id, x)`` serves the dispersions alone.

    ``variance`` is that of the prior of log2 deviations; without it, it comes from all features. Raises if a level has not come to rest
    after ``rounds`` steps. Features without a count have no rows.
    """
    tiles = Tiles(abund, design, factors, block, chunk)
    disp = dispersions(tiles, width)
    weight = 1.0 / ((prior_variance(tiles, disp) if variance is None else variance) * math.log(2) ** 2)
    f = tiles.blocks.select("block", F.posexplode("features").alias("f", "feature_id")).join(disp, "feature_id")
    own = f.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("f", "base_mean", "dispersion"))).alias("r"))

    def begin(row) -> pd.DataFrame:
        level, a = np.log([r["base_mean"] for r in row.r]), np.array([r["dispersion"] for r in row.r])
        return pd.DataFrame({"block": [row.block], "level": [level.tobytes()], "a": [a.tobytes()]})

    state = stored(own.mapInPandas(_one_row(begin), "block int, level binary, a binary"), "levels")

    def parts(k: np.ndarray, x: np.ndarray, s: np.ndarray, row) -> np.ndarray:
        level, a = np.frombuffer(row.level)[:, None], np.frombuffer(row.a)[:, None]
        mu = s * np.exp(level + deviations(k, s, level, a, weight))
        bend = mu * (1 + a * k) / (1 + a * mu) ** 2
        return np.stack([((k - mu) / (1 + a * mu)).sum(axis=1), (bend * weight / (bend + weight)).sum(axis=1)], axis=1)

    def step(row) -> pd.DataFrame:
        v = np.frombuffer(row.v).reshape(-1, 2)
        move = np.clip(v[:, 0] / np.maximum(v[:, 1], 1e-12), -3, 3)
        level = np.frombuffer(row.level) + move
        return pd.DataFrame({"block": [row.block], "level": [level.tobytes()], "a": [row.a], "left": [int((np.abs(move) > 1e-9).sum())]})

    for _ in range(rounds):
        met = tiles.sums(state, width, parts).join(state, "block")
        moved = stored(met.mapInPandas(_one_row(step), "block int, level binary, a binary, left int"), "levels")
        state = moved.drop("left")
        left = moved.agg(F.sum("left")).first()[0] or 0
        if not left:
            break
    else:
        raise ValueError(f"{left} features had not come to rest after {rounds} steps")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                k, s = _cells(row)
                level, a = np.frombuffer(row.level)[:, None], np.frombuffer(row.a)[:, None]
                value = (level + deviations(k, s, level, a, weight)) / math.log(2)
                names, i = np.repeat(np.asarray(row.features, object), len(s)), np.tile(np.arange(len(s)), row.n)
                yield pd.DataFrame({"chunk": row.chunk, "i": i, "feature_id": names, "value": value.ravel()})

    known = tiles.tiles.join(state.join(tiles.blocks, "block"), "block")
    cells = known.mapInPandas(told, "chunk int, i int, feature_id string, value double")
    return cells.join(tiles.places, ["chunk", "i"]).select("sample_id", "feature_id", "value")
