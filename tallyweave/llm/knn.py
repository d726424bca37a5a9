"""Exact top-k inner-product search as a Voronoi join.

Pivots are data vectors chosen by a hash. Each vector belongs to the cell of its nearest pivot; the queries of a cell form
groups of at most ``group_limit``. For a query q in a group with pivot p and radius R (the largest distance of its queries
from p) and a vector x, Cauchy and Schwarz give

    p.x - R |x|  <=  q.x  <=  p.x + R |x|

The left side summarised over all data, its (k + 1) largest values by group, bounds from below the score of each query's
(k + 1)-th best vector: a vector whose right side is smaller can't be among them and isn't replicated to the group. The
remaining vectors travel as blocks of packed rows to their groups, which solve them by matrix products; the best of all
blocks are merged. One more than k is kept because a query finds itself.

Equal vectors are solved once: ties go to the smaller id, so of equal vectors only the k + 1 smallest ids can appear, and
equal queries share an answer. Scores are exact: products of integers are added in doubles only while all sums stay
below 2**53, else in 64-bit integers.

Defined results: null vectors, vectors with a null or non-finite component and null ids take no part, neither as queries
nor as data; rows that repeat (id and vector) count once; of different vectors with one id each can be found, none by a
query of that id; shorter vectors count as filled up with zeros; fewer candidates than k give fewer rows; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import stored

_EXACT = float(1 << 53)


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a 64-bit integer; null unless all components are finite numbers."""
    d = vector.cast("array<double>")
    infinite = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(infinite, F.lit(True)), F.transform(d, lambda x: F.floor(x * scale).cast("bigint")))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for r, v in enumerate(vectors):
        out[r, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T as 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _packed(x: np.ndarray) -> bytes:
    """Rows in the narrowest integers that hold them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _unpacked(xs: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.dtype(f"i{len(xs) // max(1, rows * width) or 8}")
    return np.frombuffer(xs, kind).reshape(rows, width).astype(np.int64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each row and its distance from that pivot."""
    p, d = pivots.astype(np.float64), x.astype(np.float64)
    square = (p**2).sum(axis=1)[None] - 2 * d @ p.T
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((d - p[cell]) ** 2).sum(axis=1))


def _choose_pivots(data: DataFrame, count: int, width: int) -> np.ndarray:
    rows = data.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(count).collect()
    return _matrix([r["v"] for r in rows], width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; may return more if the last score ties."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= limit)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 64, group_limit: int = 64, block: int = 4096
) -> DataFrame:
    """(id, v) data and queries, v an integer array -> query_id, rank, id, score of each query's k best, itself left out."""
    spark, want = data.sparkSession, k + 1
    valid = lambda df: df.filter("id is not null and v is not null").select("id", "v").distinct()
    # of equal vectors the smallest ids; the partial limit of the window keeps a hot vector from gathering
    order = Window.partitionBy("v").orderBy("id")
    data = stored(valid(data).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= want).drop("n"), "knn-data")
    asked = stored(valid(queries).withColumn("qv", F.xxhash64("v")), "knn-queries")
    width = data.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    width = max(width, asked.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0)
    heads = data.groupBy("v").agg(F.min("id").alias("head"))
    pivot = spark.sparkContext.broadcast(_choose_pivots(heads, pivots, width))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"], width)
            cell, far = _nearest(x, pivot.value) if len(pivot.value) else (np.zeros(len(x), np.int64), np.zeros(len(x)))
            yield pd.DataFrame({"cell": cell, "far": far, "qv": b["qv"], "v": b["v"]})

    # queries nearest to each other by distance from the pivot share a group, so that its radius is small
    placed = asked.select("qv", "v").distinct().mapInPandas(cells, "cell bigint, far double, qv bigint, v array<bigint>")
    placed = placed.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("cell").orderBy("far", "qv", "v")) - 1) / group_limit))
    placed = stored(placed, "knn-groups")
    radii = placed.groupBy("cell", "part").agg(F.max("far").alias("radius"))
    groups = placed.join(radii, ["cell", "part"]).select(F.xxhash64("cell", "part").alias("grp"), "cell", "radius", "qv", "v")
    grouped = groups.groupBy("grp", "cell", "radius").agg(F.collect_list(F.struct("qv", "v")).alias("qs"))  # group_limit at most
    grouped = stored(grouped, "knn-query-blocks")
    by_cell = radii.groupBy("cell").agg(F.max("radius").alias("radius")).collect()  # one number for each pivot
    radius = np.full(max(1, len(pivot.value)), -1.0)
    for r in by_cell:
        radius[r["cell"]] = r["radius"] * (1 + 1e-9) + 1e-6
    radius_of = spark.sparkContext.broadcast(radius)

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = np.zeros((len(radius_of.value), 0))
        for b in batches:
            x = _matrix(b["v"], width)
            low = _products(pivot.value, x).astype(np.float64) - radius_of.value[:, None] * _norms(x)
            top = np.sort(np.hstack([top, low]), axis=1)[:, -want:]
        cell = np.repeat(np.arange(top.shape[0]), top.shape[1])
        yield pd.DataFrame({"cell": cell, "low": top.ravel()})

    if not len(pivot.value) or not by_cell:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    lows = data.select("v").mapInPandas(lower, "cell bigint, low double")
    nth = lows.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low")))).filter(F.col("n") == want)
    limit = np.full(len(radius), -np.inf)
    for r in nth.collect():  # one number for each pivot
        limit[r["cell"]] = r["low"] - 1e-6 * (1 + abs(r["low"]))
    limit_of = spark.sparkContext.broadcast(limit)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, x = b["id"].to_numpy(np.int64), _matrix(b["v"], width)
            high = _products(pivot.value, x).astype(np.float64) + radius_of.value[:, None] * _norms(x)
            out = []
            for cell in np.flatnonzero(radius_of.value >= 0):
                need = np.flatnonzero(high[cell] >= limit_of.value[cell])
                out += [(int(cell), ids[at].tobytes(), _packed(x[at])) for at in np.array_split(need, -(-len(need) // block)) if len(at)] if len(need) else []
            yield pd.DataFrame(out, columns=["cell", "ids", "xs"])

    blocks = data.select("id", "v").mapInPandas(replicate, "cell bigint, ids binary, xs binary")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for qs, ids, xs in zip(b["qs"], b["ids"], b["xs"]):
                ids = np.frombuffer(ids, np.int64)
                x = _unpacked(xs, len(ids), width)
                q = _matrix([r["v"] for r in qs], width)
                for r, s in zip(qs, _products(q, x)):
                    at = _best(s, ids, want)
                    found.append(pd.DataFrame({"qv": np.full(len(at), r["qv"]), "q": [r["v"]] * len(at), "id": ids[at], "score": s[at]}))
            if found:
                yield pd.concat(found)

    joined = blocks.join(grouped, "cell").select("qs", "ids", "xs")
    scored = joined.mapInPandas(solve, "qv bigint, q array<bigint>, id bigint, score bigint")
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("qv", "q").orderBy(F.desc("score"), "id")))
    best = stored(best.filter(F.col("n") <= want).drop("n"), "knn-best")
    answers = asked.withColumnsRenamed({"id": "query_id"}).join(best, (asked.qv == best.qv) & (F.col("v") == best.q))
    answers = answers.filter("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
