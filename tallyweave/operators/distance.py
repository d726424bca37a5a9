"""Bray-Curtis dissimilarity between samples.

The result of an all-pairs distance has one row per pair, but the work behind it does not need one row per pair and
shared feature, nor a copy of a row for each other block. Samples are hashed into blocks, the counts of a block are packed
into one row of arrays, and packed blocks meet by a plain product, which writes nothing to disk. A tile adds up its shared counts in
small matrices and is reduced at once where only means or minima are asked for. Blocks hold a bounded number of rows; a
sample that alone has more is cut into feature slices, whose sums are merged.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.rarefaction import rarefy, rarefy_cells
from tallyweave.session import spread, stored

_ROWS_PER_BLOCK = 2_000_000
_SAMPLES_PER_BLOCK = 2048
_BLOCKS = 8  # a table of a few blocks is cut finer, so that its tiles occupy some cores
_PARTS = 64
_PAIRS = 1 << 21  # pairs handled or returned at once


class Block:
    """Samples of one block: names in order, and for each run their sizes, the most reads of a sample, features, their samples and counts."""

    def __init__(self, names: list[str], runs: dict[int, tuple[np.ndarray, ...]]):
        self.names, self.runs = names, runs
        self.labels: dict = {}

    @staticmethod
    def pack(rows: pa.Table) -> bytes:
        named = rows["sample_id"].combine_chunks().dictionary_encode()
        if isinstance(named, pa.ChunkedArray):
            named = named.combine_chunks()
        names = np.array(named.dictionary.to_pylist(), dtype=object)
        order = np.argsort(names)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        who = place[named.indices.to_numpy(zero_copy_only=False)]
        run, code, count, size = (rows[c].to_numpy() for c in ("_run", "_code", "count", "_size"))
        sizes = {int(r): np.zeros(len(names), np.int64) for r in np.unique(run)}
        for r, total in sizes.items():
            np.add.at(total, who[run == r], size[run == r])
        kept = np.flatnonzero(count > 0)
        kept = kept[np.lexsort((who[kept], code[kept], run[kept]))]
        run, code, who, count = run[kept], code[kept], who[kept], count[kept]
        if len(kept):
            new = np.append(True, (np.diff(run) != 0) | (np.diff(code) != 0) | (np.diff(who) != 0))
            first = np.flatnonzero(new)
            run, code, who, count = run[first], code[first], who[first], np.add.reduceat(count, first)
        runs = {}
        for r, total in sizes.items():
            lo, hi = np.searchsorted(run, [r, r + 1])
            codes, starts = np.unique(code[lo:hi], return_index=True)
            top = int(count[lo:hi].max(initial=0))
            own = np.zeros(len(names), np.int64)
            np.add.at(own, who[lo:hi], count[lo:hi])
            runs[r] = (
                total,
                int(own.max(initial=0)),
                codes,
                np.append(starts, hi - lo).astype(np.int32),
                who[lo:hi].astype(np.min_scalar_type(max(len(names), 1))),
                count[lo:hi].astype(np.min_scalar_type(top)),
            )
        return pickle.dumps((names[order].tolist(), runs), protocol=5)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        return cls(*pickle.loads(data))

    def shared(self, other: Block, run: int) -> np.ndarray:
        """Summed minimum counts of each own sample (rows) with each sample of the other block (columns)."""
        na, nb = len(self.names), len(other.names)
        _, most_a, codes_a, start_a, who_a, n_a = self.runs[run]
        _, most_b, codes_b, start_b, who_b, n_b = other.runs[run]
        _, ia, ib = np.intersect1d(codes_a, codes_b, assume_unique=True, return_indices=True)
        da, db = (np.diff(s)[i].astype(np.int64) for s, i in ((start_a, ia), (start_b, ib)))
        limit = min(most_a, most_b)
        kind = np.int16 if limit < 2**15 else np.int32 if limit < 2**31 else np.int64
        total = np.zeros((na, nb), kind)
        wide = da * db * 8 >= na * nb
        left, right = (np.zeros((int(wide.sum()), n), kind) for n in (na, nb))
        for k, (i, j) in enumerate(zip(ia[wide], ib[wide])):
            # a count above the limit meets no larger one
            at, to = slice(start_a[i], start_a[i + 1]), slice(start_b[j], start_b[j + 1])
            left[k, who_a[at]] = np.minimum(n_a[at].astype(np.int64), limit)
            right[k, who_b[to]] = np.minimum(n_b[to].astype(np.int64), limit)
        step = max(1, (1 << 16) // max(nb, 1))
        for lo in range(0, na, step) if len(left) else ():
            part = total[lo : lo + step]
            room = np.empty_like(part)
            for a, b in zip(left[:, lo : lo + step], right):
                np.minimum(a[:, None], b, out=room)
                part += room
        ia, ib, da, db = ia[~wide], ib[~wide], da[~wide], db[~wide]
        if len(ia):
            ends = np.cumsum(da * db)
            cuts = np.unique(np.searchsorted(ends, np.arange(_PAIRS, ends[-1] + _PAIRS, _PAIRS), side="left") + 1)
            flat = np.zeros(na * nb)
            for f in np.split(np.arange(len(ia)), cuts[cuts < len(ia)]):
                pairs = da[f] * db[f]
                at = np.repeat(f, pairs)
                pos = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                a, b = start_a[ia[at]] + pos // db[at], start_b[ib[at]] + pos % db[at]
                least = np.minimum(n_a[a], n_b[b])
                np.add.at(flat, who_a[a].astype(np.int64) * nb + who_b[b], least.astype(float))
            total = total.astype(np.int64) + flat.reshape(na, nb).astype(np.int64)
        return total

    def both(self, other: Block, run: int) -> np.ndarray:
        return self.runs[run][0][:, None] + other.runs[run][0][None, :]


def _layout(abund: DataFrame, keys: Sequence[str], block: int, runs: int = 1) -> tuple[int, int]:
    """Number of sample blocks and of feature slices, from one small aggregate over the counts.

    ``block`` samples at least are together, more of them in large tables. ``runs`` tells how often a block holds its samples.
    """
    per_sample = abund.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("rows"), F.max("n").alias("top"))
    row = per_key.agg(F.max("samples"), F.max("rows"), F.max("top")).first()
    samples, rows, top = (int(v or 0) for v in row)
    blocks = max(min(_BLOCKS, math.ceil(samples / block)), math.ceil(samples / _SAMPLES_PER_BLOCK), math.ceil(rows * runs / _ROWS_PER_BLOCK))
    return max(1, min(blocks, samples)), max(1, math.ceil(top * runs / _ROWS_PER_BLOCK))


def _code_seed(abund: DataFrame) -> int:
    """A seed for which no two features have the same 64-bit hash."""
    features = abund.select("feature_id").distinct()
    for seed in range(100):
        code = F.xxhash64("feature_id", F.lit(seed)).alias("code")
        if features.groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return seed
    raise RuntimeError("no hash tells all features apart")


def _packed(abund: DataFrame, keys: Sequence[str], blocks: int, slices: int, seed: int, run: Column | None = None) -> DataFrame:
    """``(keys, _block, _slice, data)``, one row for the samples of a block; sizes belong to slice 0.

    Rows without a feature only add to the size of their sample.
    """
    kinds = {f.name: f.dataType.simpleString() for f in abund.schema}
    known = F.col("feature_id").isNotNull()
    count = F.col("count").cast("bigint")
    sample = F.coalesce(F.col("sample_id").cast("string"), F.lit("None")).alias("sample_id")
    run = (F.lit(0) if run is None else run).cast("int").alias("_run")
    block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("_block")
    rows = abund.select(
        *keys,
        block,
        F.pmod(F.xxhash64("feature_id"), F.lit(slices)).cast("int").alias("_slice"),
        sample,
        run,
        F.when(known, F.xxhash64("feature_id", F.lit(seed))).otherwise(0).alias("_code"),
        F.when(known, count).otherwise(0).alias("count"),
        (count if slices == 1 else F.lit(0).cast("bigint")).alias("_size"),
    )
    if slices > 1:
        sizes = abund.groupBy(*keys, "sample_id", run).agg(F.sum(count).alias("_size"))
        zero = F.lit(0).cast("bigint")
        rows = rows.unionByName(sizes.select(*keys, block, F.lit(0).alias("_slice"), sample, "_run", zero.alias("_code"), zero.alias("count"), "_size"))
    by = [*keys, "_block", "_slice"]

    def pack(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        types = [rows.schema.field(c).type for c in by]
        values = [pa.array([g.as_py()], t) for g, t in zip(group, types)]
        return pa.table([*values, pa.array([Block.pack(rows)], pa.binary())], names=[*by, "data"])

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "_block int, _slice int, data binary"
    return stored(spread(rows, *by).groupBy(*by).applyInArrow(pack, schema), "blocks")


Tile = Callable[[Block, Block, bool], Iterator[dict[str, pa.Array]]]


def _met(left: DataFrame, right: DataFrame | None, blocks: tuple[int, int], keys: Sequence[str], tile: Tile, schema: str) -> DataFrame:
    """Every block with every other and itself, or with those of ``right``; ``tile`` makes rows of two blocks.

    A column ``labels`` of pickled data goes with its block. Keys and slices are compared by order, not by equality: a join by equality would bring all blocks of a key into one task.
    """
    same = right is None
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    sides = []
    for df, n, s in ((left, blocks[0], "a"), (left if same else right, blocks[1], "b")):
        df = df.repartitionByRange(min(n, _PARTS), "_block")
        sides.append(df.select(*(keys if s == "a" else ()), key.alias(f"_key{s}"), F.col("_block").alias(f"_block{s}"), F.col("_slice").alias(f"_slice{s}"), F.col("data").alias(f"data{s}"), (F.col("labels") if "labels" in df.columns else F.lit(None).cast("binary")).alias(f"labels{s}")))
    a, b = sides
    on = (F.col("_slicea") <= F.col("_sliceb")) & (F.col("_slicea") >= F.col("_sliceb"))
    on &= (F.col("_keya") <= F.col("_keyb")) & (F.col("_keya") >= F.col("_keyb"))
    if same:
        ahead = F.pmod(F.col("_blockb") - F.col("_blocka"), F.lit(blocks[0])) * 2
        on &= (ahead < blocks[0]) | ((ahead == blocks[0]) & (F.col("_blocka") < F.col("_blockb")))
    pairs = a.join(b, on).select(*keys, (F.lit(same) & (F.col("_blocka") == F.col("_blockb"))).alias("_own"), "dataa", "datab", "labelsa", "labelsb")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch["_own"][i].as_py()
                first = Block.unpack(batch["dataa"][i].as_py())
                second = first if own else Block.unpack(batch["datab"][i].as_py())
                for side, labels in ((first, "labelsa"), (second, "labelsb")):
                    data = batch[labels][i].as_py()
                    side.labels = pickle.loads(data) if data else {}
                for cols in tile(first, second, own):
                    n = len(next(iter(cols.values())))
                    fixed = {k: pa.repeat(batch[k][i], n) for k in keys}
                    yield pa.RecordBatch.from_pydict(fixed | cols)

    return pairs.mapInArrow(each, schema)


def _rows_of_pairs(a: Block, b: Block, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Pieces of a tile: rows and columns of its pairs, and their samples, the smaller name first."""
    names = np.array(a.names + ([] if own else b.names), dtype=object)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names)] = np.arange(len(names))
    texts = pa.array(names[np.argsort(rank)].tolist(), pa.string())
    ra, rb = rank[: len(a.names)], rank if own else rank[len(a.names) :]
    step = max(1, _PAIRS // 8 // max(len(rb), 1))
    for lo in range(0, len(ra), step):
        i, j = (m.ravel() for m in np.meshgrid(np.arange(lo, min(lo + step, len(ra))), np.arange(len(rb)), indexing="ij"))
        if own:
            i, j = i[i < j], j[i < j]
        if len(i):
            x, y = ra[i], rb[j]
            yield i, j, {"sample_a": texts.take(pa.array(np.minimum(x, y))), "sample_b": texts.take(pa.array(np.maximum(x, y)))}


def _shared_tile(a: Block, b: Block, own: bool) -> Iterator[dict[str, pa.Array]]:
    total, both = a.shared(b, 0), a.both(b, 0)
    for i, j, cols in _rows_of_pairs(a, b, own):
        yield cols | {"shared": pa.array(total[i, j].astype(np.int64)), "both": pa.array(both[i, j])}


def _mean_tile(a: Block, b: Block, own: bool) -> Iterator[dict[str, pa.Array]]:
    """Mean distance over the runs that have both samples."""
    sums = np.zeros((len(a.names), len(b.names)))
    runs = np.zeros(sums.shape, np.int32)
    for r in sorted(a.runs.keys() & b.runs.keys()):
        met = (a.runs[r][0] > 0)[:, None] & (b.runs[r][0] > 0)[None, :]
        both = a.both(b, r)
        d = 1 - 2 * a.shared(b, r).astype(np.int64) / np.maximum(both, 1)
        sums += np.where(met, d, 0.0)
        runs += met
    for i, j, cols in _rows_of_pairs(a, b, own):
        n = runs[i, j]
        row = np.flatnonzero(n)
        if len(row):
            at = pa.array(row)
            yield {c: v.take(at) for c, v in cols.items()} | {"d": pa.array(sums[i, j][row] / n[row])}


def _nearest_tile(a: Block, b: Block, own: bool) -> Iterator[dict[str, pa.Array]]:
    """Pairs whose distance can't be told from the least of their first sample at twelve digits."""
    d = 1 - 2 * a.shared(b, 0).astype(np.int64) / a.both(b, 0)
    i, j = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2e-12)
    for lo in range(0, len(i), _PAIRS):
        x, y = i[lo : lo + _PAIRS], j[lo : lo + _PAIRS]
        names = [pa.array(s.names, pa.string()).take(pa.array(at)) for s, at in ((a, x), (b, y))]
        yield {"sample_a": names[0], "sample_b": names[1], "d": pa.array(d[x, y])}


def _merge_slices(tiled: DataFrame, slices: int, keys: Sequence[str]) -> DataFrame:
    if slices == 1:
        return tiled
    return tiled.groupBy(*keys, "sample_a", "sample_b").agg(F.sum("shared").alias("shared"), F.sum("both").alias("both"))


def _dissimilarity(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.select(*keys, "sample_a", "sample_b", (1 - 2 * F.col("shared") / F.col("both")).alias("d"))


_PAIR = "sample_a string, sample_b string, "


def _stored_counts(abund: DataFrame, *more: str) -> DataFrame:
    """The counts, computed once for the passes that size, tell apart and pack them."""
    return stored(abund.select(*more, "sample_id", "feature_id", "count"), "counts")


def shared_counts(
    abund: DataFrame, keys: Sequence[str] = (), block: int = 128, layout: tuple[int, int] | None = None
) -> DataFrame:
    """Summed minimum counts (``shared``) and summed library sizes (``both``) of all pairs with sample_a < sample_b.

    ``layout`` (blocks, slices) saves the sizing pass when the caller knows it already.
    """
    keys = list(keys)
    abund = _stored_counts(abund.filter(F.col("count") > 0), *keys)
    kinds = {f.name: f.dataType.simpleString() for f in abund.schema}
    blocks, slices = layout or _layout(abund, keys, block)
    packed = _packed(abund, keys, blocks, slices, _code_seed(abund))
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + _PAIR + "shared bigint, both bigint"
    return _merge_slices(_met(packed, None, (blocks, blocks), keys, _shared_tile, schema), slices, keys)


def bray_curtis(
    abund: DataFrame, keys: Sequence[str] = (), block: int = 128, layout: tuple[int, int] | None = None
) -> DataFrame:
    """``(sample_a, sample_b, d)`` for all pairs with sample_a < sample_b, within each key."""
    return _dissimilarity(shared_counts(abund, keys, block, layout), list(keys))


def _between(abund: DataFrame, left: DataFrame, right: DataFrame, block: int, tile: Tile | None) -> DataFrame:
    """Distances between two lists of samples, those that ``tile`` picks; all of them if samples are cut into slices."""
    abund = _stored_counts(abund.filter(F.col("count") > 0))
    sides = [abund.join(ids.select("sample_id").distinct(), "sample_id", "left_semi") for ids in (left, right)]
    (nx, sx), (ny, sy) = (_layout(s, [], block) for s in sides)
    slices, seed = max(sx, sy), _code_seed(abund)
    a, b = (_packed(s, [], n, slices, seed) for s, n in zip(sides, (nx, ny)))
    if tile and slices == 1:
        return _met(a, b, (nx, ny), [], tile, _PAIR + "d double")
    return _dissimilarity(_merge_slices(_met(a, b, (nx, ny), [], _shared_between, _PAIR + "shared bigint, both bigint"), slices, []), [])


def _shared_between(a: Block, b: Block, own: bool) -> Iterator[dict[str, pa.Array]]:
    total, both = a.shared(b, 0), a.both(b, 0)
    first, second = (pa.array(s.names, pa.string()) for s in (a, b))
    step = max(1, _PAIRS // 8 // max(len(b.names), 1))
    for lo in range(0, len(a.names), step):
        part = total[lo : lo + step]
        i, j = (m.ravel() for m in np.indices(part.shape))
        yield {
            "sample_a": first.take(pa.array(i + lo)),
            "sample_b": second.take(pa.array(j)),
            "shared": pa.array(part.ravel().astype(np.int64)),
            "both": pa.array(both[lo : lo + step].ravel()),
        }


def bray_curtis_between(abund: DataFrame, left: DataFrame, right: DataFrame, block: int = 128) -> DataFrame:
    """Distances of every ``left`` sample to every ``right`` sample; the two id lists must not overlap."""
    return _between(abund, left, right, block, None)


def _mean_distance(abund: DataFrame, thin: DataFrame, iterations: int, block: int) -> DataFrame:
    """Mean distance over the iterations in ``thin``, each with some of the counts of the stored table ``abund``."""
    blocks, slices = _layout(abund, [], block, iterations)
    if slices > 1:
        each = bray_curtis(thin, ["iteration"], block)
        return each.groupBy("sample_a", "sample_b").agg(F.avg("d").alias("d"))
    packed = _packed(thin.filter(F.col("count") > 0), [], blocks, 1, _code_seed(abund), F.col("iteration"))
    return _met(packed, None, (blocks, blocks), [], _mean_tile, _PAIR + "d double")


def average_rarefied_distance(
    abund: DataFrame, depth: int | None = None, iterations: int = 100, seed: int | str = 1, block: int = 128
) -> DataFrame:
    """Mean Bray-Curtis distance over repeated rarefaction without replacement."""
    abund = _stored_counts(abund)
    runs = abund.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    thin = rarefy(runs, depth, F.concat_ws("/", F.lit(str(seed)), F.col("iteration").cast("string")), keys=["iteration"])
    return _mean_distance(abund, thin, iterations, block)


def average_rarefied_distance_by_cells(
    abund: DataFrame, depth: int | None = None, iterations: int = 100, seed: int | str = 1, block: int = 128
) -> DataFrame:
    """Mean Bray-Curtis distance over repeated rarefaction, drawn cell by cell."""
    abund = _stored_counts(abund)
    return _mean_distance(abund, rarefy_cells(abund, depth, seed, iterations), iterations, block)


def nearest_control(abund: DataFrame, controls: DataFrame) -> DataFrame:
    """For every other sample its closest control and the distance to it; ties go to the smaller id."""
    others = abund.select("sample_id").distinct().join(controls, "sample_id", "left_anti")
    d = _between(abund, others, controls, 128, _nearest_tile)
    best = F.min(F.struct(F.round("d", 12).alias("d"), F.col("sample_b").alias("control")))
    return d.groupBy(F.col("sample_a").alias("sample_id")).agg(best.alias("b")).select("sample_id", "b.control", "b.d")
