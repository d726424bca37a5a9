"""Permutation tests on distances between samples."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.draws import draw_key
from tallyweave.functions.ranking import bonferroni, global_index, pairs_of_groups
from tallyweave.operators import distance
from tallyweave.session import checkpointed, spread, stored


def _permuted_labels(members: DataFrame, sizes: DataFrame, permutations: int, seed, per_array: int) -> DataFrame:
    """``(comparison, sample_id, perm_block, codes)``; permutation 0 is the observed labelling.

    A permutation orders the samples of a comparison at random and deals out the labels in group order, so a label
    follows from the sample's rank and the running group sizes.
    """
    by = Window.partitionBy("comparison").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("end", F.sum("n_g").over(by)).groupBy("comparison").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    known = members.join(sizes.select("comparison", "grp", "code"), ["comparison", "grp"]).join(ends, "comparison")
    perms = spread(known, "comparison", "sample_id").withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    rank = F.row_number().over(Window.partitionBy("comparison", "perm").orderBy(draw_key(seed, "perm", "sample_id")))
    dealt = F.size(F.filter("ends", lambda e: e < F.col("rank"))) + 1
    labels = perms.withColumn("rank", rank).withColumn("code", F.when(F.col("perm") == 0, F.col("code")).otherwise(dealt))
    block = F.floor(F.col("perm") / F.lit(per_array)).cast("int")
    in_order = F.array_sort(F.collect_list(F.struct("perm", "code")))
    return labels.groupBy("comparison", "sample_id", block.alias("perm_block")).agg(
        F.transform(in_order, lambda s: s["code"]).alias("codes")
    )


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_ROUNDS = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers stirred so that each input bit reaches all output bits."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def walked_ranks(rank: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a seeded permutation of 0 to n - 1 sends each rank, computed for that rank alone.

    The permutation is a Feistel cipher of a power of four that holds n (64 at least); a value beyond n is enciphered again until
    it falls below. Elementwise over arrays; ``key`` names the permutation.
    """
    half = np.maximum(3, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = rank.astype(np.uint64), np.arange(len(rank))
    while len(todo):
        h, m, k, x = half[todo], mask[todo], key[todo], out[todo]
        left, right = x >> h, x & m
        for r in range(_ROUNDS):
            left, right = right, left ^ (_mixed(_mixed(k + np.uint64(r)) ^ right) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _walked_labels(members: DataFrame, sizes: DataFrame, permutations: int, seed, per_array: int) -> DataFrame:
    """The labels of ``_permuted_labels`` from permuted ranks that each sample computes by itself: nothing is ordered or gathered."""
    by = Window.partitionBy("comparison").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("end", F.sum("n_g").over(by)).groupBy("comparison").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    numbered = checkpointed(global_index(members, [F.col("comparison"), F.col("sample_id")]))
    first = numbered.groupBy("comparison").agg(F.min("idx").alias("first"))
    known = numbered.join(first, "comparison").join(sizes.select("comparison", "grp", "code"), ["comparison", "grp"]).join(ends, "comparison")
    known = known.select("comparison", "sample_id", "code", (F.col("idx") - F.col("first")).alias("rank"), "ends")
    blocks = F.sequence(F.lit(0), F.lit(permutations // per_array))
    rows = spread(known, "comparison", "sample_id").withColumn("perm_block", F.explode(blocks))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bases: dict[str, int] = {}
        for whole in batches:
            for a in range(0, len(whole), 200):
                b = whole.iloc[a : a + 200]
                first, last = b["perm_block"].to_numpy(np.int64) * per_array, (b["perm_block"].to_numpy(np.int64) + 1) * per_array
                size = np.minimum(last, permutations + 1) - first
                at = np.repeat(np.arange(len(b)), size)
                perm = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + first[at]
                for c in b["comparison"]:
                    if c not in bases:
                        bases[c] = int.from_bytes(hashlib.sha256(f"{seed}/{c}".encode()).digest()[:8], "little")
                base = np.array([bases[c] for c in b["comparison"]], np.uint64)
                ends = [np.asarray(e, np.int64) for e in b["ends"]]
                n = np.array([e[-1] for e in ends], np.int64)
                ranks = walked_ranks(b["rank"].to_numpy(np.int64)[at], n[at], _mixed(base[at] ^ _mixed(perm.astype(np.uint64))))
                codes = [np.searchsorted(e, r, side="right") + 1 for e, r in zip(ends, np.split(ranks, np.cumsum(size)[:-1]))]
                for k, (c, f) in enumerate(zip(b["code"], first)):
                    if f == 0:
                        codes[k][0] = c
                yield pd.DataFrame({"comparison": b["comparison"], "sample_id": b["sample_id"], "perm_block": b["perm_block"], "codes": [c.tolist() for c in codes]})

    return rows.mapInPandas(each, "comparison string, sample_id string, perm_block int, codes array<int>")


def _within_sums(per_array: int):
    """Per tile: squared distances inside each label, for every permutation of the block."""

    def tile(key: tuple, pairs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        comparison, perm_block = key[0], int(key[3])
        names = {s: i for i, s in enumerate(labels["sample_id"])}
        codes = np.stack(labels["codes"].to_numpy()) if len(labels) else np.zeros((0, 0), dtype=int)
        if not len(pairs):
            return pd.DataFrame()
        a, b = pairs["sample_a"].map(names).to_numpy(), pairs["sample_b"].map(names).to_numpy()
        rows, ra = np.unique(a, return_inverse=True)
        cols, cb = np.unique(b, return_inverse=True)
        d2 = np.zeros((len(rows), len(cols)))
        d2[ra, cb] = pairs["d2"].to_numpy()
        la, lb = codes[rows], codes[cols]
        out = []
        for code in np.unique(codes):
            ss = ((la == code) * (d2 @ (lb == code))).sum(axis=0)
            out.append(
                pd.DataFrame(
                    {
                        "comparison": comparison,
                        "perm": perm_block * per_array + np.arange(len(ss)),
                        "code": int(code),
                        "ss": ss,
                    }
                )
            )
        return pd.concat(out)

    return tile


def permanova(
    dist: DataFrame,
    members: DataFrame,
    permutations: int = 999,
    seed: int | str = 1,
    block: int = 256,
    per_array: int = 500,
    walk: bool = False,
) -> DataFrame:
    """One row per comparison: ``df, sums_of_sqs, f_model, r2, p_value``.

    With ``walk`` each sample computes its own place in every permutation, for comparisons and numbers of permutations of any size.

    ``dist(sample_a, sample_b, d)`` and ``members(comparison, sample_id, grp)``. Squared distances are tiled by sample
    block and meet blocks of permuted labels; the sums per (permutation, label) are added up over the tiles. Members
    without any distance take no part. ``dist`` is read twice, so it should be a stored table.
    """
    members = members.select(F.col("comparison").cast("string").alias("comparison"), "sample_id", F.col("grp").cast("string").alias("grp"))
    members = checkpointed(members.join(_measured(dist), "sample_id", "left_semi"))
    sizes = members.groupBy("comparison", "grp").agg(F.count(F.lit(1)).alias("n_g"))
    sizes = sizes.withColumn("code", F.row_number().over(Window.partitionBy("comparison").orderBy("grp")))
    overall = sizes.groupBy("comparison").agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("g"))
    largest = overall.agg(F.max("n")).first()[0] or 1
    blocks = max(1, math.ceil(largest / block))
    perm_blocks = permutations // per_array + 1

    def place(col: str) -> Column:
        return F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int")

    first = members.select("comparison", F.col("sample_id").alias("sample_a"))
    second = members.select("comparison", F.col("sample_id").alias("sample_b"))
    pairs = dist.join(first, "sample_a").join(second, ["comparison", "sample_b"])
    pairs = pairs.select("comparison", "sample_a", "sample_b", (F.col("d") * F.col("d")).alias("d2"))

    tiles = pairs.withColumns({"x": place("sample_a"), "y": place("sample_b")}).withColumn(
        "perm_block", F.explode(F.sequence(F.lit(0), F.lit(perm_blocks - 1)))
    )
    deal = _walked_labels if walk else _permuted_labels
    labels = deal(members, sizes, permutations, seed, per_array).withColumn("own", place("sample_id"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    spots = F.array_union(
        F.transform(every, lambda k: F.struct(F.col("own").alias("x"), k.alias("y"))),
        F.transform(every, lambda k: F.struct(k.alias("x"), F.col("own").alias("y"))),
    )
    labels = labels.withColumn("spot", F.explode(spots)).select(
        F.col("comparison").alias("l_comparison"),
        F.col("spot.x").alias("l_x"),
        F.col("spot.y").alias("l_y"),
        F.col("perm_block").alias("l_block"),
        "sample_id",
        "codes",
    )
    sums = (
        spread(tiles, "comparison", "x", "y", "perm_block")
        .groupBy("comparison", "x", "y", "perm_block")
        .cogroup(
            spread(labels, "l_comparison", "l_x", "l_y", "l_block").groupBy("l_comparison", "l_x", "l_y", "l_block")
        )
        .applyInPandas(_within_sums(per_array), "comparison string, perm int, code int, ss double")
    )
    total = pairs.groupBy("comparison").agg(F.sum("d2").alias("sst"))
    return _tested(sums, total, sizes, overall, permutations)


def _tested(sums: DataFrame, total: DataFrame, sizes: DataFrame, overall: DataFrame, permutations: int) -> DataFrame:
    """The rows of ``permanova`` from squared distances inside labels, ``sums(comparison, perm, code, ss)``, and of all pairs, ``total(comparison, sst)``."""
    within = (
        sums.groupBy("comparison", "perm", "code")
        .agg(F.sum("ss").alias("ss"))
        .join(sizes.select("comparison", "code", "n_g"), ["comparison", "code"])
        .groupBy("comparison", "perm")
        .agg(F.sum(F.col("ss") / F.col("n_g")).alias("ssw"))
    )
    total = total.join(overall, "comparison")
    total = total.withColumn("sst", F.col("sst") / F.col("n"))
    ssa = F.col("sst") - F.col("ssw")
    f = F.try_divide(
        F.try_divide(ssa, F.col("g") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("g"))
    )
    stats = within.join(total, "comparison").withColumn("f", F.round(f, 9))
    # a comparison has one row per permutation here
    first = F.max(F.when(F.col("perm") == 0, F.col("f"))).over(Window.partitionBy("comparison"))
    as_large = F.count_if((F.col("perm") > 0) & (F.col("f") >= F.col("f_model")))
    p = F.when(F.col("f_model").isNotNull(), (F.lit(1) + as_large) / F.lit(float(permutations + 1)))
    observed = F.col("perm") == 0
    return (
        stats.withColumn("f_model", first)
        .groupBy("comparison", "f_model")
        .agg(
            F.max(F.col("g") - 1).alias("df"),
            F.max(F.when(observed, ssa)).alias("sums_of_sqs"),
            F.max(F.when(observed, F.try_divide(ssa, F.col("sst")))).alias("r2"),
            (p if permutations else F.lit(None).cast("double")).alias("p_value"),
        )
    )


_PERMS_PER_TASK = 64


def _label_blocks(members: DataFrame, blocks: int, permutations: int, seed) -> DataFrame:
    """``(_block, labels)``: for the samples of a block, pickled ``{comparison: (samples, codes by permutation)}``.

    The labels of ``_permuted_labels``. A task orders the samples of one comparison for some permutations at a time, so only
    codes of a byte or two are written.
    """
    chunks = F.sequence(F.lit(0), F.lit(permutations // _PERMS_PER_TASK))
    place = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias("_block")
    rows = members.select("comparison", "sample_id", "code", place, F.explode(chunks).alias("_chunk"))

    def deal(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        comparison, chunk = (g.as_py() for g in group)
        names, code, block = rows["sample_id"].to_pylist(), rows["code"].to_numpy().astype(np.int64), rows["_block"].to_numpy()
        ends = np.cumsum(np.bincount(code)[1:])
        first, last = chunk * _PERMS_PER_TASK, min((chunk + 1) * _PERMS_PER_TASK, permutations + 1)
        codes = np.empty((len(names), last - first), np.min_scalar_type(len(ends) + 1))
        for k, perm in enumerate(range(first, last)):
            if perm:
                rank = np.empty(len(names), np.int64)
                start = f"{seed}/{perm}/"
                keys = np.array([hashlib.md5((start + s).encode()).hexdigest() for s in names], "S32")
                rank[np.argsort(keys)] = np.arange(1, len(names) + 1)
                codes[:, k] = np.searchsorted(ends, rank, side="left") + 1
            else:
                codes[:, k] = code
        out = []
        for b in np.unique(block):
            own = np.flatnonzero(block == b)
            out.append((int(b), pickle.dumps(([names[i] for i in own], codes[own]), protocol=5)))
        n = len(out)
        return pa.table({
            "comparison": pa.array([comparison] * n, pa.string()),
            "_chunk": pa.array([chunk] * n, pa.int32()),
            "_block": pa.array([b for b, _ in out], pa.int32()),
            "data": pa.array([d for _, d in out], pa.binary()),
        })

    def gather(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts: dict[str, list] = {}
        for r in sorted(rows.to_pylist(), key=lambda r: (r["comparison"], r["_chunk"])):
            names, codes = pickle.loads(r["data"])
            order = np.argsort(np.array(names, dtype=object))
            own = parts.setdefault(r["comparison"], [[names[i] for i in order]])
            own.append(codes[order])
        labels = {c: (own[0], np.hstack(own[1:])) for c, own in parts.items()}
        return pa.table({"_block": pa.array([group[0].as_py()], pa.int32()), "labels": pa.array([pickle.dumps(labels, protocol=5)], pa.binary())})

    dealt = spread(rows, "comparison", "_chunk").groupBy("comparison", "_chunk").applyInArrow(deal, "comparison string, _chunk int, _block int, data binary")
    return dealt.groupBy("_block").applyInArrow(gather, "_block int, labels binary")


def _sums_tile(a: distance.Block, b: distance.Block, own: bool) -> Iterator[dict[str, pa.Array]]:
    """Squared distances inside each label for every permutation; those of all pairs come as permutation -1."""
    place_a, place_b = ({s: i for i, s in enumerate(x.names)} for x in (a, b))
    met = sorted(a.labels.keys() & b.labels.keys())
    if not met:
        return
    d2 = (1 - 2 * a.shared(b, 0).astype(np.int64) / a.both(b, 0)) ** 2
    if own:
        d2 = np.triu(d2, 1)
    for comparison in met:
        (names_a, codes_a), (names_b, codes_b) = a.labels[comparison], b.labels[comparison]
        part = d2[np.ix_([place_a[s] for s in names_a], [place_b[s] for s in names_b])]
        perms = codes_a.shape[1]
        perm, code, ss = [np.array([-1])], [np.array([0])], [np.array([part.sum()])]
        for c in np.union1d(codes_a, codes_b):
            for lo in range(0, perms, 256):
                la, lb = codes_a[:, lo : lo + 256] == c, codes_b[:, lo : lo + 256] == c
                perm.append(np.arange(lo, lo + la.shape[1]))
                code.append(np.full(la.shape[1], int(c)))
                ss.append((la * (part @ lb.astype(float))).sum(axis=0))
        out = [np.concatenate(x) for x in (perm, code, ss)]
        yield {
            "comparison": pa.array([comparison] * len(out[0]), pa.string()),
            "perm": pa.array(out[0].astype(np.int32)),
            "code": pa.array(out[1].astype(np.int32)),
            "ss": pa.array(out[2]),
        }


def permanova_of_counts(abund: DataFrame, members: DataFrame, permutations: int = 999, seed: int | str = 1, block: int = 128) -> DataFrame:
    """``permanova`` on the Bray-Curtis distances of counts: tiles of distances meet permuted labels and are never stored.

    Tables whose samples are cut into slices and members listed twice in a comparison go by stored distances.
    """
    abund = distance._stored_counts(abund.filter(F.col("count") > 0))
    listed = members.select(F.col("comparison").cast("string").alias("comparison"), "sample_id", F.col("grp").cast("string").alias("grp"))
    samples = checkpointed(abund.select(F.coalesce(F.col("sample_id").cast("string"), F.lit("None")).alias("sample_id")).distinct())
    own = checkpointed(listed.join(samples, "sample_id", "left_semi"))
    blocks, slices = distance._layout(abund, [], block)
    twice = own.groupBy("comparison", "sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    odd = own.filter(F.col("comparison").isNull() | F.col("grp").isNull())
    if slices > 1 or samples.count() < 2 or not odd.isEmpty() or not twice.isEmpty():
        return permanova(checkpointed(distance.bray_curtis(abund, layout=(blocks, slices))), members, permutations, seed)
    sizes = own.groupBy("comparison", "grp").agg(F.count(F.lit(1)).alias("n_g"))
    sizes = checkpointed(sizes.withColumn("code", F.row_number().over(Window.partitionBy("comparison").orderBy("grp"))))
    overall = sizes.groupBy("comparison").agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("g"))
    labels = _label_blocks(own.join(sizes.select("comparison", "grp", "code"), ["comparison", "grp"]), blocks, permutations, seed)
    packed = distance._packed(abund, [], blocks, 1, distance._code_seed(abund))
    packed = stored(packed.join(labels, "_block"), "labelled-blocks")
    kind = "comparison string, perm int, code int, ss double"
    sums = stored(distance._met(packed, None, (blocks, blocks), [], _sums_tile, kind).groupBy("comparison", "perm", "code").agg(F.sum("ss").alias("ss")), "sums")
    # a comparison of a single sample has no distance
    total = sums.filter("perm < 0").join(overall.filter("n > 1"), "comparison").select("comparison", F.col("ss").alias("sst"))
    return _tested(sums.filter("perm >= 0"), total, sizes, overall, permutations)


def _measured(dist: DataFrame) -> DataFrame:
    """The samples that have distances."""
    return dist.select(F.explode(F.array("sample_a", "sample_b")).alias("sample_id")).distinct()


def single_comparison(meta: DataFrame, group: str, name: str = "all") -> DataFrame:
    return meta.select(F.lit(name).alias("comparison"), "sample_id", F.col(group).alias("grp"))


def pairwise_members(meta: DataFrame, *group: str, sep: str = "_") -> tuple[DataFrame, DataFrame]:
    """All pairs of groups as ``(pairs, members)``.

    Groups are numbered in the order of their columns (nulls are a level of their own) and compared by number;
    ``pairs`` names them in ``name`` and keeps the group columns of both sides as ``*1`` and ``*2``.
    """
    level = F.struct(*group)
    levels = meta.select(level.alias("level")).distinct().withColumn("_k", F.lit(0))
    number = F.lpad(F.row_number().over(Window.partitionBy("_k").orderBy("level")).cast("string"), 10, "0")
    levels = checkpointed(levels.select("level", number.alias("grp")))  # one row per group
    pairs = pairs_of_groups(levels, [F.col("grp")])
    text = lambda side: F.concat_ws(sep, *[F.col(f"{side}.level.{g}").cast("string") for g in group])
    sides = [F.col(f"{side}.level.{g}").alias(f"{g}{i}") for i, side in ((1, "_l"), (2, "_r")) for g in group]
    pairs = pairs.select(
        *sides,
        F.concat("_l.grp", F.lit("/"), "_r.grp").alias("comparison"),
        F.concat_ws(" vs ", text("_l"), text("_r")).alias("name"),
        F.array("_l.grp", "_r.grp").alias("_sides"),
    )
    per_side = pairs.select("comparison", F.explode("_sides").alias("grp"))
    labelled = meta.select("sample_id", level.alias("level")).join(levels, "level").select("sample_id", "grp")
    return pairs.drop("_sides"), per_side.join(labelled, "grp")


def stars(p: str) -> Column:
    return (
        F.when(F.col(p) <= 0.0001, "***")
        .when(F.col(p) <= 0.001, "**")
        .when(F.col(p) <= 0.01, "*")
        .when(F.col(p) <= 0.05, ".")
        .otherwise("")
    )


def pairwise_permanova(
    dist: DataFrame | None, meta: DataFrame, *group: str, permutations: int = 999, seed: int | str = 1, walk: bool = False, abund: DataFrame | None = None
) -> DataFrame:
    """A permutation test for every pair of groups, with Bonferroni-adjusted p-values over all pairs.

    Without ``dist`` the Bray-Curtis distances of ``abund`` are used as they arise.
    """
    pairs, members = pairwise_members(meta, *group)
    if dist is None:
        tested = checkpointed(permanova_of_counts(abund, members, permutations, seed))
    else:
        tested = checkpointed(permanova(dist, members, permutations, seed, walk=walk))
    out = bonferroni(tested, "p_value", out="p_adjusted").withColumn("sig", stars("p_adjusted"))
    return pairs.join(out, "comparison").drop("comparison").withColumnRenamed("name", "pairs")


def dispersion(dist: DataFrame, meta: DataFrame, group: str) -> DataFrame:
    """Distance of each sample to the centroid of its group, from the distances alone; samples without any are left out."""
    own = meta.select("sample_id", F.col(group).alias("grp")).join(_measured(dist), "sample_id", "left_semi")
    a = own.select(F.col("sample_id").alias("sample_a"), "grp")
    b = own.select(F.col("sample_id").alias("sample_b"), "grp")
    inside = dist.join(a, "sample_a").join(b, ["sample_b", "grp"]).withColumn("d2", F.col("d") * F.col("d"))
    ends = inside.select("grp", "d2", F.explode(F.array("sample_a", "sample_b")).alias("sample_id"))
    row = ends.groupBy("grp", "sample_id").agg(F.sum("d2").alias("row_sum"))
    spread = inside.groupBy("grp").agg(F.sum("d2").alias("all_sum"))
    n = own.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    out = own.join(n, "grp").join(row, ["grp", "sample_id"], "left").join(spread, "grp", "left")
    d2 = F.coalesce(F.col("row_sum"), F.lit(0.0)) / F.col("n") - F.coalesce(F.col("all_sum"), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return out.select("sample_id", F.col("grp").alias(group), F.sqrt(F.greatest(d2, F.lit(0.0))).alias("distance"))
