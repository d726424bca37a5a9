"""Hard negatives by exact inner products of tiles, multiplied after Strassen.

Rows are dealt into blocks of one matrix each, in the order of their labels, so that a label of any size is many blocks and
many small labels share one. Anchor blocks meet candidate blocks on a grid: a candidate shard travels once to each group of
anchor blocks and an anchor block once to each shard, so neither side is copied to everybody, and the number of block
pairs is that of tiles, not of rows. A tile's scores are a product of 64-bit integer matrices by Strassen's recursion, filled up
with zero rows and columns to even halves; all additions are of integers modulo 2**64, so scores that fit 64 bits are exact.

Two passes use the same tiles. The first takes block pairs that share a label and keeps each anchor's best rows of its own
label; the second takes pairs with different labels and keeps the best rows inside each positive's window of scores. Both keep
sorted arrays of fixed width, one for each anchor or (anchor, positive), which merge by taking the best of two: a task merges
those of one anchor block over all its candidate blocks before it hands them on, and Spark merges the rest by rank.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; rows that repeat
(id, label and vector) count once; rows of the anchor's own id are no candidates of it. Shorter vectors count as filled up with zeros. Ties
go to smaller ids, of equal ids to larger scores first. An anchor without another row of its label gives nothing, a window
without rows likewise; empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import drop, stored
from tallyweave.llm.knn import _matrix, _packed, _unpacked

LEAF = 32
BLOCK = 2048
_LOW = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers modulo 2**64; halves are filled up with zeros to even sizes."""
    n, m, k = a.shape[0], a.shape[1], b.shape[1]
    if min(n, m, k) <= leaf:
        return _leaf(a, b)
    rows, inner, cols = -(-n // 2), -(-m // 2), -(-k // 2)
    if (2 * rows, 2 * inner) != a.shape:
        a = np.pad(a, ((0, 2 * rows - n), (0, 2 * inner - m)))
    if (2 * inner, 2 * cols) != b.shape:
        b = np.pad(b, ((0, 2 * inner - m), (0, 2 * cols - k)))
    a11, a12, a21, a22 = a[:rows, :inner], a[:rows, inner:], a[rows:, :inner], a[rows:, inner:]
    b11, b12, b21, b22 = b[:inner, :cols], b[:inner, cols:], b[inner:, :cols], b[inner:, cols:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * rows, 2 * cols), np.int64)
    out[:rows, :cols] = p1 + p4 - p5 + p7
    out[:rows, cols:] = p3 + p5
    out[rows:, :cols] = p2 + p4
    out[rows:, cols:] = p1 - p2 + p3 + p6
    return out[:n, :k]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A product of small blocks: in doubles where every partial sum is an integer below 2**53, else in 64-bit integers."""
    if a.size and b.size and -(1 << 52) < a.min() and a.max() < 1 << 52 and -(1 << 52) < b.min() and b.max() < 1 << 52:
        if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < float(1 << 53):
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Heaps:
    """For each slot the ``width`` best (score, id), best first; merging two keeps the best of both."""

    def __init__(self, slots: int, width: int):
        self.width = width
        self.score, self.id = np.full((slots, width), _LOW), np.zeros((slots, width), np.int64)
        self.size = np.zeros(slots, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge entries (several may have one slot) into their heaps."""
        if not len(slot):
            return
        touched = np.unique(slot)
        old = np.arange(self.width)[None] < self.size[touched][:, None]
        slot = np.concatenate([slot, np.repeat(touched, self.size[touched])])
        score = np.concatenate([score, self.score[touched][old]])
        ids = np.concatenate([ids, self.id[touched][old]])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - begin
        keep = rank < self.width
        self.score[slot[keep], rank[keep]], self.id[slot[keep], rank[keep]] = score[keep], ids[keep]
        self.size[touched] = np.minimum(self.width, np.bincount(slot)[touched])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(np.arange(self.width)[None] < self.size[:, None])
        return slot, self.score[slot, place], self.id[slot, place]


def _blocks(rows: DataFrame, parts: int, block: int) -> DataFrame:
    """block (a number), labels (distinct), ids, tags (labels of the rows), xs, width: rows in order of their labels, at most ``block`` together."""
    by = [F.col("label"), F.xxhash64("id", "v"), F.col("id")]
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def packed(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            number += 1
            tags, width = part["label"].to_numpy(np.int64), max(len(v) for v in part["v"])
            x = _matrix(part["v"], width)
            row = (number, sorted(set(tags.tolist())), part["id"].to_numpy(np.int64).tobytes(), tags.tobytes(), _packed(x), width)
            return pd.DataFrame([row], columns=["block", "labels", "ids", "tags", "xs", "width"])

        for b in batches:
            held.append(b)
            size += len(b)
            while size >= block:
                whole = pd.concat(held)
                yield packed(whole.iloc[:block])
                held, size = [whole.iloc[block:]], size - block
        if size:
            yield packed(pd.concat(held))

    return ordered.select("id", "label", "v").mapInPandas(each, "block bigint, labels array<bigint>, ids binary, tags binary, xs binary, width int")


def _unblock(ids: bytes, tags: bytes, xs: bytes, width: int, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags = np.frombuffer(ids, np.int64), np.frombuffer(tags, np.int64)
    x = _unpacked(xs, len(ids), width) if width else np.zeros((len(ids), 0), np.int64)
    return ids, tags, np.pad(x, ((0, 0), (0, wide - width))) if wide > width else x


_PAIR = ["ids", "tags", "xs", "width"]


def _side(df: DataFrame, side: str, *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", *_PAIR)], *more)


def _tiles(batches: Iterator[pd.DataFrame], slots: int, width: int, found) -> Iterator[tuple]:
    """(a row of the block, its anchors, its heaps) for each anchor block; rows of one block come together.

    ``found(heaps, anchors, candidates, scores, row)`` merges what a tile gives.
    """
    last = heaps = anchors = None
    for b in batches:
        for row in b.itertuples(index=False):
            if last is not None and row.a_block != last.a_block:
                yield last, anchors, heaps
                heaps = None
            last, wide = row, max(row.a_width, row.c_width)
            anchors = _unblock(row.a_ids, row.a_tags, row.a_xs, row.a_width, wide)
            candidates = _unblock(row.c_ids, row.c_tags, row.c_xs, row.c_width, wide)
            heaps = Heaps(len(anchors[0]) * slots, width) if heaps is None else heaps
            found(heaps, anchors, candidates, strassen(anchors[2], np.ascontiguousarray(candidates[2].T)), row)
    if last is not None:
        yield last, anchors, heaps


def _positives(anchors: DataFrame, candidates: DataFrame, count: int) -> DataFrame:
    """a_block, at (place in the block), anchor_id, positive_id, rank, score: each anchor's best other rows of its label."""
    shared = _side(anchors, "a", F.explode("labels").alias("label")).join(_side(candidates, "c", F.explode("labels").alias("m")), F.col("label") == F.col("m"))
    # blocks that share several labels meet once
    met = shared.select("a_block", "c_block").distinct()
    pairs = met.join(_side(anchors, "a"), "a_block").join(_side(candidates, "c"), "c_block")

    def same(heaps: Heaps, a, c, scores: np.ndarray, row) -> None:
        ok = (a[1][:, None] == c[1][None]) & (a[0][:, None] != c[0][None])
        if ok.any():
            if scores.shape[1] > 4 * heaps.width:  # below an anchor's count-th score of this tile nothing can stay
                limit = np.partition(np.where(ok, scores, _LOW), -heaps.width, axis=1)[:, -heaps.width]
                ok &= scores >= limit[:, None]
            slot, at = np.nonzero(ok)
            heaps.add(slot, scores[slot, at], c[0][at])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, a, heaps in _tiles(batches, 1, count, same):
            slot, score, ids = heaps.entries()
            yield pd.DataFrame({"a_block": row.a_block, "at": slot.astype(np.int32), "anchor_id": a[0][slot], "positive_id": ids, "score": score})

    schema = "a_block bigint, at int, anchor_id bigint, positive_id bigint, score bigint"
    partial = pairs.sortWithinPartitions("a_block").mapInPandas(each, schema)
    rank = F.row_number().over(Window.partitionBy("a_block", "at").orderBy(F.desc("score"), "positive_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= count)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """(id, label, v) rows and anchors, v an integer array -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its ``positives`` best other rows of its label, the ``negatives`` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    passing: list[str] = []
    valid = lambda df: df.filter("id is not null and label is not null and v is not null").select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "v").distinct()
    rows, anchors = stored(valid(rows), "negatives-rows", passing), valid(anchors)
    spark = rows.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(shuffles, -(-rows.count() // block)))
    candidate = stored(_blocks(rows, shards, block), "negatives-candidates", passing)
    asked = stored(_blocks(anchors, shuffles, max(1, block // 4)), "negatives-anchors", passing)
    found = stored(_positives(asked, candidate, positives), "negatives-positives", passing)

    windows = found.groupBy("a_block").agg(F.collect_list(F.struct("at", "rank", "positive_id", "score")).alias("windows"))  # block * positives at most
    wanted = _side(asked, "a", "labels").join(windows, "a_block")
    # a grid of about sqrt(cells) groups of anchor blocks by as many shards of candidate blocks
    groups = max(1, min(int(np.sqrt(shuffles)), asked.count()))
    shards = max(1, min(-(-shuffles // groups), candidate.count()))
    left = wanted.withColumn("g", F.pmod(F.hash("a_block"), F.lit(groups)).cast("bigint")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    right = _side(candidate, "c", F.col("labels").alias("others")).withColumn("s", F.pmod(F.hash("c_block"), F.lit(shards)).cast("bigint"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    differ = (F.size("labels") > 1) | (F.size("others") > 1) | (F.col("labels")[0] != F.col("others")[0])
    pairs = left.join(right, ["g", "s"]).filter(differ).drop("g", "s", "labels", "others")

    def inside(heaps: Heaps, a, c, scores: np.ndarray, row) -> None:
        n = len(a[0])
        lows, highs = np.full((n, positives), 1), np.zeros((n, positives), np.int64)
        for w in row.windows:
            least, most = -(-low * w["score"] // 100), high * w["score"] // 100
            lows[w["at"], w["rank"] - 1], highs[w["at"], w["rank"] - 1] = least, most
        real = lows <= highs
        least = np.where(real, lows, np.iinfo(np.int64).max).min(axis=1)
        most = np.where(real, highs, _LOW).max(axis=1)
        ok = (scores >= least[:, None]) & (scores <= most[:, None])
        at, col = np.nonzero(ok)
        keep = (a[1][at] != c[1][col]) & (a[0][at] != c[0][col])
        at, col = at[keep], col[keep]
        score, ids = scores[at, col], c[0][col]
        for p in range(positives):
            within = (score >= lows[at, p]) & (score <= highs[at, p])
            heaps.add(at[within] * positives + p, score[within], ids[within])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, a, heaps in _tiles(batches, positives, negatives, inside):
            of = {w["at"] * positives + w["rank"] - 1: (w["positive_id"], w["score"]) for w in row.windows}
            slot, score, ids = heaps.entries()
            own = np.array([of[s] for s in slot.tolist()], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a_block": row.a_block, "slot": slot.astype(np.int32), "anchor_id": a[0][slot // positives], "positive_id": own[:, 0], "positive_score": own[:, 1], "negative_id": ids, "negative_score": score})

    schema = "a_block bigint, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    partial = pairs.sortWithinPartitions("a_block").mapInPandas(each, schema)
    rank = F.row_number().over(Window.partitionBy("a_block", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    best = partial.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    out = stored(best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-found")
    drop(spark, passing)
    return out
