"""Bounded-space online best-fit packing of tokenised documents into sequences of fixed capacity.

Pieces are dealt by a hash to packing tasks, whose number and size adaptive execution chooses; each task packs its pieces in
one pass, longest first, and may leave one sequence unfilled: a piece goes to the open bin with the least sufficient free space, found in a bitset keyed by free space.
At most ``open_bins`` bins are open; when one more is needed the fullest closes. A task's memory is its open bins and one
batch of pieces, whatever the input's size.

Defined results: a null or empty text is the end id alone; only documents longer than the capacity are cut, into pieces
of the capacity and a last one that may be shorter; repeated rows are packed once each; an empty table gives no rows; a
null doc_id keeps its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map
from tallyweave.llm.tokens import Encoder


class BestFit:
    """Open bins in a bitset: bit f is set while some open bin has f free places."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bits, self.count, self.made = {}, 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            del self.free[space]
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of 1 to capacity tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - space


def tokenized_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian bytes of the tokenizer's width) in pieces of at most ``capacity``."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.shared(tokenizer, kind)
        at, piece, start, length, out = [], [], [], [], []
        for i, ids in enumerate(encoder.encode(batch.column("text"))):
            ids = np.append(ids, encoder.dtype.type(end_id))
            for k, b in enumerate(range(0, len(ids), capacity)):
                part = ids[b : b + capacity]
                at.append(i), piece.append(k), start.append(b), length.append(len(part)), out.append(part.tobytes())
        columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    schema = f"doc_id {id_kind}, piece int, start bigint, length bigint, ids binary"
    return arrow_map(docs.select("doc_id", "text"), each, schema)


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 1024) -> DataFrame:
    """Adds sequence_id (long) and offset to rows with ``length`` and ``ids``; sequences have no gaps.

    ``ids`` leave as little-endian unsigned 32-bit numbers.
    """
    dealt = pieces.repartition(F.xxhash64("doc_id", "piece", "ids"))
    dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", F.xxhash64("ids")).withColumn("task", F.spark_partition_id())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        for batch in batches:
            placed = [fit.place(n) for n in batch.column("length").to_pylist()]
            base = batch.column("task")[0].as_py() << 40 if batch.num_rows else 0
            columns = {k: batch.column(k) for k in batch.schema.names if k != "task"}
            ids = zip(batch.column("ids").to_pylist(), batch.column("length").to_pylist())
            columns["ids"] = pa.array([b if len(b) == 4 * n else np.frombuffer(b, "<u2").astype("<u4").tobytes() for b, n in ids], pa.binary())
            columns["sequence_id"] = pa.array([base + n for n, _ in placed], pa.int64())
            columns["offset"] = pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(each, f"{schema}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "word", capacity: int = 4096, open_bins: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for each piece of each document."""
    return pack(tokenized_pieces(docs, tokenizer, kind, end_id, capacity), capacity, open_bins)
