"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text: each byte shifts it one bit to the left and adds the byte's random
number, so 32 bits depend on the last 32 bytes. A chunk ends where the hash's leading ``bits`` bits are zero and the
chunk has ``least`` bytes, or at ``most`` bytes, moved to the next start of a character. As the cuts depend on nearby
content alone, an insertion changes only the chunks around it and equal passages fall into equal chunks again.

Chunks are compared by a 128-bit digest. In the order of (doc_id, place) the first occurrence of a digest stays; later ones
go, where they lie in a run of at least ``run`` bytes of such chunks. A hot chunk is counted by partial aggregates.

Defined results: a null or empty text has no chunks and is returned as it is; rows that repeat id and text count as one
document and each gets its result; rows with one id and different texts are ordered by a hash of both; a null id comes
first; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import arrow_map, stored

WINDOW = 32
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: a window of 2w bytes is two windows of w bytes."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        shifted = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += shifted
    return h


def cuts(texts: list[bytes], bits: int, least: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each text; ``least`` is at least the hash's window, so that no cut looks beyond a chunk."""
    out = []
    for group in _batches(texts):
        data = np.frombuffer(b"".join(group), np.uint8)
        likely = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1 if len(data) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in group])])
        places = np.searchsorted(likely, bounds, side="right")
        for k, text in enumerate(group):
            start, n, last, ends = int(bounds[k]), len(text), 0, []
            for at in [*(likely[places[k] : places[k + 1]] - start).tolist(), n]:
                while at - last > most:
                    last = _character(text, last + most)
                    ends.append(last)
                if at - last >= least and at < n:
                    cut = _character(text, at)
                    if cut < n:
                        ends.append(cut)
                        last = cut
            if n:
                ends = [e for e in ends if e < n] + [n]
            out.append(ends)
    return out


def _character(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _batches(texts: list[bytes], most: int = 1 << 22):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def chunked(docs: DataFrame, bits: int = 5, least: int = 32, most: int = 512) -> DataFrame:
    """doc, key, n (place of the chunk), d1, d2 (digest) for each chunk of each document."""
    if least < WINDOW:
        raise ValueError(f"least must be {WINDOW} or more")
    schema = T.StructType([T.StructField("doc", docs.schema["doc_id"].dataType), *_fields("key bigint, n int, d1 bigint, d2 bigint")])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in batch.column("bytes").to_pylist()]
        row, n, digest = [], [], []
        for i, ends in enumerate(cuts(texts, bits, least, most)):
            t, begin = texts[i], 0
            row += [i] * len(ends)
            n += range(len(ends))
            for end in ends:
                digest.append(xxhash.xxh3_128_digest(t[begin:end]))
                begin = end
        d = np.array([struct.unpack("<qq", x) for x in digest], np.int64).reshape(-1, 2)
        at = pa.array(row, pa.int64())
        columns = [batch.column("doc").take(at), batch.column("key").take(at), pa.array(n, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "key", "n", "d1", "d2"])

    return arrow_map(_keyed(docs).select("doc", "key", "bytes"), each, schema)


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("bytes"))


def deduplicated(docs: DataFrame, bits: int = 5, least: int = 32, most: int = 512, run: int = 64) -> DataFrame:
    """doc_id, text (what is kept), n_bytes, n_chunks, n_removed, n_spans for each row of ``docs``."""
    chunks = stored(chunked(docs, bits, least, most), "chunks")
    place = F.struct("doc", "key", "n")
    firsts = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    later = chunks.join(firsts, ["d1", "d2"]).filter(F.struct("doc", "key", "n") != F.col("first"))
    gone = later.groupBy(F.col("doc").alias("g_doc"), F.col("key").alias("g_key")).agg(F.collect_set("n").alias("gone"))  # chunks of one text
    rows = _keyed(docs)
    rows = rows.join(gone, (F.col("key") == F.col("g_key")) & F.col("doc").eqNullSafe(F.col("g_doc")), "left")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *_fields("text string, n_bytes bigint, n_chunks bigint, n_removed bigint, n_spans bigint")])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("bytes").to_pylist()
        out = [_without(t or b"", ends, gone or (), run) for t, gone, ends in zip(raw, batch.column("gone").to_pylist(), cuts([t or b"" for t in raw], bits, least, most))]
        texts = pa.array([None if t is None else kept for t, (kept, *_) in zip(raw, out)], pa.binary()).cast(pa.string())
        numbers = [pa.array([o[k] for o in out], pa.int64()) for k in range(1, 5)]
        names = ["doc_id", "text", "n_bytes", "n_chunks", "n_removed", "n_spans"]
        return pa.RecordBatch.from_arrays([batch.column("doc"), texts, *numbers], names=names)

    return arrow_map(rows.select("doc", "bytes", "gone"), each, schema)


def _without(text: bytes, ends: list[int], gone, run: int) -> tuple[bytes, int, int, int, int]:
    """What is left of a text without the runs of chunks to go; bytes, chunks, bytes removed, runs removed."""
    gone, begins = set(gone), [0, *ends[:-1]]
    kept, removed, spans, k = [], 0, 0, 0
    while k < len(ends):
        j = k
        while j < len(ends) and j in gone:
            j += 1
        if j > k and ends[j - 1] - begins[k] >= run:
            removed += ends[j - 1] - begins[k]
            spans += 1
        else:
            j = max(j, k + 1)
            kept.append(text[begins[k] : ends[j - 1]])
        k = j
    return b"".join(kept), len(text), len(ends), removed, spans
