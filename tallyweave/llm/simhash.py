"""SimHash fingerprints and their links by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 hashes (UTF-8, seed 42) of a text's word
shingles, repeats included. Words are separated by ASCII white space, A-Z are lower-cased first.

Candidate search is exact. Bit positions get non-zero vectors of ``radius + 1`` binary digits; for every non-zero vector
v, a table keeps the bits whose vector has an odd inner product with v. The vectors of at most ``radius`` differing bits
span less than the whole space, so some v is orthogonal to all of them and its table sees two equal keys. Only distinct
fingerprints are compared. Tables' buckets up to ``bucket_limit`` fingerprints are compared inside one row, larger ones
are hashed again with the masks of another assignment, and what is still large is compared in tiles; no limit drops
anything. Each comparison returns a spanning forest of its links, never all pairs.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links like any other; fewer words
than a shingle give one shingle of all words; rows that repeat get one row each; an empty table gives no rows; a null
doc_id keeps its row and is never the smallest id while its component has another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import arrow_map, drop, small_side, stored
from tallyweave.llm.components import components

_BITS = 64


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included."""
    import xxhash

    w = (text or b"").lower().split()
    if len(w) <= words:
        shingles = [b" ".join(w)] if w else []
    else:
        shingles = [b" ".join(s) for s in zip(*(w[i:] for i in range(words)))]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def fingerprint_of(h: np.ndarray) -> int:
    """Signed 64-bit fingerprint of shingle hashes."""
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """Signed 64-bit value of a text's fingerprint."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key (hash of id and text), fp (signed long) for each row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, each, f"doc_id {kind}, key bigint, fp bigint")


def covering_masks(radius: int, turn: int = 0) -> list[int]:
    """Signed masks; ``turn`` selects another assignment of vectors to bit positions."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + (i * (1 + 6 * turn) + i // size * turn + turn) % size for i in range(_BITS)]
    masks = []
    for v in range(1, size + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    u = fps.view(np.uint64)
    left, found = np.arange(len(u)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            i, front = front[0], front[1:]
            near = np.bitwise_count(u[left] ^ u[i]) <= radius
            if near.any():
                found += [(int(fps[i]), int(fps[j])) for j in left[near]]
                front, left = np.concatenate([front, left[near]]), left[~near]
    return found


def _solve(rows: DataFrame, radius: int) -> DataFrame:
    """Rows with an array ``fps`` of distinct fingerprints -> links a, b."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = [x for fps in batch["fps"] for x in _forest(np.asarray(fps, np.int64), radius)]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.select("fps").mapInPandas(each, "a bigint, b bigint")


def _keyed(rows: DataFrame, keep: list[str], masks: list[int], name: str) -> DataFrame:
    entry = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]
    return rows.select("fp", *keep, F.explode(F.array(*entry)).alias(name))


def links(distinct_fps: DataFrame, radius: int = 3, bucket_limit: int = 512, passing: list[str] | None = None) -> DataFrame:
    """Distinct fp -> a, b: pairs within ``radius`` bits whose components are those of all such pairs."""
    level1 = _keyed(distinct_fps, [], covering_masks(radius), "k1")
    counts = level1.groupBy("k1").agg(F.count("*").alias("n")).filter("n > 1")
    level1 = stored(level1.join(counts, "k1"), "simhash-buckets", passing)
    small = level1.filter(F.col("n") <= bucket_limit).groupBy("k1").agg(F.collect_list("fp").alias("fps"))
    level2 = _keyed(level1.filter(F.col("n") > bucket_limit), ["k1"], covering_masks(radius, 1), "k2")
    counts2 = level2.groupBy("k1", "k2").agg(F.count("*").alias("n2")).filter("n2 > 1")
    level2 = level2.join(counts2, ["k1", "k2"])
    middle = level2.filter(F.col("n2") <= bucket_limit).groupBy("k1", "k2").agg(F.collect_list("fp").alias("fps"))
    # tiles: a fingerprint of part p meets the parts q in the tiles (p, q)
    big = level2.filter(F.col("n2") > bucket_limit).withColumn("parts", F.ceil(F.col("n2") * 2 / bucket_limit).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = big.withColumn("p", part).select("fp", "k1", "k2", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    tiles = tiles.groupBy("k1", "k2", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.collect_list("fp").alias("fps"))
    rows = small.select("fps").union(middle.select("fps")).union(tiles.select("fps"))
    return _solve(rows, radius).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, bucket_limit: int = 512, similarity: float | None = None) -> DataFrame:
    """doc_id, key, fp, component_id (the smallest doc_id reachable over links), root (the smallest such fp) for each row.

    With ``similarity``, all pairs of texts whose sets of shingles have that Jaccard similarity or more are links as well,
    however far apart their fingerprints are.
    """
    passing: list[str] = []
    fps = stored(fingerprints(docs, words), "simhash-fingerprints")
    heads = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-distinct")
    found = links(heads.select("fp"), radius, bucket_limit, passing)
    if similarity is not None:
        from tallyweave.llm import shingles

        found = found.union(shingles.links(docs, words, similarity, passing))
    of = components(found)
    drop(docs.sparkSession, passing)  # the components are stored
    joined = heads.join(of, heads.fp == of.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    first = joined.groupBy("root").agg(F.min("head").alias("component_id"))
    member = joined.join(first, "root").select("fp", "component_id", "root")
    return fps.join(member, "fp").select("doc_id", "key", "fp", "component_id", "root")


def keep_first(docs: DataFrame, words: int = 5, radius: int = 3, bucket_limit: int = 512, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component, all columns: the smallest doc_id, of rows that share it the smallest key.

    A component is known by its root, so texts that share an id, or have none, stay if they are not near-duplicates.
    """
    found = near_duplicates(docs, words, radius, bucket_limit, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    # the rows of a root have one doc_id here
    first = rows.groupBy("root").agg(F.min(F.struct("key", "n", "doc_id")).alias("f")).select(F.col("f.doc_id").alias("__doc"), F.col("f.key").alias("__key"), F.col("f.n").alias("__n"))
    first = stored(first, "simhash-first")
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__doc"))
    kept = docs.join(small_side(first, 64), same)
    equal = kept.filter("__n > 1").withColumn("__i", F.row_number().over(Window.partitionBy("__doc", "__key").orderBy("__n"))).filter("__i = 1")
    return kept.filter("__n = 1").select(*docs.columns).union(equal.select(*docs.columns))
