"""Exact Jaccard similarity join of documents' sets of word shingles.

Words and shingles are those of the fingerprints in ``simhash``; a set holds their distinct XXH64 hashes. The search is
exact but for collisions of 64-bit hashes.

* Prefix filter: tokens have one order, and two sets of sizes n and m with a similarity of t or more share one of their first
  n - ceil(t n) + 1 and m - ceil(t m) + 1 tokens. A sketch of ``2**_SKETCH_BITS`` counters holds how many sets of all
  documents have each token; frequent ones come last, equal ranks by hash. The order only steers the work, any gives the same result.
* Length filter: t n <= m. Positional filter: behind a first common token at places i and j at most 1 + min(n - i, m - j)
  tokens can be shared, and t / (1 + t) (n + m) must be.
* Links are wanted for components only. So in star rounds the members of a prefix token meet one of them, which makes as
  many pairs as members; components form, and in the end members of different components meet. Pairs inside a component
  are never formed, and no limit drops any other pair.
* Parities of the tokens in 1,024 classes, of larger sets in as many as they have tokens or more, bound the tokens that two sets
  don't share: most pairs go by them, without whole sets. The similarity of the pairs that remain is computed from whole sets.
* Members of prefix tokens are counted in turns by token, which bounds the disk space of a shuffle.

Texts without words have the empty set and are equal. Rows with equal sets are linked to one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_map, drop, small_side, stored
from tallyweave.llm.components import components
from tallyweave.llm.simhash import fingerprint_of, shingle_hashes

_SKETCH_BITS, _SHIFT = 18, 20
_ROUNDS, _CLASSES = 4, 1024
_TURNS = 4  # a power of two


def _class_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(_SHIFT) & np.uint64((1 << _SKETCH_BITS) - 1)).astype(np.int64)


def _ranks(rows: DataFrame, words: int) -> np.ndarray:
    """For each class of tokens a rank that grows with the number of sets, of all rows, that hold its tokens."""
    size = 1 << _SKETCH_BITS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column("text").to_pylist()]
            held += np.bincount(_class_of(np.concatenate([np.zeros(0, np.uint64), *sets])), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["class", "n"])

    counted = rows.select("text").mapInArrow(each, "class int, n bigint").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    ranks = np.zeros(size, np.uint8)
    # bit lengths; frexp is exact below 2**53
    ranks[counted.column("class").to_numpy()] = np.frexp(counted.column("n").to_numpy().astype(np.float64))[1]
    return ranks


def _parity(tokens: np.ndarray) -> bytes:
    classes = max(_CLASSES, 1 << len(tokens).bit_length())
    odd = np.bincount((tokens & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(p: bytes, q: bytes) -> int:
    """Classes with different parities; the longer one's halves are added until both have equally many."""
    p, q = sorted((np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _sets(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """key, fp, sig (hash of the set), n (its size), parity, prefix for each row."""
    shared = rows.sparkSession.sparkContext.broadcast(_ranks(rows, words))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        ranks = shared.value
        fps, sigs, sizes, parities, prefixes = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingle_hashes(text, words)
            tokens = np.unique(hashes)
            length = len(tokens) - math.ceil(len(tokens) * similarity - 1e-9) + 1 if len(tokens) else 0
            fps.append(fingerprint_of(hashes))
            sigs.append(xxhash.xxh64_intdigest(tokens.astype("<u8").tobytes(), 42))
            sizes.append(len(tokens))
            parities.append(_parity(tokens))
            tokens = tokens[np.argsort(ranks[_class_of(tokens)], kind="stable")]
            prefixes.append(tokens[:length].view(np.int64))
        columns = [batch.column("key"), pa.array(fps, pa.int64()), pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(parities, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "fp", "sig", "n", "parity", "prefix"])

    return arrow_map(rows, each, "key bigint, fp bigint, sig bigint, n int, parity binary, prefix array<bigint>")


def _similar(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, words: int, similarity: float, passing: list[str]) -> DataFrame:
    """Those of the pairs a, b of sets whose similarity, from whole sets, is high enough."""
    own: list[str] = []

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "t"])

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = np.array([_apart(p, q) for p, q in zip(*(batch.column(c).to_pylist() for c in "pq"))], np.int64)
        n = batch.column("n").to_numpy()
        both = np.ceil(n * (similarity / (1 + similarity)) - 1e-9)
        return batch.select(["a", "b"]).filter(pa.array(apart <= n - 2 * both, pa.bool_()))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.asarray(z.values) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    x, y = (firsts.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(p)) for c, p in ("ap", "bq"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "p", "q")
    pairs = stored(arrow_map(met, likely, "a bigint, b bigint"), "near-likely", own)
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(firsts, "sig")
    wanted = stored(wanted.select("sig", F.col("key").alias("k")), "near-wanted", own)
    texts = rows.join(small_side(wanted, 32), F.col("key") == F.col("k")).select("sig", "text")
    # rows that repeat a document give the same set
    sets = stored(arrow_map(texts, tokens, "sig bigint, t array<bigint>").dropDuplicates(["sig"]), "near-whole", own)
    x, y = (small_side(sets, 16, 8).select(F.col("sig").alias(c), F.col("t").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    found = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verified, "a bigint, b bigint"), "near-found", passing)
    drop(rows.sparkSession, own)
    return found


def _may_match(similarity: float, x: str, y: str) -> Column:
    """Length and positional filters of members x and y of a token."""
    nx, ny, i, j = (F.col(f"{s}.{c}") for c in ("n", "i") for s in (x, y))
    enough = 1 + F.least(nx - 1 - i, ny - 1 - j) >= (nx + ny) * (similarity / (1 + similarity)) - 1e-9
    return (nx * similarity <= ny + 1e-9) & (ny * similarity <= nx + 1e-9) & enough


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def _open(members: DataFrame, found: DataFrame, passing: list[str]) -> DataFrame:
    """Members with their components ``comp``, of tokens that several components share."""
    of = components(found).select(F.col("node").alias("sig"), "root")
    now = members.join(of, "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")
    shared = now.groupBy("tok").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).filter("l < h").select("tok")
    return stored(now.join(shared, "tok"), "near-open", passing)


def links(docs: DataFrame, words: int, similarity: float, passing: list[str]) -> DataFrame:
    """a, b: pairs of fingerprints of documents; their components are those of all pairs of sets that are similar enough."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    sets = stored(_sets(rows, words, similarity), "near-sets", passing)
    firsts = stored(sets.groupBy("sig").agg(F.min("key").alias("key"), F.min("fp").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity")), "near-firsts", passing)

    merged = lambda parts: parts[0] if len(parts) == 1 else merged(parts[:-1]).union(parts[-1])
    own: list[str] = []
    distinct = stored(sets.filter("n > 0").select("sig", "n", "prefix").dropDuplicates(["sig"]), "near-distinct", own)
    members = []
    for turn in range(_TURNS):
        some = distinct.select("sig", "n", F.posexplode("prefix").alias("i", "tok")).filter(F.col("tok").bitwiseAND(F.lit(_TURNS - 1)) == turn)
        counts = some.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok")
        members.append(stored(some.join(counts, "tok"), "near-members", passing))
    drop(docs.sparkSession, own)
    members = merged(members)

    left = members.withColumn("comp", F.col("sig"))
    tried, found = [], []
    for turn in range(_ROUNDS):
        rank = F.xxhash64("sig", F.lit(turn))
        head = left.groupBy("tok").agg(F.min(F.struct(rank.alias("r"), "sig", "n", "i", "comp")).alias("y"))
        met = left.select("tok", F.struct("sig", "n", "i", "comp").alias("x")).join(head, "tok")
        pairs = _ordered(met.filter((F.col("x.comp") != F.col("y.comp")) & _may_match(similarity, "x", "y")))
        pairs = stored(pairs if not tried else pairs.join(merged(tried), ["a", "b"], "left_anti"), "near-star", passing)
        tried.append(pairs)
        found.append(_similar(rows, firsts, pairs, words, similarity, passing))
        left = _open(members, merged(found), passing)
        # pairs of members of different components, counted
        sizes = left.groupBy("tok", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("tok")
        crossing = sizes.agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
        cost = crossing.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("p"), F.sum("s").alias("s")).first()
        if (cost["p"] or 0) <= 4 * (cost["s"] or 0):
            break

    # whatever is open: members of each two components of a token
    comps = left.select("tok", "comp").distinct()
    two = comps.select("tok", F.col("comp").alias("ca")).join(comps.select("tok", F.col("comp").alias("cb")), "tok").filter("ca < cb")
    member = F.struct("sig", "n", "i")
    side = lambda c, s: left.select("tok", F.col("comp").alias(c), member.alias(s))
    met = two.join(side("ca", "x"), ["tok", "ca"]).join(side("cb", "y"), ["tok", "cb"]).filter(_may_match(similarity, "x", "y"))
    pairs = stored(_ordered(met).join(merged(tried), ["a", "b"], "left_anti"), "near-rest", passing)
    found.append(_similar(rows, firsts, pairs, words, similarity, passing))

    rep = firsts.select("sig", "rep")
    far = merged(found).join(rep.select(F.col("sig").alias("a"), F.col("rep").alias("p")), "a").join(rep.select(F.col("sig").alias("b"), F.col("rep").alias("q")), "b")
    same = sets.select("sig", "fp").distinct().join(rep, "sig").select(F.col("fp").alias("p"), F.col("rep").alias("q"))
    return stored(far.select("p", "q").union(same).filter("p <> q").toDF("a", "b"), "near-links", passing)
