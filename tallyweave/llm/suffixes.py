"""Exact removal of long repeated substrings with suffix arrays built by linear grouping.

``suffix_array`` is the construction that works without recursion: suffixes are grouped by their first symbol; groups are
taken in descending order, every suffix of a group points to the nearest earlier suffix of a lower group, and the suffixes
pointed to move to new groups right after their old ones, by the number of pointers. Groups then hold the suffixes with one
Lyndon prefix, and a pass from the smallest suffix on emits each group's order along the same pointers.

``repeats`` finds every string of ``length`` bytes that starts at two places at least, in any documents:

* Anchors are the places whose hash of the next ``GRAM`` bytes is least among ``reach + 1`` neighbours. Equal strings hold
  the same anchors, and the first ``reach + 1`` places of each string hold one. So a repeated string is seen from an anchor
  at most ``reach`` bytes after its start, and contains the ``length - reach`` bytes from there on: the core.
* Anchors with equal cores meet. What can still differ are two fringes of ``reach`` bytes, before and after the core.
  Anchors whose whole surroundings are equal are repeats altogether. Of the others one each is kept, and in the text
  "fringe, symbol of the core, fringe" of all of them each string of ``reach + 1`` symbols stands for one string of
  ``length`` bytes. Suffix arrays of these texts put equal ones side by side.
* More than ``bucket_limit`` different surroundings of a core are split before they are gathered: a string around it covers
  half of the reach before the core or half of it behind. So they meet by the core with either half, twice but with half
  the reach, until the parts are small or nothing is left that could differ.

Only anchors (about ``2 / (reach + 2)`` of the bytes) and the fringes of shared cores are shuffled. 64-bit hashes of core
and surroundings together, or core and halves, must agree; a document is known by a 64-bit hash of id and text.

Defined results: null or short texts have no repeats; rows that repeat an id and a text are documents of their own, so
their long strings repeat; strings overlap freely, in one document too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import arrow_map, stored

GRAM = 16
_BYTE = np.random.Generator(np.random.PCG64(20161)).integers(1, 1 << 63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def suffix_array(text: str) -> list[int]:
    """Starts of the suffixes of ``text`` in ascending order."""
    n = len(text)
    if not n:
        return []
    members: dict[int, set[int]] = {}
    at: dict[str, int] = {}
    start = 0
    places: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    group, ends = [0] * n, {}
    for c in sorted(places):
        at[c] = start
        own = places[c]
        members[start] = set(own)
        for i in own:
            group[i] = start
        start += len(own)
        ends[start - 1] = at[c]
    # previous smaller suffix; -1: none. Hops skip what is known to lie in higher groups.
    previous, hop = [-1] * n, [-1] * n
    last = n - 1
    while last >= 0:
        now = ends[last]
        pointers: dict[int, int] = {}
        for i in sorted(members[now]):
            j, passed = i - 1, []
            while j >= 0 and group[j] >= now:
                passed.append(j)
                j = hop[j]
            for p in passed:
                hop[p] = j
            previous[i] = hop[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, count in pointers.items():
            moved.setdefault((-count, group[j]), []).append(j)
        for key in sorted(moved):
            old, some = key[1], moved[key]
            rest = members[old]
            if len(some) == len(rest):
                continue
            end = old + len(rest) - 1
            new = end - len(some) + 1
            rest.difference_update(some)
            members[new] = set(some)
            ends[end], ends[new - 1] = new, old
            for j in some:
                group[j] = new
        last = now - 1
    # the end of the text, before its first symbol, is the smallest suffix: it places what ends there
    order, filled, done = [-1] * n, dict.fromkeys(members, 0), [False] * n

    def emit(j: int) -> None:
        while j >= 0 and not done[j]:
            g = group[j]
            order[g + filled[g]] = j
            filled[g] += 1
            done[j] = True
            j = previous[j]

    emit(n - 1)
    for k in range(n):
        emit(order[k] - 1)
    return order


def _anchors(data: np.ndarray, reach: int) -> np.ndarray:
    """Places with the least hash (the first of equal ones) of some ``reach + 1`` neighbouring places."""
    if len(data) < GRAM + reach:
        return np.zeros(0, np.int64)
    h, s = _BYTE[data], 1
    while s < GRAM:
        h = h[:-s] * np.uint64(pow(_BASE, s, 1 << 64)) + h[s:]
        s *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, s = reach + 1, 1
    while s * 2 <= width:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    if s < width:
        v = np.minimum(v[: len(v) - (width - s)], v[width - s :])
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batches(sizes: list[int], most: int = 1 << 21) -> Iterator[list[int]]:
    group, total = [], 0
    for i, n in enumerate(sizes):
        group.append(i)
        total += n
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("bytes"))


def _anchor_rows(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """key, pos, core, around: hashes of the core and of core and fringes at each anchor."""
    core = length - reach

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch.column("key").to_pylist(), batch.column("bytes").to_pylist()
        out_key, out_pos, out_core, out_around = [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        for rows in _batches([len(t) for t in texts]):
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            at = _anchors(data, reach)
            split = np.searchsorted(at, bounds)
            for k, i in enumerate(rows):
                t = texts[i]
                own = [a for a in (at[split[k] : split[k + 1]] - bounds[k]).tolist() if a + core <= len(t)]
                out_key += [keys[i]] * len(own)
                out_pos += own
                out_core += [digest(t[a : a + core]) for a in own]
                out_around += [digest(t[max(0, a - reach) : a + length], min(a, reach)) for a in own]
        columns = [pa.array(out_key, pa.int64()), pa.array(out_pos, pa.int32())]
        columns += [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_core, out_around)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "pos", "core", "around"])

    rows = _keyed(docs).select("key", "bytes").filter(F.octet_length("bytes") >= length)
    return arrow_map(rows, each, "key bigint, pos int, core bigint, around bigint")


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _longest_common(parts: list[bytes]) -> list[int]:
    """For each part the longest beginning that it shares with another one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for a, b in zip(order, order[1:]):
        n = _common(parts[a], parts[b])
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def _shared_windows(buckets: list[list[tuple]], reach: int, length: int) -> list[tuple[int, int, int]]:
    """(key, from, to) of repeated strings, from buckets of (key, pos, n, left, right) with one core each."""
    text, starts, owners, size = [], [], [], 0
    for b, bucket in enumerate(buckets):
        lefts = _longest_common([m[3][::-1] for m in bucket])
        rights = _longest_common([m[4] for m in bucket])
        for m, left, right in zip(bucket, lefts, rights):
            if left + right < reach:
                continue  # no string around this core is shared
            s = m[3][len(m[3]) - left :].decode("latin-1") + chr(256 + b) + m[4][:right].decode("latin-1")
            text.append(s)
            starts.append(size)
            owners.append((m, left))
            size += len(s)
    whole = "".join(text)
    valid, owner = bytearray(size), [0] * size
    for k, (s, begin) in enumerate(zip(text, starts)):
        for o in range(len(s) - reach):
            valid[begin + o] = 1
            owner[begin + o] = k
    repeated: list[int] = []
    before = -1
    for i in suffix_array(whole):
        if valid[i]:
            if before >= 0 and whole[before : before + reach + 1] == whole[i : i + reach + 1]:
                repeated += (before, i)
            before = i
    found, last = [], None
    for i in sorted(set(repeated)):
        m, left = owners[owner[i]]
        if m[2] > 1:
            continue  # several equal surroundings: known to repeat
        begin = m[1] - left + i - starts[owner[i]]
        if last and last[0] == m[0] and last[1] <= begin <= last[2]:
            last[2] = max(last[2], begin + length)
        else:
            last = [m[0], begin, begin + length]
            found.append(last)
    return [tuple(x) for x in found]


_SYMBOLS = 100_000
_CORES = 50_000  # symbols above the bytes' that one suffix array may use


def repeats(docs: DataFrame, length: int = 400, reach: int = 85, bucket_limit: int = 1000) -> DataFrame:
    """key, begin, end: byte ranges that cover all and only the bytes of repeated strings of ``length`` bytes."""
    if reach + GRAM > length:
        raise ValueError("reach and the hashed bytes must fit into the length")
    core = length - reach
    anchors = stored(_anchor_rows(docs, length, reach), "suffix-anchors")
    shared = anchors.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core")
    anchors = stored(anchors.join(shared, "core"), "suffix-shared")
    around = stored(anchors.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("one")), "suffix-around")
    equal = anchors.join(around.filter("n > 1").select("core", "around"), ["core", "around"])
    equal = equal.select("key", F.greatest(F.col("pos") - reach, F.lit(0)).alias("begin"), (F.col("pos") + length).alias("end"))
    mixed = around.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1")
    some = around.join(mixed, "core").select("one.key", F.struct("one.pos", "core", "n", "m").alias("x"))
    asked = some.groupBy("key").agg(F.collect_list("x").alias("xs"))  # anchors of one text
    known = asked.join(_keyed(docs).select("key", "bytes"), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, xs, t in zip(*(batch.column(c).to_pylist() for c in ("key", "xs", "bytes"))):
                for x in xs:
                    a = x["pos"]
                    out.append((x["core"], x["m"], key, a, x["n"], t[max(0, a - reach) : a], t[a + core : a + length]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["core", "m", "key", "pos", "n", "l", "r"])

    fringes = known.mapInArrow(cut, "core bigint, m bigint, key bigint, pos int, n bigint, l binary, r binary")
    # rows that repeat a document join to the same text: one of them is enough
    part = stored(fringes.dropDuplicates(["core", "key", "pos"]).withColumn("g", F.lit(reach)), "suffix-fringes")
    ranges = [equal.select("key", F.col("begin").cast("bigint"), F.col("end").cast("bigint"))]
    while True:
        ranges.append(_sorted(part.filter(F.col("m") <= bucket_limit), length))
        hot = part.filter(F.col("m") > bucket_limit)
        if hot.isEmpty():
            break
        same = hot.filter("g = 0 and n = 1")
        ranges.append(same.select("key", F.col("pos").cast("bigint").alias("begin"), (F.col("pos") + length).cast("bigint").alias("end")))
        part = _halves(hot.filter("g > 0"))
    return reduce(DataFrame.union, ranges)


def _halves(hot: DataFrame) -> DataFrame:
    """Members of large buckets by the core and the half of the reach behind it, and by the core and the half before it."""
    hot = hot.withColumn("h", F.expr("(g + 1) div 2").cast("int")).withColumn("k", F.col("g") - F.col("h") + 1)
    tail = lambda c, n: F.substring(c, F.greatest(F.lit(1), F.octet_length(c) - n + 1), n)
    behind = hot.filter(F.octet_length("r") >= F.col("h")).select(
        F.xxhash64("core", F.lit(1), F.substring("r", F.lit(1), F.col("h"))).alias("core"), "key", "pos", "n",
        tail("l", F.col("k") - 1).alias("l"), F.substring("r", F.col("h") + 1, F.col("g")).alias("r"), (F.col("k") - 1).alias("g"),
    )
    before = hot.filter(F.octet_length("l") >= F.col("k")).select(
        F.xxhash64("core", F.lit(2), tail("l", F.col("k"))).alias("core"), "key", (F.col("pos") - F.col("k")).alias("pos"), "n",
        F.substring("l", F.lit(1), F.octet_length("l") - F.col("k")).alias("l"), F.substring("r", F.lit(1), F.col("h") - 1).alias("r"), (F.col("h") - 1).alias("g"),
    )
    rows = stored(behind.union(before).filter(F.octet_length("l") + F.octet_length("r") >= F.col("g")), "suffix-halves")
    sizes = rows.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1")
    return stored(rows.join(sizes, "core").select("core", "m", "key", "pos", "n", "l", "r", "g"), "suffix-part")


def _sorted(few: DataFrame, length: int) -> DataFrame:
    """key, begin, end of repeated strings around the cores of buckets that a task can gather."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets: list[list[tuple]] = []
        now, reach, size = None, 0, 0

        def solved() -> pd.DataFrame:
            return pd.DataFrame(_shared_windows(buckets, reach, length), columns=["key", "begin", "end"], dtype="int64")

        for b in batches:
            for g, c, *m in zip(b["g"], b["core"], b["key"], b["pos"], b["n"], b["l"], b["r"]):
                if (g, c) != now:
                    if buckets and (size >= _SYMBOLS or len(buckets) >= _CORES or g != reach):
                        yield solved()
                        buckets, size = [], 0
                    buckets.append([])
                    now, reach = (g, c), g
                buckets[-1].append(tuple(m))
                size += reach + 1
        if buckets:
            yield solved()

    rows = few.repartition("core").sortWithinPartitions("g", "core", "key", "pos")
    return rows.select("g", "core", "key", "pos", "n", "l", "r").mapInPandas(each, "key bigint, begin bigint, end bigint")


def without_repeats(docs: DataFrame, length: int = 400, reach: int = 85, bucket_limit: int = 1000) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans (maximal removed ranges) for each row of ``docs``."""
    ranges = repeats(docs, length, reach, bucket_limit)
    ranges = ranges.groupBy(F.col("key").alias("k")).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))  # of one text
    rows = _keyed(docs).join(ranges, F.col("key") == F.col("k"), "left").select("doc_id", "bytes", "ranges")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint").fields])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, ranges in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist()):
            t, kept, spans, done = t or b"", [], 0, 0
            reached = -1
            for begin, end in sorted((r["begin"], min(r["end"], len(t))) for r in ranges or ()):
                if begin > reached:
                    kept.append(t[done:begin])
                    spans += 1
                reached = max(reached, end)
                done = reached
            kept.append(t[done:])
            rest = b"".join(kept)
            out.append((rest, len(t), len(t) - len(rest), spans))
        columns = [batch.column("doc_id"), pa.array([o[0] for o in out], pa.binary()), *(pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return arrow_map(rows, each, schema)
