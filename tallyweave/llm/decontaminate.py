"""Benchmark decontamination by a hash set of normalised test n-grams, in DataFrame functions only.

Words are runs of ASCII letters, digits and all non-ASCII characters after lower-casing A-Z. A benchmark item gives one
window for each ``n`` consecutive words; an item of fewer words, but not none, is one window itself. A document word is
hit if it lies inside an occurrence of a window.

The windows form a table whose size is proven from the benchmark's length before it is broadcast; above
``broadcast_limit`` bytes the hashes meet in an ordinary join. Hits are verified word by word, so equal hashes of
different windows never count.

Defined results: a null or empty text has no words and no hits; an item without an id or without words takes no part;
items that share an id are one item; rows that repeat a document each get the same result; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import lower_ascii, stored

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_CASED_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # the same, before A-Z are lower-cased
_EMPTY_WORDS = "array<string>"
_EMPTY_HASHES = "array<bigint>"


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), f"{_GAP}+"), ""), F.array().cast(_EMPTY_WORDS))


def _gram_hashes(hashes: str, n: int) -> Column:
    """Hash of each window of n words, in order."""
    h = F.col(hashes)
    starts = F.sequence(F.lit(0), F.size(h) - n)
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    return F.when(F.size(h) >= n, window).otherwise(F.array().cast(_EMPTY_HASHES))


def _windows(benchmark: DataFrame, n: int) -> DataFrame:
    """gram, words, items: each distinct window with the ids of its items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.filter(F.col("item").isNotNull() & (F.size("w") > 0))
    length = F.least(F.lit(n), F.size("w"))
    grams = items.select(
        "item",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("words"),
    )
    return grams.groupBy("words").agg(F.collect_set("item").alias("items"))


def _exploded(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc, key, words and one row for each window hash: at, gram, length."""
    hashed = docs.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    arrays = [_gram_hashes("h", n) for n in lengths]
    flat = hashed.select("doc", "key", "words", (F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("grams"))
    # outer: an inner explode makes the optimiser repeat the hashing in a filter on the array's size
    rows = flat.select("doc", "key", "words", F.posexplode_outer("grams").alias("i", "gram"))
    at, length, before = F.col("i"), F.lit(lengths[0]), F.lit(0)
    for k, n in enumerate(lengths[:-1]):
        before = before + F.greatest(F.size("words") - n + 1, F.lit(0))
        at = F.when(F.col("i") >= before, F.col("i") - before).otherwise(at)
        length = F.when(F.col("i") >= before, F.lit(lengths[k + 1])).otherwise(length)
    return rows.select("doc", "key", "words", "gram", at.alias("at"), length.alias("length"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_limit: int = 64 << 20) -> DataFrame:
    """doc, key, at, length, items: each occurrence of a window, once; ``key`` hashes id and text of a document."""
    windows = _windows(benchmark, n)
    known = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    found_lengths = sorted((r[0] for r in windows.select(F.size("words")).distinct().collect()), reverse=True)
    lengths = found_lengths or [n]  # at most n numbers
    windows = windows.withColumn("length", F.size("words"))
    gram = F.lit(None).cast("bigint")
    for m in lengths:
        one = F.xxhash64(*[F.xxhash64(F.get("words", F.lit(k))) for k in range(m)])
        gram = F.when(F.col("length") == m, one).otherwise(gram)
    windows = windows.select(gram.alias("gram"), "length", F.col("words").alias("want"), "items")
    d = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), words_of(F.col("text")).alias("words"))
    rows = _exploded(d, lengths)
    # a window starts at each word at most and holds n of them, each with some bytes of overhead
    if known * n * 4 <= broadcast_limit:
        hits = rows.join(F.broadcast(windows), ["gram", "length"])
        real = F.slice("words", F.col("at") + 1, F.col("length")) == F.col("want")
        return hits.filter(real).select("doc", "key", "at", "length", "items")
    hits = rows.drop("words").join(windows, ["gram", "length"])
    back = hits.join(d.withColumnsRenamed({"doc": "doc2", "key": "key2"}), F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("key") == F.col("key2")))
    real = F.slice("words", F.col("at") + 1, F.col("length")) == F.col("want")
    return back.filter(real).select("doc", "key", "at", "length", "items").distinct()


def _counts(hits: DataFrame) -> DataFrame:
    """n_hit (words in any occurrence) and items, by document."""
    hits = stored(hits, "benchmark-hits")  # read twice
    spans = hits.select("doc", "key", "at", "length").distinct()
    w = Window.partitionBy("doc", "key").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("length")
    reached = F.greatest(F.col("at"), F.coalesce(F.max(end).over(w), F.lit(0)))
    n_hit = spans.select("doc", "key", F.greatest(end - reached, F.lit(0)).alias("new")).groupBy("doc", "key").agg(F.sum("new").alias("n"))
    items = hits.select("doc", "key", F.explode("items").alias("item")).distinct()
    items = items.groupBy("doc", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return n_hit.join(items, (n_hit.key == items.key) & n_hit.doc.eqNullSafe(items.doc)).select(n_hit.doc, n_hit.key, "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_limit: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit and the sorted ids of the items found, for each row of ``docs``."""
    counts = _counts(find(docs, benchmark, n, broadcast_limit)).withColumnsRenamed({"doc": "c_doc", "key": "c_key"})
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    joined = base.join(counts, (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.col("items"), F.array().cast("array<string>")).alias("items"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_limit: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no window, all columns as they are."""
    bad = find(docs, benchmark, n, broadcast_limit).select(F.col("doc").alias("__doc"), F.col("key").alias("__key")).distinct()
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__doc"))
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_limit: int = 64 << 20) -> DataFrame:
    """All rows of ``docs``; hit words, each with the characters up to the next word, are cut from ``text``."""
    hits = find(docs, benchmark, n, broadcast_limit)
    hits = hits.groupBy("doc", "key").agg(F.collect_set(F.struct("at", "length")).alias("__spans"))
    hits = hits.withColumnsRenamed({"doc": "__doc", "key": "__key"})
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__doc"))
    joined = docs.join(hits, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(f"([^{_CASED_GAP}]+[{_CASED_GAP}]*)"), F.lit(1))
    inside = lambda i: F.exists("__spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["length"]))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~inside(i)), "")
    lead = F.regexp_extract("text", f"^[{_CASED_GAP}]*", 0)
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(lead, kept))
    return joined.withColumn("text", text).select(*docs.columns)
