"""Toxicity scores of texts whose wording may be disguised: a noisy channel is decoded before the text is scored.

* A character language model (trigram counts of letters, over every document given) says what words look like.
* A spelling with look-alike digits or signs, letters set apart, or stretched letters becomes a lattice: a sign may stand
  for itself or for the letters in ``LOOKALIKES``, a separator may be dropped or end a word, a repeated letter may be
  dropped. Viterbi decoding under the language model returns the likeliest restored words. Words without any such
  sign are taken as they are; original and restored words both count.
* Words and word beginnings get a strength, the smoothed log odds of their document frequencies in both classes, if at
  least ``min_df`` texts have them. A logistic regression of a text's strongest words, their number and their density
  gives the score. Strengths that train it come from the other half of the training texts.

``train`` learns from about ``sample`` labelled texts, chosen by a hash of their id; the language model and the scores
cover all texts. Defined results: a null or empty text has the features of no words; without both classes among the
labels every score is 0.5 or less (the share of label 1); of several labels of a document the largest counts; null labels
and null ids are not learned; rows that repeat get one row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import arrow_map

LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
_SIGNS = re.escape("".join(LOOKALIKES))
_WORD = re.compile(r"\w+")
_LEET = re.compile(rf"[\w{_SIGNS}]*(?:[^\W\d_][{_SIGNS}]+[^\W_]|[{_SIGNS}]+[^\W\d_])[\w{_SIGNS}]*")
_SPACED = re.compile(rf"(?<![^\W_])(?:[\w{_SIGNS}][ .\-_*~/]{{1,2}}){{3,}}[\w{_SIGNS}](?![^\W_])")
_STRETCHED = re.compile(r"\w*([^\W\d_])\1\1\w*")
# Arrow's matcher says fast which texts need a closer look; letters beyond Latin-1 are not looked at for stretching
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
_HINTS = (
    rf"\pL[{_SIGNS}]+[\pL\pN]|[{_SIGNS}]\pL",
    rf"(?:[\pL\pN_{_SIGNS}][ .\-_*~/]{{1,2}}){{3,3}}[\pL\pN_{_SIGNS}]",
    "|".join(c * 3 for c in _LATIN),
)
_SEPARATORS = set(" .-_*~/")
_LETTERS = 28  # 0: word boundary, 1 to 26: a to z, 27: any other letter
_CODE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.uint8)
_SLICE = 1 << 20
_WILD = 4.0  # cost of a sign read as a letter, a dropped separator or repetition (in nats)
_COSTS = {"same": 0.0, "sign": 1.0, "digit kept": 6.0, "join": 0.2, "split": 2.0, "drop repeat": 0.7, "drop double": 6.0}
_PREFIXES = (4, 5, 6, 7, 8)
_MEMO = 300_000


class CharacterModel:
    """Interpolated letter trigrams from counts of codes ``(a * 28 + b) * 28 + c``."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 1) / (c1.sum() + _LETTERS)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).tolist()

    @staticmethod
    def counts(texts: Iterable[bytes | None]) -> np.ndarray:
        """Counts over texts, taken in groups of about a megabyte; within a longer text, window by window."""
        total, group, size = np.zeros(_LETTERS**3, np.int64), [], 0
        for t in texts:
            if t:
                group.append(t)
                size += len(t)
            if size >= _SLICE:
                total += CharacterModel._counted(group)
                group, size = [], 0
        return total + CharacterModel._counted(group)

    @staticmethod
    def _counted(texts: list[bytes]) -> np.ndarray:
        total = np.zeros(_LETTERS**3, np.int64)
        raw = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)
        end = np.zeros(0, np.uint8)
        for a in range(0, len(raw), _SLICE):
            code = np.concatenate([end, _CODE[raw[a : a + _SLICE]]])
            code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]  # one boundary between words
            if len(code) > 2:
                wide = code.astype(np.int32)
                total += np.bincount((wide[:-2] * _LETTERS + wide[1:-1]) * _LETTERS + wide[2:], minlength=_LETTERS**3)
            end = code[-2:]
        return total


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def decode(spelling: str, model: CharacterModel) -> list[str]:
    """The likeliest words behind a lower-cased spelling."""
    # state: the last two codes -> (cost, letters so far as a linked list, last letter)
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None, "")}
    cost = model.cost
    runs = [len(m.group()) for m in re.finditer(r"(.)\1*", spelling) for _ in m.group()]
    for at, c in enumerate(spelling):
        drop = _COSTS["drop double" if runs[at] == 2 else "drop repeat"]
        reads: list[tuple[str, float]] = []
        if c.isalpha():
            reads = [(c, _COSTS["same"])]
        elif c in LOOKALIKES:
            reads = [(x, _COSTS["sign"] if c != "*" else _WILD) for x in LOOKALIKES[c]]
        new: dict[tuple[int, int], tuple] = {}

        def offer(key, value):
            if key not in new or value[0] < new[key][0]:
                new[key] = value

        for (a, b), (spent, path, last) in states.items():
            for x, extra in reads:
                k = _letter(x)
                offer((b, k), (spent + extra + cost[a][b][k], (path, x), x))
                if x == last:
                    offer((a, b), (spent + extra + drop, path, last))
            if c in _SEPARATORS:
                offer((a, b), (spent + _COSTS["join"], path, last))
            if not c.isalpha():
                keep = _COSTS["split"] if c not in LOOKALIKES or c in "*!" else _COSTS["digit kept"]
                end = cost[a][b][0] if b else 0.0
                offer((b if b else a, 0), (spent + keep + end, (path, " ") if b else path, ""))
        states = dict(sorted(new.items(), key=lambda x: x[1][0])[:24])
    ends = [(spent + (cost[a][b][0] if b else 0.0), n, path) for n, ((a, b), (spent, path, _)) in enumerate(states.items())]
    path, letters = min(ends)[2], []
    while path:
        path, x = path
        letters.append(x)
    return "".join(reversed(letters)).split()


def spellings(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[str]:
    """Lower-cased parts of a text that may be disguised words: with signs, set apart, stretched."""
    found = [m.group().strip("!*|+(") for m in _LEET.finditer(text)] if kinds[0] else []
    found += [m.group() for m in _SPACED.finditer(text)] if kinds[1] else []
    found += [m.group() for m in _STRETCHED.finditer(text)] if kinds[2] else []
    return [x for x in dict.fromkeys(found) if any(map(str.isalpha, x)) and len(x) > 2]


class Reader:
    """Words of texts, restored ones included, with a bounded memo of decoded spellings."""

    def __init__(self, model: CharacterModel):
        self.model, self.memo = model, {}

    def words(self, texts: pa.Array) -> Iterator[list[str]]:
        """For each text; null counts as empty."""
        low = [(t or "").lower() for t in texts.to_pylist()]
        arrow = pa.array(low, pa.large_string())
        hints = zip(*(pc.match_substring_regex(arrow, h).to_pylist() for h in _HINTS))
        for text, kinds in zip(low, hints):
            words = _WORD.findall(text)
            if any(kinds):
                for s in spellings(text, kinds):
                    words += self._restored(s)
            yield words

    def _restored(self, spelling: str) -> list[str]:
        found = self.memo.get(spelling)
        if found is None:
            found = decode(spelling, self.model)
            if len(self.memo) < _MEMO and len(spelling) < 64:
                self.memo[spelling] = found
        return found


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:n]}-" for n in _PREFIXES if len(word) > n]


class Strengths:
    """The largest strength among a word and its beginnings; memo bounded."""

    def __init__(self, table: dict[str, float]):
        self.table, self.memo = table, {}

    def of(self, word: str) -> float:
        s = self.memo.get(word)
        if s is None:
            s = max(self.table.get(f, 0.0) for f in features_of(word))
            if len(self.memo) < _MEMO:
                self.memo[word] = s
        return s

    def summary(self, words: list[str]) -> list[float]:
        known, strong = self.memo.get, []
        for w, n in Counter(words).items():
            s = known(w)
            if s is None:
                s = self.of(w)
            if s:
                strong.append((s, n))
        strong.sort(reverse=True)
        top = [s for s, _ in strong[:4]] + [0.0] * 4
        many, total = sum(n for _, n in strong), max(1, len(words))
        weight = sum(s * n for s, n in strong)
        return [top[0], top[1], top[2], top[3], math.log1p(len(strong)), math.log1p(many), math.log1p(100 * weight / total), math.log1p(weight), math.log(total)]


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_LETTERS**3, np.int64)
        for b in batches:
            total += CharacterModel.counts(b["text"])
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(each, "code bigint, n bigint")
    out = np.zeros(_LETTERS**3, np.int64)
    for code, n in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # 28**3 rows at most
        out[code] = n
    return out


def _table(counts: Iterable[tuple[str, int, int]], zeros: int, ones: int) -> dict[str, float]:
    out = {}
    for f, n0, n1 in counts:
        odds = math.log((n1 + 0.5) / (ones + 1)) - math.log((n0 + 0.5) / (zeros + 1))
        if odds > 0.7:
            out[f] = odds
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 40_000, min_df: int = 5, vocabulary: int = 50_000) -> dict:
    """Model from rows (doc_id, text) and (doc_id, toxic); the language model reads all of ``docs``."""
    spark = docs.sparkSession
    chars = character_counts(docs)
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sizes = {(r["y"], r["half"]): r["n"] for r in known.groupBy("y", (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("half")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = sum(n for (y, _), n in sizes.items() if y == 1), sum(n for (y, _), n in sizes.items() if y == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # about ``sample`` ids
    rows = rows.select("text", F.col("y").cast("int").alias("y"), (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("half"))
    model = {"chars": chars, "table": {}, "w": None, "prior": min(0.5, (ones / (ones + zeros)) if ones + zeros else 0.0)}
    if not ones or not zeros:
        return model
    lm = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharacterModel(lm.value))
        for b in batches:
            seen: dict[str, list[int]] = {}
            for words, y, half in zip(reader.words(b.column("text")), b.column("y").to_pylist(), b.column("half").to_pylist()):
                for f in {f for w in set(words) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0, 0, 0])[2 * int(half) + int(y)] += 1
            numbers = np.array(list(seen.values()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *map(pa.array, numbers.T)], names=["f", "a0", "a1", "b0", "b1"])

    sums = [F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]
    counted = rows.mapInArrow(count, "f string, a0 bigint, a1 bigint, b0 bigint, b1 bigint").groupBy("f").agg(*sums)
    one = (F.col("a1") + F.col("b1") + 0.5) / (ones + 1)
    odds = F.log(one) - F.log((F.col("a0") + F.col("b0") + 0.5) / (zeros + 1))
    counted = counted.filter(F.expr(f"a0 + a1 + b0 + b1 >= {min_df}") & (odds > 0.4))
    # ``vocabulary`` bounds what reaches the driver: the features seen most often in label 1
    kept = counted.orderBy(F.desc(F.col("a1") + F.col("b1")), "f").limit(vocabulary).collect()
    n = lambda y, half: sizes.get((y, half), 0)
    tables = {
        None: _table(((r["f"], r["a0"] + r["b0"], r["a1"] + r["b1"]) for r in kept), zeros, ones),
        False: _table(((r["f"], r["a0"], r["a1"]) for r in kept if r["a0"] + r["a1"] >= min_df / 2), n(0, False), n(1, False)),
        True: _table(((r["f"], r["b0"], r["b1"]) for r in kept if r["b0"] + r["b1"] >= min_df / 2), n(0, True), n(1, True)),
    }
    shared = spark.sparkContext.broadcast(tables)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharacterModel(lm.value))
        other = {half: Strengths(shared.value[not half]) for half in (False, True)}
        for b in batches:
            out = [other[bool(half)].summary(words) for words, half in zip(reader.words(b.column("text")), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(out, pa.list_(pa.float64()))], names=["y", "x"])

    points = rows.mapInArrow(summarise, "y int, x array<double>").toPandas()  # about ``sample`` rows
    points = points.assign(k=points["x"].map(tuple)).sort_values(["y", "k"])
    return model | {"table": tables[None], "w": _fit_logistic(np.stack(points["x"]), points["y"].to_numpy(float))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) for each row of ``docs``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded vocabulary and 28**3 numbers
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    held: list = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        if not held:
            held.extend((Reader(CharacterModel(m["chars"])), Strengths(m["table"])))
        reader, strengths = held
        if m["w"] is None:
            scores = np.full(batch.num_rows, m["prior"])
        else:
            x = np.array([strengths.summary(words) for words in reader.words(batch.column("text"))]).reshape(batch.num_rows, -1)
            scores = 1 / (1 + np.exp(-np.clip(x @ m["w"][:-1] + m["w"][-1], -35, 35))) if batch.num_rows else np.zeros(0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), each, schema)
