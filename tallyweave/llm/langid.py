"""Language identification in two steps: the language family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text (runs of characters without letters count as one space), as
frequencies. A one-versus-rest linear SVM for each family and a one-versus-one linear SVM for each pair of languages of a
family are trained on at most ``sample`` texts of each language, those with the smallest hashes of id and text; each pair
is fitted by a task of its own. ``FAMILIES`` groups languages; a language that it does not list is a family of its own.
Margins become probabilities by a logistic curve fitted to each machine's margins. The score of the predicted language is
the family's share times the language's mean share of its duels.

Defined results: a null text or one without a letter is ``und`` with score 0; without any labelled text every text is
``und``; with one learned language it is predicted with score 1; rows that repeat get one row each; ties go to the
language (or family) first in alphabetical order; null and ``und`` labels are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyweave.llm.common import arrow_map

DIMENSIONS = 1 << 12
UNDETERMINED = "und"
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
# bytes of ASCII characters that are no letter become spaces
_PLAIN = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts, each between two spaces, with the first place and the number of codes of each."""
    joined = b"".join(b" " + t + b"  " for t in texts)
    raw = _PLAIN[np.frombuffer(joined, np.uint8)]
    code = (raw[:-2] * np.uint32(40503) + raw[1:-1] * np.uint32(2654435761 & 0xFFFFFFFF) + raw[2:] * np.uint32(97)) * np.uint32(2246822519)
    code = (code >> np.uint32(20)).astype(np.uint16)
    blank = (raw[:-2] == 32) & (raw[1:-1] == 32)  # inside runs of spaces and between texts
    sizes = np.array([len(t) + 3 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keep = np.flatnonzero(~blank)
    bounds = np.searchsorted(keep, first)
    return code[keep], bounds, np.diff(np.append(bounds, len(keep)))


def _lowered(text: str | None) -> bytes:
    return text.lower().encode() if text and _LETTER.search(text) else b""


def _examples(text: bytes) -> list[bytes]:
    """The whole text and two of its passages, so that short texts are learned as well."""
    words = text.split()
    at = len(words) // 3
    return [text] + [b" ".join(words[at : at + n]) for n in (4, 16) if len(words) > n]


def _vector(text: bytes) -> tuple[bytes, bytes]:
    code, _, _ = _grams([text])
    index, count = np.unique(code, return_counts=True)
    return index.astype("<u2").tobytes(), (count / max(1, count.sum()) * 100).astype("<f4").tobytes()


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, strength: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of an L2-regularised squared-hinge SVM, by accelerated gradient steps; y is -1 or 1."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    norm = float(np.einsum("ij,ij,i->", x, x, share)) + 1.0
    step = 1.0 / (2 * norm + strength)
    w = np.zeros(d + 1, np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * share * y * slack
        grad = np.append(x.T @ pull + strength * ahead[:-1], pull.sum()).astype(np.float32)
        new, t2 = ahead - step * grad, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that suits the margins."""
    slopes = 0.5 * 2.0 ** np.arange(8)
    loss = [np.log1p(np.exp(-np.clip(s * y * margin, -30, 30))).mean() for s in slopes]
    return float(slopes[int(np.argmin(loss))])


def train(labelled: DataFrame, sample: int = 500) -> dict:
    """Machines from rows (text, lang); ``sample`` bounds the texts of each language that are learned."""
    rows = labelled.filter(F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", "text", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(lang, *_vector(e)) for text, lang in zip(b["text"], b["lang"]) for e in _examples(_lowered(text))]
            yield pd.DataFrame(out, columns=["lang", "idx", "val"])

    found = rows.select("text", "lang").mapInPandas(vectors, "lang string, idx binary, val binary").persist()
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    # a machine says which languages are its sides; a family meets all the others
    machines: list[tuple[str, list[str], list[str]]] = []
    if len(families) > 1:
        machines += [(f"family:{f}", members[f], [x for x in langs if x not in members[f]]) for f in families]
    for f in families:
        machines += [(f"{a}|{b}", [a], [b]) for a, b in combinations(members[f], 2)]
    model = {"langs": langs, "families": families, "members": members, "machines": [m[0] for m in machines]}
    model |= {"weights": np.zeros((0, DIMENSIONS + 1), np.float32), "slopes": np.zeros(0)}
    if not machines:
        found.unpersist()
        return model
    sides = [(name, lang, y) for name, plus, minus in machines for y, group in ((1, plus), (-1, minus)) for lang in group]
    plan = labelled.sparkSession.createDataFrame(sides, "machine string, lang string, y int")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(k=[hash_of(i, v) for i, v in zip(group["idx"], group["val"])]).sort_values(["lang", "k"])
        x = np.zeros((len(group), DIMENSIONS), np.float32)
        for r, (i, v) in enumerate(zip(group["idx"], group["val"])):
            x[r, np.frombuffer(i, "<u2")] = np.frombuffer(v, "<f4")
        y = group["y"].to_numpy(np.float32)
        w = fit_svm(x, y)
        return pd.DataFrame({"machine": [group["machine"].iloc[0]], "w": [w.astype("<f4").tobytes()], "slope": [_curve(x @ w[:-1] + w[-1], y)]})

    fitted = found.join(F.broadcast(plan), "lang").groupBy("machine").applyInPandas(fit, "machine string, w binary, slope double").collect()
    found.unpersist()
    by = {r["machine"]: r for r in fitted}
    model["weights"] = np.stack([np.frombuffer(by[m]["w"], "<f4") for m in model["machines"]])
    model["slopes"] = np.array([by[m]["slope"] for m in model["machines"]])
    return model


def hash_of(*parts: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"\0".join(parts))


def _decide(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and score, from the margins of all machines (texts x machines)."""
    n, langs, families = len(margins), model["langs"], model["families"]
    chance = 1 / (1 + np.exp(-np.clip(margins * model["slopes"], -30, 30)))
    at = {m: k for k, m in enumerate(model["machines"])}
    if len(families) > 1:
        fam = np.stack([chance[:, at[f"family:{f}"]] for f in families], axis=1)
        fam /= np.maximum(fam.sum(axis=1, keepdims=True), 1e-12)
    else:
        fam = np.ones((n, 1))
    best, lang, score = fam.argmax(axis=1), np.zeros(n, np.int64), np.zeros(n)
    for f, family in enumerate(families):
        rows, own = np.flatnonzero(best == f), model["members"][family]
        share = np.ones((len(rows), len(own)))
        if len(own) > 1:
            share[:] = 0
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                p = chance[rows, at[f"{a}|{b}"]]
                share[:, i] += p
                share[:, j] += 1 - p
            share /= len(own) - 1
        pick = share.argmax(axis=1)
        lang[rows] = np.array([langs.index(x) for x in own])[pick]
        score[rows] = fam[rows, f] * share[np.arange(len(rows)), pick]
    return lang, score


def _predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    lowered = [_lowered(t) for t in texts]
    weights = model["weights"]
    for group in _groups(lowered) if model["langs"] else ():
        code, bounds, sizes = _grams([lowered[i] for i in group])
        margins = np.zeros((len(group), len(weights)))
        for k, w in enumerate(weights):
            margins[:, k] = np.add.reduceat(w[code].astype(np.float64), bounds) * 100 / sizes + w[-1]
        for i, k, s in zip(group, *_decide(margins, model)):
            langs[i], scores[i] = model["langs"][k], float(s)
    pa.default_memory_pool().release_unused()
    return langs, scores


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``; only ``text`` is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines x dimensions numbers, whatever the input's size
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _predict(batch.column("text").to_pylist(), shared.value)
        columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text"), each, schema)


def _groups(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[int]]:
    """Places of texts with letters, in groups of about ``most`` bytes; a longer text is a group by itself."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            size += len(t)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def keep_identified(docs: DataFrame, model: dict, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of ``least`` or more; ``lang`` gets the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = _predict(batch.column("text").to_pylist(), shared.value)
        columns = {k: batch.column(k) for k in batch.schema.names} | {"lang": pa.array(langs, pa.string())}
        out = pa.RecordBatch.from_arrays([columns[k] for k in batch.schema.names], names=batch.schema.names)
        return out.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return arrow_map(docs, each, docs.schema)
