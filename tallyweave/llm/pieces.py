"""SentencePiece byte-pair encoding in vectorised merge rounds, and decoding.

The ids are those of the sentencepiece library for models of kind BPE with byte fallback whose normaliser keeps a text as it
is, but for a leading word mark and word marks in place of blanks. Texts are cut into words wherever two neighbouring
characters occur in no piece of the vocabulary, since no merge can reach over such a place. The distinct words of a slice of
texts are merged together: their symbols lie in one flat array, a segmented minimum gives each word's best pair, all
occurrences of that pair are merged from the left, the arrays are compacted, and words without a pair leave, until none is left.

The library merges one pair at a time. Merging all occurrences at once gives the same unless a symbol made on the way would
form a pair that is at least as good; a word where that happens gets its leftmost merge alone in this round. Blanks are the
only such case in practice, because their runs share one score; runs are cut beforehand where the longest run piece closes.

Defined results: null counts as an empty text, which gives the begin and end ids alone. Characters outside the vocabulary give
their UTF-8 bytes. Texts of any length are taken in parts of about a megabyte, cut before a blank. Strings of special tokens
inside a text are ordinary text. Rows are independent: repeated rows give repeated results, other columns pass through.
Decoding gives what the library's ``decode`` gives, also for ids that no text gives: control ids vanish, bytes that are no
UTF-8 become U+FFFD one by one, the unknown id its sign; ids outside the vocabulary raise ``ValueError``.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNKNOWN = " ⁇ "
SLICE = 1 << 20
_NONE = np.iinfo(np.int32).max
_BEFORE_MARK = re.compile(f"[^{MARK}](?={MARK})")
_loaded: dict[str, "PieceModel"] = {}

codecs.register_error("one-each", lambda e: ("�" * (e.end - e.start), e.end))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size, self.begin, self.end, self.unknown = model.vocab_size(), model.bos_id(), model.eos_id(), model.unk_id()
        pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.control = np.array([model.is_control(i) for i in range(self.size)])
        self.bytes = np.zeros(256, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(pieces[i][1:-1], 16)] = i
        normal = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        known = {pieces[i]: i for i in normal}

        chars = sorted({c for p in known for c in p})
        # a symbol is a piece's id, or the vocabulary's size and a code point
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        for c in chars:
            if c in known:
                self.symbol[ord(c)] = known[c]
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in known:
            at = self.letter[[ord(c) for c in p]]
            self.together[at[:-1], at[1:]] = True

        self.base = self.size + 0x110000
        part = lambda p: known.get(p, self.size + ord(p) if len(p) == 1 else None)
        rank = dict(zip(normal, np.unique([-model.get_score(i) for i in normal], return_inverse=True)[1].tolist()))
        pairs = [
            (left * self.base + right, rank[i], i)
            for p, i in known.items()
            for k in range(1, len(p))
            if (left := part(p[:k])) is not None and (right := part(p[k:])) is not None
        ]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.rank = np.array([p[1] for p in pairs] + [_NONE], np.int32)
        self.into = np.array([p[2] for p in pairs] + [0], np.int32)

        surface = [b"" if model.is_control(i) else bytes([int(pieces[i][1:-1], 16)]) if model.is_byte(i) else pieces[i].replace(MARK, " ").encode() for i in range(self.size)]
        if self.unknown >= 0:
            surface[self.unknown] = UNKNOWN.encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.marked = np.zeros(self.size, bool)
        self.marked[[i for i in normal if pieces[i].startswith(MARK)]] = True
        # runs of the mark: a longest piece that closes before the rest of the run is touched
        longest = max((len(p) for p in known if not p.strip(MARK)), default=1)
        self.run = 0
        if longest > 1:
            ids = self._words([MARK * (2 * longest)])[0]
            self.run = longest if ids.tolist() == [known[MARK * longest]] * 2 else 0

    @classmethod
    def shared(cls, path: str) -> "PieceModel":
        """One model for all tasks of a Python worker."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs of symbols."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, wanted)
        found = self.keys[at] == wanted
        return np.where(found, self.rank[at], _NONE), self.into[at]

    def merged(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, ``word`` rising along them -> symbols after all merges, with their words."""
        out_symbols, out_words = [symbols[:0]], [word[:0]]
        rank = np.full(len(symbols), _NONE, np.int32)
        into = np.zeros(len(symbols), np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], into[inside] = self._pair(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = low != _NONE
            if not live.all():
                out_symbols.append(symbols[~live])
                out_words.append(word[~live])
                symbols, word, rank, into, low = symbols[live], word[live], rank[live], into[live], low[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == low)
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), order, 0))
            at = at[(order - run) % 2 == 0]
            symbols, word, rank, into = self._round(symbols, word, rank, into, low, at)
        symbols, word = np.concatenate(out_symbols), np.concatenate(out_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _round(self, symbols, word, rank, into, low, at):
        """Merge the pairs at ``at``; words in which a pair on the way would come first get their first merge alone."""
        n = len(symbols)
        first = np.append(True, word[at[1:]] != word[at[:-1]])
        several = ~first | np.append(~first[1:], False)
        if several.any():
            new = symbols.copy()
            new[at] = into[at]
            some, right = at[several], at[several] + 2
            ok = (right < n) & (word[np.minimum(right, n - 1)] == word[some])
            bad = np.zeros(len(some), bool)
            bad[ok] = self._pair(new[some[ok]], symbols[right[ok]])[0] <= low[some[ok]]
            gone = np.zeros(n, bool)
            gone[at + 1] = True
            left = some - 1
            left = np.where((left >= 0) & gone[left], left - 1, left)
            ok = (left >= 0) & (word[np.maximum(left, 0)] == word[some])
            bad[ok] |= self._pair(new[left[ok]], new[some[ok]])[0] <= low[some[ok]]
            if bad.any():
                at = at[first | ~np.isin(word[at], word[some[bad]])]
        keep = np.ones(n, bool)
        keep[at + 1] = False
        symbols = symbols.copy()
        symbols[at] = into[at]
        place = (np.cumsum(keep) - 1)[at]
        symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
        again = np.unique(np.concatenate([place, place[place > 0] - 1]))
        rank[again] = _NONE
        again = again[again < len(symbols) - 1]
        again = again[word[again] == word[again + 1]]
        rank[again], into[again] = self._pair(symbols[again], symbols[again + 1])
        return symbols, word, rank, into

    def _ids(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of merged symbols, characters without a piece as their bytes, and how many each word has."""
        code = symbols.astype(np.int64) - self.size
        size = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        ids = np.repeat(symbols, size)
        odd = np.flatnonzero(code >= 0)
        if len(odd):
            begin = (np.cumsum(size) - size)[odd]
            for length, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
                some = size[odd] == length
                c, at = code[odd[some]], begin[some]
                ids[at] = self.bytes[lead | c >> 6 * (length - 1)]
                for k in range(1, length):
                    ids[at + k] = self.bytes[0x80 | c >> 6 * (length - 1 - k) & 0x3F]
        return ids, np.bincount(word, weights=size, minlength=words).astype(np.int64)

    def _words(self, words: list[str]) -> list[np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        number = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        ids, sizes = self._ids(*self.merged(self.symbol[codes], number), len(words))
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _cuts(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether a word begins at each character; a text begins at each bound."""
        letter = self.letter[codes]
        cut = np.append(True, ~self.together[letter[:-1], letter[1:]])
        cut[bounds[bounds < len(codes)]] = True
        blank = codes == ord(MARK)
        if self.run and (blank[1:] & blank[:-1]).any():
            begins = cut | np.append(True, blank[1:] != blank[:-1])
            begin = np.flatnonzero(begins)
            size = np.diff(np.append(begin, len(codes)))
            long = blank[begin] & (size > self.run)
            blocks = (size[long] - 1) // self.run
            cut[np.repeat(begin[long], blocks) + self.run * (_ragged(np.zeros(len(blocks), np.int64), blocks) + 1)] = True
        return cut

    def encode_parts(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose blanks are marks already; no begin or end."""
        whole = "".join(parts)
        if not whole:
            return [np.zeros(0, np.int32) for _ in parts]
        codes, raw = np.frombuffer(whole.encode("utf-32-le"), np.uint32), whole.encode()
        bounds = np.cumsum([0] + [len(p) for p in parts])
        starts = np.flatnonzero(self._cuts(codes, bounds))
        at_byte = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[starts], len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at_byte), pa.py_buffer(raw)).dictionary_encode()
        which, distinct = words.indices.to_numpy(), len(words.dictionary)
        seen = np.zeros(distinct, np.int64)
        seen[which[::-1]] = np.arange(len(which))[::-1]
        sizes = np.diff(np.append(starts, len(codes)))[seen]
        symbols = self.symbol[codes[_ragged(starts[seen], sizes)]]
        ids, count = self._ids(*self.merged(symbols, np.repeat(np.arange(distinct, dtype=np.int32), sizes)), distinct)
        begin = np.cumsum(count) - count
        out = ids[_ragged(begin[which], count[which])]
        before = np.append(0, np.cumsum(count[which]))[np.searchsorted(starts, bounds)]
        return [out[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit numbers."""
        out: list[list[np.ndarray]] = [[np.array([self.begin], "<u4")] for _ in texts]
        waiting: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(waiting, self.encode_parts([p for _, p in waiting])):
                out[i].append(ids.astype("<u4"))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in _parts(MARK + text.replace(" ", MARK)) if text else ():
                waiting.append((i, part))
                size += len(part)
                if size >= SLICE:
                    flush()
                    size = 0
        flush()
        return [np.concatenate([*ids, np.array([self.end], "<u4")]) for ids in out]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {self.size}")
        ids = ids.astype(np.int64)
        control = self.control[ids]
        shown = np.flatnonzero(~control)
        if not len(shown):
            return ""
        raw = self.surface[_ragged(self.surface_start[ids], self.surface_size[ids])]
        if control[shown[0] : shown[-1]].any():  # bytes on both sides of a control id are no character
            ends = np.cumsum(self.surface_size[ids])[control]
            text = "".join(part.tobytes().decode("utf-8", "one-each") for part in np.split(raw, ends))
        else:
            text = raw.tobytes().decode("utf-8", "one-each")
        return text[1:] if self.marked[ids[shown[0]]] else text


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``SLICE`` characters, cut before a mark behind another character."""
    begin = 0
    while len(text) - begin > SLICE and (found := _BEFORE_MARK.search(text, begin + SLICE)):
        yield text[begin : found.end()]
        begin = found.end()
    yield text[begin:]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE`` bytes of the column whose sizes are given."""
    before, begin = np.append(0, np.cumsum(sizes)), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(before, before[begin] + SLICE, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``ids``, if not given) and the ids of ``text``: little-endian unsigned 32-bit numbers in one binary value."""
    keep = [c for c in df.columns if c != ids] if keep is None else keep
    fields = [df.schema[c] for c in keep]
    place = df.columns.index(text)
    places = [df.columns.index(c) for c in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.shared(path)
        for batch in batches:
            for some in _slices(batch, _sizes(batch.column(place))):
                found = [x.tobytes() for x in model.encode(some.column(place).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in places), pa.array(found, pa.binary())], names=[*keep, ids])

    return df.mapInArrow(each, T.StructType([*fields, T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns but ``text``, and the text of the ids; null ids give null."""
    keep = [c for c in df.columns if c != text]
    place = df.columns.index(ids)
    places = [df.columns.index(c) for c in keep]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.shared(path)
        for batch in batches:
            for some in _slices(batch, _sizes(batch.column(place))):
                found = [None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in some.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in places), pa.array(found, pa.string())], names=[*keep, text])

    return df.mapInArrow(each, T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())]))


def digests(df: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, n_tokens, and digests of the ids and of the text decoded from them."""
    found = decode(encode(df.select(id_column, "text"), path, keep=[id_column]), path)
    return found.select(
        id_column,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
