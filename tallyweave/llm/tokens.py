"""Whole-text tokenisation in Arrow batches with a memo of pieces.

Texts are cut where no token can reach over: files of kind ``word`` (lower case, white space dropped) at ASCII white
space; files of kind ``byte`` (byte-level BPE whose pattern gives a word its leading space) before a space and around a
line end, if no two white-space characters stand together, else before a space behind a character that is no white space.
So the ids of the pieces are the ids of the whole text. For ``word`` files A-Z are lower-cased first, unless combining marks
occur, and a comma or full stop at the end of a word is cut off where no other sign precedes it.

Pieces of a batch are made distinct by Arrow; the tokenizer sees those that a worker's memo of at most ``MEMO`` pieces
doesn't know, many in one text with separators that have a token of their own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 150_000
_LONGEST = 40
_GROUP = 1 << 22
_TOGETHER = 256
_SEPARATOR = {"word": " \x01 ", "byte": "<|endoftext|>"}
_BYTE_PIECES = re.compile(r"\s*\S+(?:(?! )\s+\S+)*|\s+")
_COMBINING = r"[\x{300}-\x{36f}]"
_SIGNS = r"[^\pL\pN\s][.,]"  # one token, so not cut
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
_loaded: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit (or 32-bit, for large vocabularies) numbers."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.memo = Tokenizer.from_file(path), kind, {}
        # what these files normalise (case, composition, white space) doesn't occur in lower-cased ASCII pieces
        self.plain = Tokenizer.from_file(path) if kind == "word" else self.tokenizer
        if kind == "word":
            self.plain.normalizer = None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        found = self._ids(_SEPARATOR[kind])
        self.separator = int(found[0]) if len(found) == 1 else None

    @classmethod
    def shared(cls, path: str, kind: str) -> "Encoder":
        """One encoder for all tasks of a Python worker."""
        if (path, kind) not in _loaded:
            _loaded[path, kind] = cls(path, kind)
        return _loaded[path, kind]

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        out, separator = {}, _SEPARATOR[self.kind]
        mark, simple, other = separator.strip(), [], []
        for p in pieces:
            if self.separator is None or mark in p or "<|" in p:
                out[p] = self._ids(p).tobytes()
            elif self.kind == "word" and p.isascii() and p.islower():
                simple.append(p)
            else:
                other.append(p)
        parts = [some[a : a + _TOGETHER] for some in (simple, other) for a in range(0, len(some), _TOGETHER)]
        texts, first = [separator.join(part) for part in parts], -(-len(simple) // _TOGETHER)
        found = self.plain.encode_batch_fast(texts[:first], add_special_tokens=False) + self.tokenizer.encode_batch_fast(texts[first:], add_special_tokens=False)
        for part, e in zip(parts, found):
            ids = np.asarray(e.ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.separator), len(ids)).tolist()
            raw, width, begin = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(part, ends, strict=True):
                out[p] = raw[begin * width : end * width]
                begin = end + 1
        return out

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Lists of pieces; some may be empty. Texts are not null."""
        if self.kind == "word":
            if not pc.any(pc.match_substring_regex(texts, _COMBINING)).as_py():
                texts = pc.ascii_lower(texts)
            cut = texts
            for end in (", ", ". ", ".\n"):
                cut = pc.replace_substring(cut, end, f" {end[0]} ")
            return pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _SIGNS), texts, cut))
        odd = pc.or_(pc.match_substring_regex(texts, _SPACE + _SPACE), pc.match_substring(texts, "\0"))
        if pc.any(odd).as_py():
            return pa.array([_BYTE_PIECES.findall(t) for t in texts.to_pylist()], pa.list_(texts.type))
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._pieces(pc.fill_null(texts, ""))
        encoded = lists.flatten().dictionary_encode()
        pieces, memo = encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.memo
        ids = list(map(memo.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            own = self._new([pieces[i] for i in missing])
            if len(memo) + len(own) <= MEMO:
                memo.update((p, v) for p, v in own.items() if len(p) <= _LONGEST)
            for i in missing:
                ids[i] = own[pieces[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        values = np.frombuffer(b"".join(ids), self.dtype)
        known = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(values))
        out = known.take(encoded.indices).flatten().to_numpy(zero_copy_only=False)
        pieces_before = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        ids_before = np.append(0, np.cumsum(sizes[encoded.indices.to_numpy()]))
        return out, ids_before[pieces_before]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty. Texts are taken in groups, so that memory is bounded by the longest."""
        if not len(texts):
            return []
        before = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        out, begin = [], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(before, before[begin] + _GROUP, side="right")) - 1)
            ids, bounds = self._group(texts.slice(begin, end - begin))
            out += [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            begin = end
        pa.default_memory_pool().release_unused()
        return out
