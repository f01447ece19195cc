"""Whole texts to token ids, with the ``tokenizers`` library and a bounded memo of the pieces between spaces.

A byte-level BPE vocabulary with the usual word pattern never joins characters across a space that is
followed by a non-space, so texts may be cut there. Arrow cuts a batch of texts and numbers its different
pieces, each piece not seen before is encoded once, and numpy puts the ids of every text together. New
pieces that are Latin letters, alone or before one mark, go straight to the library's BPE model; others go
to the whole tokenizer. The memo is an Arrow array of pieces and flat arrays of ids, so that pieces already
known never become Python objects. Texts with white space after a space, texts that hold the string of a special
token, and texts for any other kind of tokenizer, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space after a space, for RE2.
_ODD = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Pieces of Latin letters alone, and the marks that may follow as a word of their own.
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = frozenset(".,;:!?")


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else the next code from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}


class Encoder:
    """Encodes batches of texts as unsigned 32-bit ids. ``memo`` bounds the pieces kept; beyond it the quarter met first, which holds the common ones, stays."""

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        # Texts that hold the string of an added token are encoded whole, as the library alone knows where it may join.
        self.odd = "|".join([_ODD, *(re.escape(x["content"]) for x in spec.get("added_tokens") or [])])
        self.cuts = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and model.get("type") == "BPE"
        self.model = self.library.model
        self.marks = dict(zip(_MARKS, self._whole(list(_MARKS)), strict=True))
        self.stand_in = _byte_characters()
        self.space = self.stand_in[32]
        self.bound = memo
        # The memo: pieces, all their ids one after the other, and where the ids of each begin and how many they are.
        self.pieces = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _joined(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of ids given as bytes."""
        return np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of pieces not seen before; each follows a space."""
        letters, model, stems = _LETTERS.fullmatch, self.model.tokenize, {}
        out, rest = [], []
        for k, x in enumerate(new):
            if letters(x):
                stem, mark = x, b""
            elif x[-1:] in _MARKS and letters(x[:-1]):
                stem, mark = x[:-1], self.marks[x[-1]]
            else:
                rest.append(k)
                out.append(b"")
                continue
            ids = stems.get(stem)
            if ids is None:
                shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.stand_in)
                stems[stem] = ids = array("I", [t.id for t in model(self.space + shown)]).tobytes()
            out.append(ids + mark)
        for k, ids in zip(rest, self._whole([" " + new[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of some different pieces in the memo, after learning those that it lacks."""
        if len(self.pieces) > self.bound:
            n = self.bound // 4
            self.pieces, self.starts, self.sizes = pa.concat_arrays([self.pieces[:n]]), self.starts[:n].copy(), self.sizes[:n].copy()
            self.ids = self.ids[: self.sizes.sum()].copy()
        found = pc.index_in(pieces, value_set=self.pieces.cast(pieces.type))
        lacks = found.is_null()
        new = pieces.filter(lacks)
        places = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            places[places < 0] = len(self.pieces) + np.arange(len(new))
            ids, sizes = self._joined(self._learn(new.to_pylist()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            self.pieces = pa.concat_arrays([self.pieces, new.cast(self.pieces.type)])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after the other, and where each text's ids end."""
        texts = texts.fill_null("")
        if not self.cuts:
            ids, sizes = self._joined(self._whole(texts.to_pylist()))
            return ids, np.cumsum(sizes)
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(texts, " ")
        edges = cut.offsets.to_numpy()
        numbered = cut.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges = edges - edges[0]
        index, n = numbered.indices.to_numpy().astype(np.int64), len(numbered.dictionary)
        # First pieces follow no space; of odd texts, the first piece stands for the whole and the rest for nothing.
        first = pc.list_element(cut, 0).to_pylist()
        index[edges[:-1]] = n + np.arange(len(texts))
        for k in odd.tolist():
            first[k] = texts[k].as_py()
            index[edges[k] + 1 : edges[k + 1]] = n + len(texts)
        places = self._numbers(numbered.dictionary)
        whole, lengths = self._joined([*self._whole(first), b""])
        starts = np.concatenate([self.starts[places], len(self.ids) + np.cumsum(lengths) - lengths])
        each = np.concatenate([self.sizes[places], lengths])[index]
        ends = np.cumsum(each)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - each), each)
        return np.concatenate([self.ids, whole])[take], ends[edges[1:] - 1]

    def batches(self, texts: pa.Array, end: int, rows: int = 8192, size: int = 8 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, the ids of each text and the id ``end``) of runs of ``texts``: at most ``rows`` texts, and ``size`` bytes unless one text has more."""
        weights = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(np.cumsum(weights[at : at + rows]), size, "right")))
            ids, ends = self.encode(texts.slice(at, n))
            ids = np.insert(ids, ends, end)
            yield at, np.split(ids, (ends + np.arange(1, n + 1))[:-1])
            at += n


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    return Encoder(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
