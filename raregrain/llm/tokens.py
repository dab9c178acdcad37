"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker.

The tokenizer splits at white space before anything else, so a text's ids are its words' ids in order.
A slice of texts is split and its words numbered by Arrow; words made of Latin letters, then ASCII
punctuation, are cut by Arrow into the two pieces that the library's own splitter would make, and each distinct
piece goes to its BPE model; any other word goes through the library's whole pipeline. Ids of pieces are remembered between slices, up
to ``CACHE`` of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from raregrain.llm.common import text_slices

#: Pieces remembered per Python worker, about 200 bytes each.
CACHE = 1_000_000
#: Text that is encoded in one go, which takes about ten times as many bytes beside the pieces.
SLICE = 4 << 20
#: Letters that NFC leaves alone, then ASCII punctuation; both runs are one piece for the splitter.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)$"


def byte_letters() -> dict[int, str]:
    """Printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class Encoder:
    """Encodes Arrow text columns as the library does; a special token's string inside a text is that token."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}
        # the short cut holds for this kind of tokenizer only
        steps = repr(self.whole.pre_tokenizer) + repr(self.whole.normalizer)
        self.short = "Lowercase" in steps and "ByteLevel" in steps and "\\p{L}]+" in steps

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
            ids = self._keep(piece, [t.id for t in self.model.tokenize(text)])
        return ids

    def _keep(self, piece: str, ids: list[int]) -> bytes:
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        self.pieces[piece] = ids = struct.pack(f"<{len(ids)}I", *ids)
        return ids

    def word(self, word: str) -> bytes:
        """Ids of a word by the whole pipeline."""
        ids = self.pieces.get(" " + word)
        return self._keep(" " + word, self.whole.encode(word, add_special_tokens=False).ids) if ids is None else ids

    def words(self, words: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of every word."""
        if not self.short:
            return [self.word(w) for w in words.to_pylist()]
        cut = pc.extract_regex(words, _PLAIN)  # null where a word is made otherwise
        found = []
        for name in ("letters", "marks"):
            pieces = pc.utf8_lower(pc.struct_field(cut, name)).dictionary_encode()
            known = self.pieces.get
            ids = [known(p) or (self.piece(p) if p else b"") for p in pieces.dictionary.to_pylist()] + [b""]
            found.append([ids[i] for i in pc.fill_null(pieces.indices, len(ids) - 1).to_numpy().tolist()])
        parts = [a + b for a, b in zip(*found)]
        other = np.flatnonzero(cut.is_null().to_numpy(zero_copy_only=False))
        for i, word in zip(other.tolist(), words.take(pa.array(other)).to_pylist()):
            parts[i] = self.word(word)
        return parts

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids of all texts, each followed by the id ``end``; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        parts = self.words(words.dictionary)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        known = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(size))), np.frombuffer(b"".join(parts), "<u4"))
        ids = known.take(words.indices).flatten().to_numpy()
        length = size[words.indices.to_numpy()]
        ends = np.concatenate(([0], np.cumsum(length)))[bounds[1:] - bounds[0]]
        return np.concatenate(([0], ends + np.arange(1, len(ends) + 1))), np.insert(ids, ends, end)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; it lives as long as the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with a ``text`` column, with the offsets and ids of their texts."""
    for part in text_slices(batches, limit=SLICE):
        yield (part, *encoder(path).encode(part.column("text"), end))

