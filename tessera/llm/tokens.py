"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once.

word_bpe_49k drops white space, so its ids of a text are those of the text's pieces, one after another. Texts are cut where
no rule of that tokenizer can join what lies on both sides: at space, tab, line feed and carriage return, and between an
ASCII letter or digit or a letter of U+00C0 to U+00FF on one side and ASCII punctuation (but the apostrophe, which starts
contractions) on the other. Around any other byte nothing is cut. Pieces are encoded by the library and kept in a table of
bounded size. A text that contains the start of one of the tokenizer's special tokens goes to the library whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tessera.llm.common import SLICE_BYTES, lowered, slices

VOCABULARY = "word_bpe_49k.json"
#: Pieces, and bytes of them, kept by a Python worker before the table is emptied (about 150 bytes each and their own).
KEPT, KEPT_BYTES = 400_000, 16_000_000
SPECIAL = b"<|"


@cache
def _tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@cache
def _classes() -> np.ndarray:
    """0: white space; 1: letters and digits; 2: punctuation that may be cut off; 3: anything else."""
    out = np.full(256, 3, np.uint8)
    out[[*b" \t\n\r"]] = 0
    out[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = 1
    out[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 2
    return out


class Encoder:
    """Encodes slices of texts; keeps the ids of pieces that it has met."""

    def __init__(self, name: str = VOCABULARY):
        self.tokenizer = _tokenizer(name)
        self.word_ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.kept = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.end = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _add(self, pieces: list[bytes]) -> None:
        # a run of a to z is one word to the tokenizer, so the ids of many, encoded as one text, part at its word ends
        plain = [p for p in pieces if p.isalpha()]
        other = [p for p in pieces if not p.isalpha()]
        pieces = plain + other
        lines = [b" ".join(plain[i : i + 500]).decode() for i in range(0, len(plain), 500)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(lines + [p.decode() for p in other], add_special_tokens=False)]
        n = [np.fromiter(map(len, ids[len(lines) :]), np.int64, len(other))]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        if plain:
            last = np.flatnonzero(self.word_ends[flat[: sum(map(len, ids[: len(lines)]))]])
            n.insert(0, np.diff(last, prepend=-1))
        n = np.concatenate(n)
        assert len(n) == len(pieces)
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.index) + len(pieces) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        k = len(self.index)
        self.ids[self.end : self.end + len(flat)] = flat
        self.start[k : k + len(n)] = self.end + np.cumsum(n) - n
        self.length[k : k + len(n)] = n
        self.end += len(flat)
        self.index.update(zip(pieces, range(k, k + len(pieces)), strict=True))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in data, end to end, and their offsets."""
        n_texts = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_texts + 1, np.int64)
        kind = _classes()[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            after = lead + 1
            lead, after = lead[after < len(data)], after[after < len(data)]
            letter = (data[after] != 0x97) & (data[after] != 0xB7)
            kind[lead[letter]] = kind[after[letter]] = 1
        cut = np.zeros(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a != b) & (a < 3) & (b < 3) | (a == 0) & (b == 3) | (a == 3) & (b == 0)
        cut[off] = True
        bound = np.flatnonzero(cut)
        filled = kind[bound[:-1]] != 0
        start = bound[:-1][filled]
        ends = np.concatenate(([0], np.cumsum((bound[1:] - bound[:-1])[filled]))).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        form = (pa.BinaryArray, pa.binary()) if ends.dtype == np.int32 else (pa.LargeBinaryArray, pa.large_binary())
        pieces = form[0].from_buffers(form[1], len(start), [None, pa.py_buffer(ends), pa.py_buffer(lowered()[data[kind != 0]])])
        coded = pieces.dictionary_encode()
        code, need = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        new = [p for p in need if p not in self.index]
        size = sum(map(len, new))
        if len(self.index) + len(new) > KEPT or self.kept + size > KEPT_BYTES:
            self.clear()
            new, size = need, sum(map(len, need))
        if new:
            self._add(new)
            self.kept += size
        known = np.fromiter(map(self.index.__getitem__, need), np.int64, len(need))[code]
        n = self.length[known]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[known] - stop + n, n)]
        text_of = np.searchsorted(off, start, "right") - 1
        out = np.concatenate(([0], np.cumsum(np.bincount(text_of, n, minlength=n_texts).astype(np.int64))))
        return self._whole(data, off, ids, out)

    def _whole(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may hold a special token are encoded by the library as they are."""
        raw = data.tobytes()
        if SPECIAL not in raw:
            return ids, out
        parts, n = [], np.diff(out)
        for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
            piece = ids[out[i] : out[i + 1]]
            if SPECIAL in raw[a:b]:
                piece = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
                n[i] = len(piece)
            parts.append(piece)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(n)))

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text, encoded in parts of about SLICE_BYTES that are cut at white space."""
        blank, parts, low = np.flatnonzero(_classes()[data] == 0), [], 0
        while low < len(data):
            high = len(data)
            if high - low > SLICE_BYTES:
                k = int(np.searchsorted(blank, low + SLICE_BYTES))
                high = int(blank[k]) if k < len(blank) else high
            parts.append(self.encode(data[low:high], np.array([0, high - low]))[0])
            low = max(high, low + 1)
        return np.concatenate(parts)

    def texts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for part, data, off in slices(batch):
            if len(data) > SLICE_BYTES and SPECIAL not in data.tobytes():
                ids = self._long(data)
                yield part, ids, np.array([0, len(ids)])
            else:
                yield (part, *self.encode(data, off))


@cache
def encoder(name: str = VOCABULARY) -> Encoder:
    """This Python worker's encoder: its table serves all tasks that the worker runs."""
    return Encoder(name)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
