"""Vectorised text work on Arrow batches: words, hashes, shingles.

Everything here runs inside tasks, on one slice of a batch at a time, and keeps no state. A slice is
a byte buffer with document offsets, taken from the Arrow string array without copying per document.
Hashes are 64 bits and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 512 << 10
LONG_UNIT = 1024
_MUL = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U64((salt + 1) * int(_MUL) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def digests(units: pa.Array) -> np.ndarray:
    """A 64-bit hash of each unit (large_binary): blocks of 8 bytes, one after the other, each mixed with all before it.

    Units over LONG_UNIT bytes, of which there are few, by BLAKE2.
    """
    _, where, body = units.buffers()
    offsets = np.frombuffer(where, np.int64)[units.offset : units.offset + len(units) + 1]
    whole = np.diff(offsets)
    length = np.where(whole > LONG_UNIT, 0, whole)
    order = np.argsort(-length, kind="stable")
    blocks = (length[order] + 7) // 8
    begin = np.cumsum(blocks) - blocks
    padded = np.zeros(8 * int(blocks.sum()), np.uint8)
    if len(padded):
        taken = np.repeat(order, length[order])
        within = np.arange(len(taken)) - np.repeat(np.cumsum(length[order]) - length[order], length[order])
        padded[np.repeat(8 * begin, length[order]) + within] = np.frombuffer(body, np.uint8)[offsets[:-1][taken] + within]
    data, out = padded.view("<u8").astype(U64), mix(length[order].astype(U64), 13)
    # longest first, so that those with a k-th block are the first ones
    for k, n in enumerate(np.cumsum(np.bincount(blocks, minlength=1)[::-1])[::-1][1:].tolist()):
        out[:n] = mix(out[:n] ^ data[begin[:n] + k], 17)
    found = np.empty(len(units), U64)
    found[order] = out
    for k in np.flatnonzero(whole > LONG_UNIT).tolist():
        found[k] = int.from_bytes(blake2b(units[k].as_buffer(), digest_size=8).digest(), "little")
    return found


class Slice:
    """Documents `first` .. `first + n` of a batch, as bytes with offsets (n + 1 of them, from 0)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")

    def folded(self) -> Slice:
        """The same with A-Z lower-cased."""
        return Slice(self.first, _FOLD[self.data], self.offsets)

    def units(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The number of each byte range's unit, and the distinct units: numbers are equal just where the bytes are."""
        length = end - start
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        body = self.data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)]
        spans = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        known = spans.dictionary_encode()
        return known.indices.to_numpy().astype(np.int64), known.dictionary

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash for each byte range, taken once for each distinct one."""
        number, units = self.units(start, end)
        return digests(units)[number]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each run of bytes that are none of 20, 09-0D."""
        if not len(self.data):
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        inside = ~_SEPARATOR[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The batch in slices of at most `limit` bytes, or of one longer document. Nulls are empty."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if not len(chunk):
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        large = pa.types.is_large_string(chunk.type)
        _, where, body = chunk.buffers()
        kind = np.int64 if large else np.int32
        offsets = np.frombuffer(where, kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
            j = min(j, len(chunk))
            yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


def bounds(document: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin: n + 1 positions."""
    return np.searchsorted(document, np.arange(n + 1))


def shingles(words: np.ndarray, document: np.ndarray, n: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each window of k words; a document of fewer words gives its whole sequence."""
    at = bounds(document, n)
    count = np.diff(at)
    weights = mix(np.arange(k, dtype=U64), 77) | U64(1)
    if len(words) >= k:
        total = sum(words[i : len(words) - k + 1 + i] * weights[i] for i in range(k))
        whole = document[: len(words) - k + 1] == document[k - 1 :]
        value, owner = mix(total[whole]), document[: len(words) - k + 1][whole]
    else:
        value, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = count[short].astype(U64)
        for i in range(k - 1):
            has = count[short] > i
            total[has] += words[at[short[has]] + i] * weights[i]
        value, owner = np.concatenate([value, mix(total, 5)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
