"""Public tokenizer files, and encoding of repeated units: each distinct unit of text is encoded once per worker.

A unit is a stretch of bytes whose tokens do not depend on what stands around it. The caller proves that;
here each unit is looked up by its 64-bit hash and then its bytes in a bounded per-process table, and new ones go to the
library in one batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corroborate.llm.textkit import Slice, digests

#: Distinct units that a worker keeps, and the bytes of these and of their ids; at a bound it starts anew, which costs time only.
KEPT, KEPT_BYTES = 1 << 20, 64 << 20


def path_of(name: str) -> str:
    """Where a public tokenizer file lies; a name with a slash is a path of the caller's own."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def tokenizer(name: str):
    """The library's tokenizer for a .json file, without truncation or padding, once per process."""
    if name not in _loaded:
        # Spark's tasks fill the cores already: threads of the library's own would cost CPU time and memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path_of(name))
        one.no_truncation()
        one.no_padding()
        _loaded[name] = one
    return _loaded[name]


class Growing:
    """An array that is appended to, with room that grows by half."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(max(len(values), self.n // 2), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class UnitTable:
    """Known units by hash, each with its bytes and with the start and the length of its ids in a pool.

    Hashes are kept in sorted runs of falling lengths; a new run is merged with its neighbour unless that is over
    twice as long, so a hash is moved only as often as the table doubles. A unit that is found by its hash is compared
    byte by byte; one of other bytes is encoded anew.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.start, self.length, self.pool = Growing(np.int64), Growing(np.int32), Growing(np.uint32)
        self.body, self.body_end = Growing(np.uint8), Growing(np.int64)
        self.body_end.append(np.zeros(1, np.int64))

    def _kept(self, rows: np.ndarray) -> pa.Array:
        """The bytes of the units in these rows."""
        begin, end = self.body_end.values[rows], self.body_end.values[rows + 1]
        offsets = np.concatenate(([0], np.cumsum(end - begin)))
        body = self.body.values[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)]
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def rows(self, part: Slice, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The table's row of each span; spans not yet known are encoded first."""
        number, units = part.units(start, end)
        if self.length.n + len(units) > KEPT or self.body.n + 4 * self.pool.n + units.nbytes > KEPT_BYTES:
            self.clear()
        hashes, rows = digests(units), np.full(len(units), -1, np.int64)
        # in sorted order, neighbouring searches touch the same memory
        order = np.argsort(hashes)
        asked = hashes[order]
        for keys, known in self.runs:
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            hit = keys[at] == asked
            rows[order[hit]] = known[at[hit]]
        hit = np.flatnonzero(rows >= 0)
        other = hit[~pc.equal(units.take(pa.array(hit)), self._kept(rows[hit])).to_numpy(zero_copy_only=False)]
        rows[other] = -1
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            bodies = units.take(pa.array(fresh)).to_pylist()
            ids = self.encode([b.decode("utf-8", "replace") for b in bodies])
            length = np.fromiter(map(len, ids), np.int32, len(ids))
            rows[fresh] = self.length.n + np.arange(len(fresh))
            self.start.append(self.pool.n + np.concatenate(([0], np.cumsum(length, dtype=np.int64)[:-1])))
            self.length.append(length)
            self.pool.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())))
            self.body_end.append(self.body.n + np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies))))
            self.body.append(np.frombuffer(b"".join(bodies), np.uint8))
            new = np.setdiff1d(fresh, other)
            new = new[np.unique(hashes[new], return_index=True)[1]]
            if len(new):
                self.runs.append((hashes[new], rows[new]))
            while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
                two, one = self.runs.pop(), self.runs.pop()
                keys, known = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
                order = np.argsort(keys, kind="stable")
                self.runs.append((keys[order], known[order]))
        return rows[number]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self.length.values[rows]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of all the units, one after the other."""
        length = self.length.values[rows].astype(np.int64)
        total = int(length.sum())
        jump = np.repeat(self.start.values[rows] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        return self.pool.values[jump + np.arange(total)]
