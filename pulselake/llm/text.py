"""Byte-level text kernels shared by the operators that run in Arrow batches.

Everything here works on one contiguous UTF-8 buffer plus document offsets, so
a whole batch is tokenised and hashed by a handful of NumPy passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit integer over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES) + 1
        inverse = pow(int(_ROOT), -1, 1 << 64)
        up = np.full(size, _ROOT, dtype=np.uint64)
        down = np.full(size, np.uint64(inverse), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets; a null document is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold at most ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends, start, total = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            ends.append((start, i))
            start, total = i, 0
        total += size
    for a, b in [*ends, (start, batch.num_rows)]:
        yield batch.slice(a, b - a)


class Words:
    """Words (maximal runs without ASCII white space) of a batch, A-Z lower-cased."""

    def __init__(self, column: pa.Array, gaps: np.ndarray = _SPACE, lower: bool = True):
        raw, self.offsets = buffer_of(column)
        self.bytes = _LOWER[raw] if lower else raw
        word = ~gaps[raw]
        n = len(raw)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        if n:
            firsts, lasts = self.offsets[:-1], self.offsets[1:] - 1
            full = lasts >= firsts
            before[firsts[full]] = False
            after[lasts[full]] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        #: of each document, the first of its words; one more entry ends the last document
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def prefix(self) -> np.ndarray:
        """Wrap-around prefix sums of the polynomial hash."""
        n = len(self.bytes)
        up, _ = _power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return total

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of the given byte ranges."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        total = self.prefix() if total is None else total
        _, down = _power_tables(len(self.bytes))
        length = (ends - starts).astype(np.uint64)
        return mix((total[ends] - total[starts]) * down[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    return mix(out)


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Of each document, the sorted distinct shingle hashes; under ``width`` words, the whole sequence is one."""
    hashes = words.hashes()
    runs = chain(hashes, width)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mix(chain(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to slices of bounded text size; empty batches pass no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield fn(part)

    return df.mapInArrow(run, schema)


def ragged(table: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``table[offsets[i]:offsets[i+1]]`` over ids; also where each piece ends."""
    sizes = (offsets[1:] - offsets[:-1])[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total, dtype=np.int64) + np.repeat(offsets[ids] - (ends - sizes), sizes)
    return table[where], ends
