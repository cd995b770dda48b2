"""Words of many texts at once as numpy arrays: places, 64-bit codes and codes of word windows.

A helper for code that runs inside tasks; every function is linear in its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 22
_MASK = (1 << 64) - 1

# Word characters by byte: all but space and tab..carriage return, or letters, digits and non-ASCII bytes.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""
    held = _powers.get("up")
    if held is None or len(held) < size:
        size = max(size, _BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes (one to one)."""
    z = codes + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class WordTable:
    """Words of `texts` (bytes), none over a text's edge: starts, ends (in `data`), text_of, first.

    `first[t]` is the number of words before text t; it has one entry more than there are texts.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray = NOT_SPACE, lower: bool = False):
        joined = b" ".join(texts)
        if lower:
            joined = joined.lower()  # bytes.lower changes A-Z only
        self.data = np.frombuffer(joined, dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = is_word[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.starts, offsets)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def codes(self) -> np.ndarray:
        """A 64-bit code for each word. Bytes are read in blocks, so temporary memory is bounded."""
        out = np.empty(len(self), dtype=np.uint64)
        low = 0
        while low < len(self):
            base = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.ends, base + _BLOCK, side="right")))
            piece = self.data[base : self.ends[high - 1]]
            up, down = _power_tables(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            weighted = piece.astype(np.uint64)
            weighted += np.uint64(1)
            weighted *= up[: len(piece)]
            np.cumsum(weighted, out=sums[1:])
            starts, ends = self.starts[low:high] - base, self.ends[low:high] - base
            out[low:high] = (sums[ends] - sums[starts]) * down[starts]
            low = high
        return mix(out)


def window_codes(codes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Code of the `width` words from each place; len(codes) - width + 1 of them, texts not regarded."""
    count = len(codes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, span, have = np.zeros(count, dtype=np.uint64), codes, 1
    done, rest = 0, width
    while rest:
        if rest & 1:
            total += span[done : done + count] * np.uint64(pow(base, done, 1 << 64))
            done += have
        rest >>= 1
        if rest:
            span = span[:-have] + span[have:] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
    return mix(total)


def whole_windows(table: WordTable, width: int) -> np.ndarray:
    """Whether the `width` words from each place lie in one text; as long as window_codes."""
    count = len(table) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=bool)
    return table.text_of[:count] == table.text_of[width - 1 :]


def to_planes(values: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane: sorted or alike values compress well so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def text_pieces(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch cut where its texts reach `size` bytes, with the texts of the piece (null: empty)."""
    low = held = 0
    texts: list[bytes] = []
    for k, text in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(text.as_py() or b"")
        held += len(texts[-1]) + 16
        if held >= size:
            yield batch.slice(low, k + 1 - low), texts
            low, held, texts = k + 1, 0, []
    if texts:
        yield batch.slice(low), texts
