"""Many texts as one flat array of code points, and spans of it hashed and made distinct at once.

Used inside tasks on Arrow batches. Spans of up to SHORT code points are told apart by 64-bit
hashes; longer ones by the text itself, so that no crafted text can make two of them equal.
"""

from __future__ import annotations

import numpy as np

SHORT = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_CHUNK = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _CHUNK + SHORT), _powers(_INVERSE, _CHUNK + SHORT)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def short_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of up to SHORT items; spans ascend and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(starts, at + _CHUNK, side="left"))
        j = max(j, i + 1)
        stop = int(ends[j - 1])
        piece = mix(flat[at:stop].astype(np.uint64) + np.uint64(1)) * _UP[: stop - at]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out


class Spans:
    """Distinct spans of a batch: `which` maps each span to its distinct one, `first` to an example."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.flat, self.starts, self.ends = flat, starts, ends
        lengths = ends - starts
        self.hashes = np.zeros(len(starts), dtype=np.uint64)
        short = lengths <= SHORT
        if short.all():
            self.hashes = short_hashes(flat, starts, ends)
        else:
            self.hashes[short] = short_hashes(flat, starts[short], ends[short])
        self.unique, self.first, self.which = np.unique(self.hashes, return_index=True, return_inverse=True)
        if not short.all():
            self._tell_long(np.flatnonzero(~short))

    def _tell_long(self, long: np.ndarray) -> None:
        keep = self.unique != 0
        if not keep.all() and (self.hashes[self.first[~keep]] == 0).all():
            # the placeholder hash of long spans
            shift = np.cumsum(keep) - 1
            self.which = shift[self.which]
            self.unique, self.first = self.unique[keep], self.first[keep]
        seen: dict[bytes, int] = {}
        more = []
        for i in long:
            raw = self.flat[self.starts[i]:self.ends[i]].tobytes()
            if raw not in seen:
                seen[raw] = len(self.first) + len(more)
                more.append(i)
            self.which[i] = seen[raw]
        self.first = np.concatenate([self.first, np.array(more, dtype=self.first.dtype)])
        self.unique = np.concatenate([self.unique, np.zeros(len(more), dtype=np.uint64)])

    def text(self, k: int) -> str:
        i = self.first[k]
        return self.flat[self.starts[i]:self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


def byte_batches(batches, column: str, most: int = 2 << 20):
    """Record batches cut so that each holds about `most` bytes of text, or one row."""
    for batch in batches:
        at = 0
        lengths = np.fromiter((0 if x is None else x for x in _lengths(batch, column)), dtype=np.int64, count=batch.num_rows)
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _lengths(batch, column: str):
    import pyarrow.compute as pc

    return pc.binary_length(batch.column(column)).to_pylist()
