"""Shannon entropy of byte strings, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of the Unicode White_Space property.
_SPACES = frozenset(
    "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
)


def _entropy_rows(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total[:, None]
        return -np.where(p > 0, p * np.log2(p), 0.0).sum(axis=1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def byte_entropies(blobs: pd.Series) -> pd.Series:
    """Bits per byte of every blob of an array."""

    def one(items):
        if items is None:
            return None
        out = []
        for b in items:
            if b is None or len(b) == 0:
                out.append(0.0)
                continue
            counts = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)[None, :]
            out.append(float(_entropy_rows(counts, np.array([len(b)]))[0]))
        return out

    return blobs.map(one)


#: Windows that are counted together: a long text is worked on in parts of this size.
BLOCK_WINDOWS = 1024


def entropy_blocks(data, size: int, step: int):
    """(number of the first window, entropies) of the `size`-byte windows taken every `step` bytes, some at a time."""
    arr = np.frombuffer(data, dtype=np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(arr, size)[::step]
    for at in range(0, len(windows), BLOCK_WINDOWS):
        some = windows[at:at + BLOCK_WINDOWS]
        n = len(some)
        flat = (np.arange(n)[:, None] * 256 + some).ravel()
        yield at, _entropy_rows(np.bincount(flat, minlength=n * 256).reshape(n, 256), np.full(n, size))


def nonspace_runes(window: bytes) -> int:
    """Characters that are not white space; a byte outside any valid sequence counts as one."""
    return sum(c not in _SPACES for c in window.decode("utf-8", "surrogateescape"))


def window_stats(size: int, step: int, min_nonspace: int, limit: float):
    """Arrow UDF: (windows, highest entropy, number of dense windows above the limit)."""

    @F.arrow_udf("windows int, max_entropy double, high int")
    def stats(text: pa.Array) -> pa.Array:
        rows = []
        for t in text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()):
            data = t.as_py() or b""
            windows, most, high = 0, 0.0, 0
            for at, e in entropy_blocks(data, size, step) if len(data) >= size else ():
                windows, most = at + len(e), max(most, float(e.max()))
                high += sum(
                    nonspace_runes(data[(at + i) * step : (at + i) * step + size]) >= min_nonspace for i in np.flatnonzero(e > limit))
            rows.append((windows, most, high))
        windows, most, high = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(windows, pa.int32()), pa.array(most, pa.float64()), pa.array(high, pa.int32())], ["windows", "max_entropy", "high"])

    return stats
