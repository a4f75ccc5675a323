"""Integer arrays as compressed bytes, by byte planes, so that small values and differences take little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpack(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype=dtype)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def differences(values: np.ndarray) -> np.ndarray:
    """Differences modulo the type's size; a cumulative sum of the type undoes them."""
    out = values.copy()
    out[1:] -= values[:-1]
    return out
