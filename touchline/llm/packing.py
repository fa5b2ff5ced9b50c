"""Packed blobs for shuffles, and Arrow schemas from Spark DDL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one blob, each as byte planes, which compress."""
    parts = [np.array([len(arrays)] + [len(a) for a in arrays], np.int32).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")
    return b"".join(parts)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int32, 1)[0])
    sizes = np.frombuffer(blob, np.int32, n, 4)
    at, out = 4 + 4 * n, []
    for size, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(raw.T).reshape(-1).view(kind))
        at += size * width
    return out


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))
