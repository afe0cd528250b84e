"""Arrays as bytes, for rows that carry a block's share of a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SENT = "bin int, block long, kind int, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in byte planes, high bytes being mostly zero; the first 8 bytes are the first's length."""
    small, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        body = small.compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes()) if len(raw) else b""
        out.append(np.array([len(raw), len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    small, at, out = zstandard.ZstdDecompressor(), 0, []
    for kind in kinds:
        n, size = (int(x) for x in np.frombuffer(body, np.int64, 2, at))
        at += 16
        kind = np.dtype(kind)
        if n:
            raw = np.frombuffer(small.decompress(body[at:at + size], max_output_size=n * kind.itemsize), np.uint8)
            out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel())
        else:
            out.append(np.zeros(0, kind))
        at += size
    return out


def sent(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (bin, block, kind, payload)."""
    bins, blocks, kinds, payloads = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(bins, pa.int32()), pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())],
        names=["bin", "block", "kind", "payload"])
