"""Texts on their way through a shuffle: compressed, and copies sent once per task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard

#: Keys that a task remembers to recognise copies.
REMEMBERED = 500_000
SENT = "k1 long, k2 long, packed binary"


def send_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, text) -> (k1, k2, packed) without the copies a task has sent already, so that a text with very
    many copies is sent once per task. Copies that are sent all the same must be dropped by key later."""
    seen: set = set()
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        new = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                new.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        rows = batch.take(pa.array(new, pa.int64()))
        texts = rows.column(2).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([squeeze(t) for t in texts], pa.binary())], ["k1", "k2", "packed"])


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of a column of packed ones, as bytes."""
    whole = zstandard.ZstdDecompressor().decompress
    return pa.array([whole(x) for x in column.to_pylist()], pa.large_binary())
