"""A bitmap of ids, of a size that is a parameter and doesn't grow with the input: what
it leaves out is surely absent, what it lets through is decided by a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evalquarry.llm import common, tokens

LOG_BITS = 23
SLICES = 64


def spot(ids: np.ndarray, log_bits: int = LOG_BITS) -> np.ndarray:
    return (tokens.mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - log_bits)).astype(np.int64)


def bitmap(ids: DataFrame, log_bits: int = LOG_BITS) -> np.ndarray:
    """Packed bits of the ids (one bigint column). Every task sends the slices it has set,
    these meet slice by slice, and only the union, of 2^log_bits bits, comes to the driver."""
    common.ship(ids.sparkSession)
    schema, names = "slice int, bits binary", ["slice", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log_bits, bool)
        for batch in batches:
            bits[spot(batch.column(0).drop_null().to_numpy(zero_copy_only=False), log_bits)] = True
        parts = np.packbits(bits).reshape(SLICES, -1)
        used = [i for i in range(SLICES) if parts[i].any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=names)

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(blob.as_buffer(), np.uint8)
                total[at] = total[at] | new if at in total else new
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=names)

    out = np.zeros((SLICES, (1 << log_bits) // 8 // SLICES), np.uint8)
    for row in common.in_arrow(common.in_arrow(ids, run, schema).repartition(SLICES, "slice"), either, schema).collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def present(packed: np.ndarray, ids: np.ndarray, log_bits: int = LOG_BITS) -> np.ndarray:
    at = spot(ids, log_bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
