"""64-bit FNV-1a over bytes, many rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The start and the prime of 64-bit FNV-1a.
START, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv_of(values: list[bytes], probes: np.ndarray) -> np.ndarray:
    """Of each value followed by its probe in eight bytes, the lowest first; rows go together, a byte of each at a time."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-lengths, kind="stable")  # those that still have bytes are the first ones
    flat, starts = np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    out = np.full(len(values), START, np.uint64)
    left = lengths[order]
    for i in range(int(lengths.max(initial=0))):
        n = int(np.searchsorted(-left, -i, side="left"))
        out[:n] = (out[:n] ^ flat[starts[:n] + i]) * PRIME
    probes = probes[order].view(np.uint64)
    for i in range(8):
        out = (out ^ (probes >> np.uint64(8 * i) & np.uint64(255))) * PRIME
    back = np.empty_like(out)
    back[order] = out
    return back.view(np.int64)


def fnv(data: Column, probe: Column) -> Column:
    @F.pandas_udf("bigint")
    def hashed(values, probes):
        return pd.Series(fnv_of([bytes(v) for v in values], probes.to_numpy(np.int64)))

    return hashed(data, probe)
