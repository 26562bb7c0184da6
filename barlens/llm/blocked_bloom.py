"""Blocked Bloom filters that Spark builds and tasks probe with numpy.

A block has four 64-bit lanes and a key sets two bits in every lane of its block, so a probe reads one cache line and most
misses end at the first lane. Filters know no false negatives; what they let through wrongly is up to the caller to remove.
Keys are 64-bit hashes that are mixed well (:func:`barlens.llm.common.mix64`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import mix64

LANES = 4
BLOCK_BYTES = 8 * LANES
#: Keys of a block; at 16 bits a key about one wrong probe in a thousand passes.
KEYS = 16
#: Keys probed at once: what they need stays in a core's own cache.
AT_ONCE = 1 << 14


def _masks(h: np.ndarray) -> Iterator[np.ndarray]:
    """The two bits that keys set in each lane; the first lane takes them from the key itself, the rest from its second hash."""
    one, low, bits = np.uint64(1), np.uint64(63), h
    for lane in range(LANES):
        yield (one << (bits & low)) | (one << ((bits >> np.uint64(6)) & low))
        bits = mix64(h ^ np.uint64(0x9E3779B97F4A7C15)) if not lane else bits >> np.uint64(12)


def place(h: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """The block of each key among ``blocks``."""
    return (((h >> np.uint64(32)) * np.asarray(blocks, np.uint64)) >> np.uint64(32)).astype(np.int64)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // KEYS))


def build(rows: DataFrame, blocks: int, keys: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The filter of ``blocks`` blocks, shaped ``(blocks, LANES)``; ``keys`` gives hashes and their blocks for a batch of rows.

    Tasks combine their keys first; what reaches the driver is the filter, whose size the caller has set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, at = keys(b)
            if not len(h):
                continue
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            yield pd.DataFrame({"at": at[start], **{f"l{k}": np.bitwise_or.reduceat(m, start).view(np.int64) for k, m in enumerate(_masks(h))}})

    schema = ", ".join(["at bigint", *(f"l{k} bigint" for k in range(LANES))])
    made = rows.mapInPandas(run, schema).groupBy("at").agg(*(F.bit_or(f"l{k}").alias(f"l{k}") for k in range(LANES))).toArrow()
    out = np.zeros((blocks, LANES), np.uint64)
    at = made["at"].to_numpy()
    for k in range(LANES):
        out[at, k] = made[f"l{k}"].to_numpy().view(np.uint64)
    return out


def passing(bits: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the keys that the filter may hold, given the block of each."""
    out = [np.empty(0, np.int64)]
    for i in range(0, len(h), AT_ONCE):
        some, where = h[i : i + AT_ONCE], at[i : i + AT_ONCE]
        mask = next(_masks(some))
        alive = np.flatnonzero((bits[where, 0] & mask) == mask)
        lanes, good = bits[where[alive]], np.ones(len(alive), bool)
        for k, mask in enumerate(_masks(some[alive])):
            if k:
                good &= (lanes[:, k] & mask) == mask
        out.append(i + alive[good])
    return np.concatenate(out)
