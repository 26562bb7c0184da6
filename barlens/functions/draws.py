"""Draws that depend on keys alone: 32-bit arithmetic that numpy, Spark and SQL repeat digit by digit.

A series of draws has two 32-bit seeds from the SHA-256 of its text key; a repetition mixes both with its number. Draw ``j`` at
``node`` of a repetition passes three rounds of :func:`mix32`, with the second seed between the last two, so repetitions that
happen to start alike part again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK, STEP, FACTOR = (1 << 32) - 1, 0x9E3779B9, 0x45D9F3B


def seeds(key: Column) -> tuple[Column, Column]:
    """The two seeds of a series."""
    at = lambda i: F.conv(F.substring(F.sha2(key, 256), i, 8), 16, 10).cast("bigint")
    return at(1), at(9)


def mix32(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x ^ (x >> 16)) * FACTOR) & MASK
    return x ^ (x >> 16)


def repetition_keys(first: int, second: int, repetitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix32((first + repetitions * STEP) & MASK), mix32((second + repetitions * STEP) & MASK)


def draw(one: np.ndarray, two: np.ndarray, node: int, j: np.ndarray | int) -> np.ndarray:
    """32-bit draws of repetitions with the keys ``one`` and ``two``."""
    return mix32((mix32((mix32((one + node) & MASK) + j) & MASK) + two) & MASK)


def normal(one: np.ndarray, two: np.ndarray, node: int) -> np.ndarray:
    """Standard normal draws, from the two last numbers that ``j`` can have."""
    u, v = ((draw(one, two, node, MASK - k) + 1) / (MASK + 2) for k in (1, 0))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def mix32_sql(x: str, name: str) -> str:
    """Columns that end in ``name``; each refers to the one before."""
    return f"{x} AS {name}0, xor({name}0, {name}0 >> 16) * {FACTOR} % {MASK + 1} AS {name}1, xor({name}1, {name}1 >> 16) * {FACTOR} % {MASK + 1} AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"


def keys_sql(key: str, rep: str) -> str:
    """Columns ``one`` and ``two`` of a repetition of the series with this text key."""
    at = lambda i: f"('0x' || substr(sha256({key}), {i}, 8))::BIGINT"
    return ", ".join(mix32_sql(f"({at(i)} + {rep} * {STEP}) % {MASK + 1}", n) for i, n in ((1, "one"), (9, "two")))


def draw_sql(node: str, j: str, name: str) -> str:
    """Columns that end in ``name``, a draw with the keys ``one`` and ``two``."""
    a = mix32_sql(f"(one + {node}) % {MASK + 1}", f"{name}_a")
    b = mix32_sql(f"({name}_a + {j}) % {MASK + 1}", f"{name}_b")
    return f"{a}, {b}, {mix32_sql(f'({name}_b + two) % {MASK + 1}', name)}"
