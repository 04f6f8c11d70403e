"""Random orders that depend on counters alone: any task can make any draw again, in any place, and so can SQL.

The key of item i in draw k of a group is SplitMix64's output number k * n + i from the group's seed; items sorted by key
are a random order. A group's seed is the start of a digest of its names.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEED = 20260716
#: Draws that one task makes at once; memory is bounded by this and the items of a group.
BLOCK = 500
# The increment and multipliers of SplitMix64.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def seed_of(*names: str) -> int:
    """60 bits of the digest of the names and the engine's seed."""
    return int(hashlib.md5("|".join([str(SEED), *names]).encode()).hexdigest()[:15], 16)


def keys(seed: int, first: int, draws: int, n: int) -> np.ndarray:
    """Keys of n items in draws first, first + 1, ...: one row a draw."""
    at = (np.arange(first, first + draws, dtype=np.uint64)[:, None] * np.uint64(n) + np.arange(1, n + 1, dtype=np.uint64)[None, :]) * np.uint64(STEP) + np.uint64(seed)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(FIRST)
    at = (at ^ (at >> np.uint64(27))) * np.uint64(SECOND)
    return at ^ (at >> np.uint64(31))


def orders(seed: int, first: int, draws: int, n: int) -> np.ndarray:
    """In each row the items of one draw, in random order."""
    return np.argsort(keys(seed, first, draws, n), axis=1, kind="stable")


def keys_sql(seed: str, draw: str, n: str, item: str) -> str:
    """The key as a DuckDB expression; ``item`` counts from 0 and ``seed`` is an unsigned number of 60 bits."""
    whole = "18446744073709551615::UHUGEINT"
    z = f"(({seed})::UHUGEINT + (({draw})::UHUGEINT * ({n})::UHUGEINT + ({item} + 1)::UHUGEINT) * {STEP}::UHUGEINT) & {whole}"
    for shift, factor in ((30, FIRST), (27, SECOND)):
        z = f"list_transform([{z}], lambda z: (xor(z, z >> {shift}) * {factor}::UHUGEINT) & {whole})[1]"
    return f"list_transform([{z}], lambda z: xor(z, z >> 31))[1]"


def seed_sql(*names: str) -> str:
    return f"('0x' || substr(md5({' || \'|\' || '.join([f"'{SEED}'", *names])}), 1, 15))::UBIGINT"
