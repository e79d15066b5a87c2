"""Deterministic randomness: every draw is a pure function of (key, stream, seed).

Results therefore do not depend on partitioning, task retries or the order of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO60 = 2.0**60


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def h60(*parts) -> Column:
    """First 60 bits of md5 over the parts joined by '|', as a long: `h60 % n` has no visible bias below 10^12 units. Strings that are not
    columns go in as F.lit."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def u01(*parts) -> Column:
    return h60(*parts) / F.lit(TWO60)


def h60_sql(*exprs: str) -> str:
    """The same function in DuckDB SQL, for the oracles."""
    return f"cast('0x'||substr(md5(concat_ws('|',{','.join(exprs)})),1,15) as bigint)"


def u01_sql(*exprs: str) -> str:
    return f"({h60_sql(*exprs)} / 1152921504606846976.0::double)"


#: P(Poisson(1) <= k), up to the last count that a 53-bit uniform can tell apart.
POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(19)])


def draws_np(codes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """codes x draws uniform 64-bit numbers, made where the rows are: two splitmix64 rounds of (code, draw). The codes are hashes of unit and seed."""
    x = codes.astype(np.uint64)[:, None] + (draws.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def poisson_np(codes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """codes x draws Poisson(1) counts."""
    return np.searchsorted(POISSON_CDF, (draws_np(codes, draws) >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


def permuted_np(at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Places x keys: where each place of 0..n-1 goes under the random permutation of every (64-bit) key, without the permutation ever being laid out. A Feistel network on the
    smallest number of bits that holds n (more rounds where the parts have few bits), walked until the place is below n."""
    rounds = 6 if n > 4096 else 24
    low = max(1, (n - 1).bit_length()) // 2
    high = max(1, (n - 1).bit_length()) - low
    shape = (len(at), len(keys))
    place = np.broadcast_to(at.astype(np.uint64)[:, None], shape).reshape(-1).copy()
    key = np.broadcast_to(keys.astype(np.uint64)[None, :], shape).reshape(-1)
    walk = np.arange(len(place)) if n > 1 else np.arange(0)
    while len(walk):
        x, k = place[walk], key[walk]
        for r in range(rounds):
            # the lower part is mixed into the upper one; then the parts change places
            a, b = (low, high) if r % 2 == 0 else (high, low)
            right = x & np.uint64((1 << a) - 1)
            z = (right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (right << np.uint64(b)) | ((x >> np.uint64(a)) ^ (z >> np.uint64(64 - b) if b else z & np.uint64(0)))
        place[walk] = x
        walk = walk[x >= np.uint64(n)]
    return place.reshape(shape).astype(np.int64)
