"""Bit arrays of bounded size that let rows pass which may have a key of a set: false passes, no false stops.

A sieve makes the rows fewer before they move; an exact join follows it. The array has the size given, whatever the
set holds: beyond that it lets more and in the end all rows pass, and the join does the work alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bits_for(n: int, most_bits: int = 1 << 27) -> int:
    return min(most_bits, 1 << max(16, (128 * n).bit_length()))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))


def build(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """The words of a sieve over a bigint column; bits is a power of two. Set bits are united by word in the cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(bits // 64, np.uint64)
        for b in batches:
            at = places(b[key].to_numpy(np.int64), bits)
            np.bitwise_or.at(mine, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(mine)
        for i in range(0, len(used), 100_000):
            yield pd.DataFrame({"word": used[i : i + 100_000], "bits": mine[used[i : i + 100_000]].view(np.int64)})

    words = np.zeros(bits // 64, np.uint64)
    got = df.select(key).mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = places(keys, len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
