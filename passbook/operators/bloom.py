"""A Bloom filter of a batch's keys, to leave out history that cannot meet them.

The bits are set by an aggregate with map-side combine and fetched as one array of a proven
size; a pandas function tests them. What passes is joined exactly, so a false hit costs a row
in a shuffle and no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key and hashes of it: one key in a hundred passes by chance.
BITS_PER_KEY, HASHES = 10, 7
#: Keys of a batch up to which its filter is made; it has 10 MB then.
MOST_KEYS = 8 << 20


def _places(key: str, size: int) -> Column:
    """The bits of a key among ``size``."""
    first, second = F.pmod(F.xxhash64(key), F.lit(size)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(size))
    return F.array(*(F.pmod(first + i * second, F.lit(size)) for i in range(HASHES)))


def only_met(rows: DataFrame, keys: DataFrame, key: str, most_keys: int = MOST_KEYS) -> DataFrame:
    """``rows`` without most of those whose ``key`` is in no row of ``keys``; all of them where
    there are more than ``most_keys`` keys, too many for a filter that every task holds."""
    n = keys.count()
    if n > most_keys:
        return rows
    spark = rows.sparkSession
    words = max(1, n * BITS_PER_KEY // 64 + 1)
    bit = F.explode(_places(key, words * 64)).alias("bit")
    word = F.shiftright("bit", 6).alias("word")
    value = F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("value")
    bits = np.zeros(words, np.int64)
    for at, held in keys.select(bit).groupBy(word).agg(value).collect():  # no more rows than words
        bits[at] = held
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def held_by(places: pd.Series) -> pd.Series:
        at = np.stack(places.to_numpy()).astype(np.int64) if len(places) else np.zeros((0, HASHES), np.int64)
        found = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        return pd.Series(found.all(axis=1))

    return rows.where(held_by(_places(key, words * 64)))
