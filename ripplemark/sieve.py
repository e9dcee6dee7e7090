"""Bit tables that spare rows a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table that spares rows a shuffle, at most; beyond that it spares fewer.
FILTER_BITS = 1 << 28


def _probes(key: str, words: int) -> list[tuple[str, str]]:
    """Word and bit, in SQL, of the two bits of a key."""
    return [(f"int({key} & {words - 1}L)", f"int(shiftrightunsigned({key}, 58))"), (f"int(shiftrightunsigned({key}, 22) & {words - 1}L)", f"int(shiftrightunsigned({key}, 52) & 63L)")]


class Sieve:
    """Bits of a set of keys, in one row: rows whose key is surely not among them need not meet them in a shuffle.

    keys: columns that are compared as they are; a join behind ``met`` settles what the bits wrongly let through.
    """

    def __init__(self, keys: DataFrame):
        spark = keys.sparkSession
        rows = keys.select(F.xxhash64(*(F.col(f"`{c}`") for c in keys.columns)).alias("key"))
        n, words = rows.count(), 1 << 6
        while 64 * words < 16 * n and 64 * words < FILTER_BITS:
            words *= 2
        both = [F.expr(f"struct({word} as word, shiftleft(1L, {bit}) as bit)") for word, bit in _probes("key", words)]
        found = rows.select(F.explode(F.array(*both)).alias("p")).groupBy("p.word").agg(F.bit_or("p.bit").alias("bits")).toArrow()
        table = np.zeros(words, np.int64)
        table[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.words = words
        self.row = spark.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(table))}))

    def _kept(self, rows: DataFrame, columns: tuple[str, ...], hit: bool) -> DataFrame:
        test = " and ".join(f"getbit(get(_bits, {word}), {bit}) = 1" for word, bit in _probes(f"xxhash64({', '.join(columns)})", self.words))
        return rows.join(F.broadcast(self.row), F.expr(test if hit else f"not ({test})"), "left_semi")  # one row, of FILTER_BITS at most

    def met(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows whose columns may be among the keys: all that are, few others."""
        return self._kept(rows, columns, True)

    def unmet(self, rows: DataFrame, *columns: str) -> DataFrame:
        """The other rows, none of which is among the keys."""
        return self._kept(rows, columns, False)
