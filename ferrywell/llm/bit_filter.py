"""A set of hashes as a bit table of fixed size, which tasks use to leave out most of what no join needs.

It lets through too much, the more the fuller it is, but never too little; the join that follows
decides. Its size is a parameter and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywell.llm.shingles import mix

BITS = 1 << 25


def _bit(columns: list[np.ndarray], bits: int) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = mix(total + column.view(np.uint64))
    return (total & np.uint64(bits - 1)).astype(np.int64)


class BitFilter:
    """Holds rows of the given long columns of a DataFrame."""

    def __init__(self, rows: DataFrame, columns: list[str], bits: int = BITS):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = np.unique(_bit([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], bits))
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 5), pa.array(1 << (bit & 31))], ["word", "bit"])

        words = (rows.select(*columns).mapInArrow(run, "word bigint, bit bigint")
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
        table = np.zeros(bits >> 5, np.uint32)
        table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
        self._bits, self._sent = bits, rows.sparkSession.sparkContext.broadcast(table)

    def lets(self, columns: list[np.ndarray]) -> np.ndarray:
        """Whether each row of these columns may be in the set."""
        bit = _bit(columns, self._bits)
        return (self._sent.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)
