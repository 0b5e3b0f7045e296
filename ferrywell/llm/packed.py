"""Arrays dealt to tasks in packs, where single rows would be too many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = 256
PACKED = "part int, first binary, second binary, third binary"
NAMES = ["first", "second", "third"]


def packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Up to three columns, dealt by part (0 to 255): a row for each part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
    filled = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    blobs = [[c[order[a:b]].tobytes() for a, b in filled] for c in columns]
    blobs += [[b""] * len(filled)] * (len(NAMES) - len(columns))
    parts = pa.array(np.unique(part).astype(np.int32))
    return pa.RecordBatch.from_arrays([parts, *(pa.array(b, pa.binary()) for b in blobs)], ["part", *NAMES])


def dealt(packs: DataFrame) -> DataFrame:
    """All packs of a part one after the other in one task."""
    return packs.repartition("part").sortWithinPartitions("part")


def unpacked(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """The columns of one part after the other."""
    held: list[pa.RecordBatch] = []

    def columns() -> list[np.ndarray]:
        table = pa.Table.from_batches(held)
        return [np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(name)])
                for name, kind in zip(NAMES, kinds, strict=False)]

    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            if held and held[-1].column("part")[0] != one.column("part")[0]:
                yield columns()
                held = []
            held.append(one)
    if held:
        yield columns()
