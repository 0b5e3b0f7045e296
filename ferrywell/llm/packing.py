"""Packing of documents into fixed windows by dynamic programming, keeping their order.

The documents of a partition form one run of tokens, each document ended by ``end_id``. Windows
are cut at the end of a document (free), at the end of a sentence, or, where a sentence is long,
every few tokens (dearest). The cheapest sequence of cuts minimises padding plus these penalties.
With ``best[j] = cut(j) + min over i of best[i] + padding(j - i)``, the inner minimum over a
window of 2048 tokens is kept in a monotone queue, so each cut enters and leaves it once.

Nothing is shuffled: partitions are packed side by side, each at the cost of one last window.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ferrywell.llm import byte_bpe

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, ids binary")


@dataclass(frozen=True)
class Costs:
    """In padded tokens. A window of a power of two needs no padding."""

    window: int = 2048
    sentence: int = 8
    inside: int = 48
    each: int = 16  # for every window, so that many short ones do not win
    stride: int = 32  # longest stretch without a cut
    least_power: int = 128  # shorter windows are only used at the end of a partition


def _whole_powers(places: np.ndarray, costs: Costs, end: int) -> Iterator[tuple[int, int]]:
    """Pairs (later, earlier) of cuts that lie a power of two apart, by the later one; short windows only beyond ``end``."""
    found = []
    for k in range(costs.window.bit_length() - 1):
        power = 1 << k
        wanted = places - power
        earlier = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        hit = places[earlier] == wanted
        if power < costs.least_power:
            hit &= places > end
        later = np.flatnonzero(hit)
        found.append((later, earlier[later]))
    later, earlier = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(later, kind="stable")
    return zip(later[order].tolist(), earlier[order].tolist(), strict=True)


def choose_cuts(places: np.ndarray, penalties: np.ndarray, costs: Costs, last: bool) -> list[int]:
    """Indexes of the cheapest cuts among ``places`` (ascending, first 0); neighbours are at most a window apart."""
    window, at, fine = costs.window, places.tolist(), penalties.tolist()
    # a window's cost is window - (place[j] - place[i]) + each, so the queue orders best[i] + place[i]
    best, back = [0] * len(at), [0] * len(at)
    exact = _whole_powers(places, costs, at[-1] - window if last else at[-1])
    later, earlier = next(exact, (len(at), 0))
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (best + place, place, index)
    for j in range(1, len(at)):
        place = at[j]
        while queue[0][1] < place - window:
            queue.popleft()
        low, _, i = queue[0]
        cost = low + window - place
        while later == j:
            if best[earlier] < cost:
                cost, i = best[earlier], earlier
            later, earlier = next(exact, (len(at), 0))
        best[j], back[j] = cost + costs.each + fine[j], i
        value = best[j] + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


@dataclass
class _Document:
    doc_id: int | None
    ids: np.ndarray
    ends: np.ndarray  # sentence ends, in ids
    done: int = 0  # ids already placed


@dataclass
class Packer:
    """Packs documents as they come, holding back the last windows of a block until more are seen."""

    costs: Costs
    first_sequence: int
    block: int = 1 << 20
    held: list[_Document] = field(default_factory=list)
    tokens: int = 0

    def add(self, document: _Document) -> Iterator[tuple]:
        self.held.append(document)
        self.tokens += len(document.ids)
        if self.tokens >= self.block:
            yield from self.flush(last=False)

    def _candidates(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        costs, kinds, begin = self.costs, [(np.zeros(1, np.int64), 0)], 0
        for d in self.held:
            left = len(d.ids) - d.done
            inner = d.ends[(d.ends > d.done) & (d.ends < len(d.ids))] - d.done
            kinds += [(begin + inner, costs.sentence), (np.array([begin + left]), 0)]
            begin += left
        places = np.concatenate([p for p, _ in kinds])
        penalties = np.concatenate([np.full(len(p), c) for p, c in kinds])
        order = np.lexsort((penalties, places))
        places, first = np.unique(places[order], return_index=True)
        penalties = penalties[order][first]
        gaps = np.diff(places)
        more = (gaps - 1) // costs.stride
        extra = np.repeat(places[:-1], more) + costs.stride * (
            np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        if last:
            tail = places[-1] - (1 << np.arange(costs.window.bit_length()))
            tail = np.concatenate([tail, places[-1] - np.arange(1, costs.stride)])
            extra = np.union1d(extra, np.setdiff1d(tail[tail > 0], places))
        places = np.concatenate([places, extra])
        penalties = np.concatenate([penalties, np.full(len(extra), costs.inside)])
        order = np.argsort(places, kind="stable")
        return places[order], penalties[order]

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        places, penalties = self._candidates(last)
        ends = places[choose_cuts(places, penalties, self.costs, last)]
        if not last:
            # what follows may still change the last few windows
            ends = ends[ends <= places[-1] - 8 * self.costs.window]
        begin, number, used, window_start = 0, 0, 0, 0
        for d in self.held:
            while d.done < len(d.ids) and number < len(ends):
                take = int(min(len(d.ids) - d.done, ends[number] - begin))
                ids = d.ids[d.done:d.done + take]
                yield (d.doc_id, d.done, take, ids, len(d.ids), self.first_sequence + number, begin - window_start)
                d.done += take
                begin += take
                if begin == ends[number]:
                    window_start, number = begin, number + 1
            used += d.done == len(d.ids)
        self.held = [d for d in self.held if d.done < len(d.ids)]
        self.tokens = sum(len(d.ids) - d.done for d in self.held)
        self.first_sequence += len(ends)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, costs: Costs = Costs(), keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts there, where it lies in which sequence, its ids.

    Null and empty texts have just the end id. Long documents fill several windows; repeated rows
    are packed each for itself. A sequence's number holds its partition's, so a task that runs again
    gives the same numbers. An empty table gives no pieces.
    """
    path = path or byte_bpe.default_path()
    schema = PIECES if keep_ids else PIECES.removesuffix(", ids binary")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokenizer = byte_bpe.load(path)
        packer = Packer(costs, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, ends = tokenizer.ids_and_sentences(text.as_py() or "")
                yield from packer.add(_Document(doc_id, np.frombuffer(ids + end, "<u4"), ends))
        yield from packer.flush(last=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 7 + [pa.binary()] * keep_ids
        names = [part.split()[0] for part in schema.split(", ")]
        rows, size = [], 0
        for doc_id, start, length, ids, total, sequence, offset in rows_of(batches):
            raw = ids.tobytes()
            rows.append((doc_id, start, length, zlib.crc32(raw), total, sequence, offset) + ((raw,) if keep_ids else ()))
            size += len(raw) if keep_ids else 64
            if size > 1 << 23:
                yield _batch(rows, types, names)
                rows, size = [], 0
        if rows:
            yield _batch(rows, types, names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
