"""Runs of repeated words: suffix automaton with link-cut access.

The suffix links of a text's automaton form a tree in which the nodes from a prefix up to the root are
the suffixes of that prefix. Prefixes are taken in order, and each colours its whole path with its own
end (the access of a link-cut tree). The path then consists of segments, each coloured by the last
earlier prefix that shares it; when a segment's longest suffix is at least as long as the two ends are
apart, both occurrences touch: a square, which is then extended to its run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")
#: Gram length of the screen below.
GRAM = 3


@dataclass(frozen=True)
class Rule:
    """A run has at least ``least`` words and ``times`` periods."""

    least: int = 6
    times: int = 4


def stretches(ids: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Disjoint parts of the text that hold every run; no run reaches over their edges.

    In a run of period q all grams after the first period stood q words before, so their distance to
    the last equal gram is at most q. For each power of two, parts are kept where that distance stays
    below the next power for as long as a run of such a period lasts. This drops no run.
    """
    n = len(ids)
    if n < max(rule.least, 2):
        return []
    if min(max(rule.least, rule.times * q) - q for q in range(1, GRAM + 1)) < GRAM:
        return [(0, n)]  # the shortest runs hold no gram beyond their first period
    width = int(ids.max()) + 1
    grams = ids[:-2] * width + ids[1:-1]
    if width > 1 << 20:
        grams = np.unique(grams, return_inverse=True)[1]
    grams = grams * width + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    back = np.full(len(grams), n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    found = []
    low = 1
    while low * rule.times <= n:
        high = 2 * low - 1
        near = np.concatenate(([False], back <= high, [False]))
        edge = np.flatnonzero(near[1:] != near[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= max(1, (rule.times - 1) * low - GRAM + 1)
        found += zip((begin[long] - high).tolist(), (end[long] + GRAM - 1).tolist(), strict=True)
        low *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        begin = max(begin, 0)
        if merged and begin <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged


class SuffixAutomaton:
    """States of all substrings: ``length`` of the longest, suffix ``link``, and the state of each prefix."""

    def __init__(self, text: Sequence[int]):
        self.length, self.link, self.prefixes = [0], [-1], []
        length, link, moves = self.length, self.link, [{}]
        last = 0
        for word in text:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and word not in moves[p]:
                moves[p][word] = state
                p = link[p]
            if p >= 0:
                q = moves[p][word]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(moves[q].copy())
                    while p >= 0 and moves[p].get(word) == q:
                        moves[p][word] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
            self.prefixes.append(state)


class LastEnds:
    """The suffix-link tree cut into paths of one colour, each held in a splay tree by depth.

    The colour, which all nodes of a path share, is the end of the last prefix that passed there; it is
    kept at the splay tree's root. State s is node s + 1, and 0 stands for none.
    """

    def __init__(self, automaton: SuffixAutomaton):
        n = len(automaton.link)
        self.length = [0, *automaton.length]
        self.up = [0, *(link + 1 for link in automaton.link)]
        self.left, self.right, self.colour = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        up[p] = x
        up[x] = g
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]  # p was the root of its path

    def _splay(self, x: int) -> None:
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colour the path to the root; give each segment's earlier end and the length of its longest suffix."""
        left, right, colour, up, length = self.left, self.right, self.colour, self.up, self.length
        seen, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            if colour[x] >= 0 and length[x]:
                seen.append((colour[x], length[x]))
            if right[x]:
                colour[right[x]] = colour[x]  # the deeper part goes on as a path of its own
            right[x] = below
            below = x
            x = up[x]
        colour[below] = end
        self._splay(state + 1)
        return seen


def runs_of(ids: np.ndarray, rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = []
    for begin, stop in stretches(ids, rule):
        text = ids[begin:stop].tolist()
        n = len(text)
        automaton = SuffixAutomaton(text)
        ends, reached = LastEnds(automaton), {}
        for i, state in enumerate(automaton.prefixes):
            for earlier, common in ends.access(state, i):
                period = i - earlier
                if period > common or reached.get(period, -1) >= i:
                    continue
                start, end = earlier - common + 1, i + 1
                while end < n and text[end] == text[end - period]:
                    end += 1
                reached[period] = end - 1
                if end - start >= max(rule.least, rule.times * period):
                    found.append((begin + start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's change: one document in ten ends in a repeated part. Without an id nothing changes."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a:a + p] * times)[:n - a]


def measure(words: list[bytes], rule: Rule = Rule()) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """All runs, and the words that are left when each run keeps only its first period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    runs = runs_of(ids, rule)
    if not runs:
        return runs, words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return runs, [words[i] for i in np.flatnonzero(kept).tolist()]


def _row(doc_id: int | None, words: list[bytes], rule: Rule) -> tuple:
    runs, kept = measure(words, rule)
    longest = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _mapped(docs: DataFrame, schema: str, row) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    kinds = [types[part.split()[1]] if part.split()[1] in types else pa.list_(pa.list_(pa.int64())) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [row(d, (t.as_py() or "").encode().split()) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)


def collapsed(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, the runs as (start, length, period), and the text with one period of each run left.

    Texts without a run come back as their words joined by one space, too.
    """

    def row(doc_id: int | None, words: list[bytes]) -> tuple:
        runs, kept = measure(words, rule)
        return doc_id, [list(r) for r in runs], b" ".join(kept).decode()

    return _mapped(docs, "doc_id bigint, runs array<array<bigint>>, text string", row)


def detect(docs: DataFrame, rule: Rule = Rule(), change=rewritten) -> DataFrame:
    """One row per row of ``docs``, in the form of the contract; ``change`` is applied to the words first.

    Null and empty texts have no runs: n_runs is 0, the longest run's columns are null, both digests are
    those of an empty string. Rows without an id are measured unchanged; repeated rows each get the
    result. A text is handled as a whole by the task that reads it, with memory in proportion to its
    longest stretch that may hold runs. Of equally long runs the first counts, then the one with the
    smaller period. An empty table gives no rows; other columns, whatever their names, are not read.
    """
    return _mapped(docs, SCHEMA, lambda doc_id, words: _row(doc_id, change(words, doc_id), rule))
