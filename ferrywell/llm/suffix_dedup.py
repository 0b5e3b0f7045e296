"""Removal of long strings that occur more than once, with a family of sparse suffix arrays.

**Suffixes.** Not every suffix is indexed but those at *anchors*: positions whose 64-byte string has
the least hash among all that start in some stretch of 337 positions. Any 400 bytes contain such
a stretch, so two equal strings of 400 bytes have an anchor at the same place in both. An entry of the
index holds the hash of the suffix's first 64 bytes (the sort key, so equal beginnings are
neighbours), the place, and a hash of the anchor's whole context: all bytes of any 400-byte string around it.

**Index family.** Each batch of texts gives one sorted run. It is merge-scanned against itself and
the existing levels for keys that occur again; then levels of equal size merge into one of the
next size. So there are as many levels as the logarithm of the number of batches.

**Matches.** Entries with equal contexts repeat wholly. Entries with equal keys but different contexts
repeat as far as the 400-byte strings around the anchor do, which is found by comparing the hashes of
all 337 of them. A key with very many contexts is not compared in one task: the hashes are dealt out
by their value. There, each ``GROUP`` of neighbouring strings is first compared by what they have in common and by
all that they cover. If no other context has the first, none of them repeats; if another has the second, all
do, and one such context stands for the others. Strings are compared by 64-bit hashes modulo 2**64, in documents at any place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywell.llm.bit_filter import BitFilter
from ferrywell.llm.columns import nested
from ferrywell.llm.packed import PACKED, PARTS, dealt, packed, unpacked
from ferrywell.llm.shingles import VALUES, _powers, mix
from ferrywell.llm.staging import Step, staged
from ferrywell.session import Folder, new_folder

LENGTH, GRAM = 400, 64
SPAN = LENGTH - GRAM + 1  # 64-byte strings in 400 bytes
LEFT = SPAN - 1  # bytes before the anchor that a 400-byte string around it can have
GROUP = 49  # neighbouring strings around an anchor, which have 352 bytes in common
#: The letters' case counts here.
BYTES = VALUES.copy()
BYTES[ord("A"):ord("Z") + 1] = VALUES[ord("a"):ord("z") + 1] ^ np.uint64(0x5851F42D4C957F2E)
STRETCH = 1 << 21
TEXT = "t string"
ENTRY = "key bigint, context bigint, t string, pos bigint, before int, after int"


@dataclass(frozen=True)
class Setting:
    batches: int = 4  # runs that a whole table is dealt into
    block: int = 4096  # most contexts of one key that one task compares


def name_of(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()[:32]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


@dataclass
class Anchors:
    """Places, keys, context hashes, and how many bytes of context there are before and after."""

    pos: np.ndarray
    key: np.ndarray
    context: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _stretch(raw: np.ndarray, begin: int, end: int) -> Anchors:
    """Anchors of the 400-byte strings that start from ``begin`` to ``end``."""
    low, high = max(0, begin - LEFT), min(len(raw), end + LEFT + LENGTH)
    up, down = _powers.get(high - low + 1)
    sums = np.zeros(high - low + 1, np.uint64)
    np.cumsum(BYTES[raw[low:high]] * up[:-1], out=sums[1:])
    from_, to = begin - low, end - low + LEFT  # 64-byte strings inside these 400-byte strings
    grams = mix((sums[from_ + GRAM:to + GRAM] - sums[from_:to]) * down[from_:to])
    least = _least(grams, SPAN)
    edge = np.zeros(SPAN - 1, np.uint64)
    # a place is an anchor if it is the least of some stretch that holds it
    greatest = ~_least(~np.concatenate([edge, least, edge]), SPAN)
    at = np.flatnonzero(greatest == grams)
    pos = at + begin
    before, after = np.minimum(pos, LEFT), np.minimum(len(raw) - pos, LENGTH)
    first, last = pos - before - low, pos + after - low
    context = mix((sums[last] - sums[first]) * down[first] + (before * 1000 + after).astype(np.uint64))
    return Anchors(pos, grams[at].view(np.int64), context.view(np.int64), before, after)


def anchors(raw: np.ndarray) -> Anchors | None:
    strings = len(raw) - LENGTH + 1
    if strings < 1:
        return None
    if strings <= STRETCH:
        return _stretch(raw, 0, strings)
    parts = [_stretch(raw, b, min(b + STRETCH, strings)) for b in range(0, strings, STRETCH)]
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("pos", "key", "context", "before", "after")]
    once = np.unique(columns[0], return_index=True)[1]
    return Anchors(*(c[once] for c in columns))


def merged_spans(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given spans."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return begins[new], reach[last]


def _texts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[list[bytes]]:
    """Texts that this task has not seen yet."""
    seen: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            fresh = []
            for text in batch.column(0).slice(at, size).to_pylist():
                raw = (text or "").encode()
                digest = hashlib.blake2b(raw, digest_size=16).digest()
                if len(raw) >= LENGTH and digest not in seen:
                    seen.add(digest)
                    fresh.append(raw)
            yield fresh


def _table(schema: str, columns: list) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _entries(texts: DataFrame) -> tuple[Step, DataFrame, DataFrame]:
    """Entries of all texts, one for each context in a text, the step that holds them, and spans that repeat within a text by whole contexts."""
    schema = f"{ENTRY}, until bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fresh in _texts(batches):
            parts: list[list[np.ndarray]] = []
            names: list[str] = []
            for raw in fresh:
                a = anchors(np.frombuffer(raw, np.uint8))
                t = name_of(raw)
                once, of, n = np.unique(a.context, return_index=True, return_inverse=True, return_counts=True)[1:]
                parts.append([a.key[once], a.context[once], a.pos[once], a.before[once], a.after[once], np.full(len(once), -1)])
                names += [t] * len(once)
                again = n[of] > 1
                if again.any():
                    begins, ends = merged_spans((a.pos - a.before)[again], (a.pos + a.after)[again])
                    zero = np.zeros(len(begins), np.int64)
                    parts.append([zero, zero, begins, zero, zero, ends])
                    names += [t] * len(begins)
            if parts:
                key, context, pos, before, after, until = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield _table(schema, [key, context, names, pos, before.astype(np.int32), after.astype(np.int32), until])

    both = Step(texts.mapInArrow(run, schema), "suffix-entries")
    own = staged(both.df.where("until >= 0").selectExpr("t", "pos as begin", "until as end"), "suffix-own")
    return both, both.df.where("until < 0").drop("until"), own


class SuffixIndex:
    """Sorted runs of entries below ``folder``, in levels of doubling size, and the keys found more than once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self.folder = spark, folder, Folder(spark, folder)

    def levels(self) -> dict[str, int]:
        """Run and its size, as a power of two of batches; the newest list counts."""
        lists = sorted((n for n in self.folder.names() if n.startswith("levels=")), key=lambda n: int(n.removeprefix("levels=")))
        if not lists:
            return {}
        pairs = (line.split() for line in self.folder.read_text(lists[-1]).split("\n") if line)
        return {run: int(size) for run, size in pairs}

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/{run}")

    def _write(self, entries: DataFrame, run: str) -> None:
        # a key with very many places may span several files
        entries.repartitionByRange("key", "t").sortWithinPartitions("key", "t").write.mode("overwrite").parquet(f"{self.path}/{run}")

    def add(self, entries: DataFrame) -> None:
        """Sort a batch into a run, find its keys again in itself and all levels, then merge levels of equal size."""
        levels = self.levels()
        number = sum(n.startswith("levels=") for n in self.folder.names())
        run, size = f"run-{number}", 0
        self._write(entries, run)
        fresh = self._read(run)
        keys = fresh.groupBy("key").count()
        again = keys.where("count > 1").select("key")
        for level in levels:
            again = again.unionByName(keys.select("key").join(self._read(level).select("key").distinct(), "key"))
        again.distinct().write.mode("overwrite").parquet(f"{self.path}/again-{number}")
        replaced = []
        while equal := [level for level, s in levels.items() if s == size]:
            merged = f"run-{number}-{size + 1}"
            self._write(self._read(run).unionByName(self._read(equal[0])), merged)
            del levels[equal[0]]
            replaced += [run, equal[0]]
            run, size = merged, size + 1
        levels[run] = size
        # a batch that failed halfway is not in the list and is written again
        self.folder.create_text(f"levels={number}", "\n".join(f"{r} {s}" for r, s in levels.items()))
        for old in replaced:
            self.folder.delete(old)
        self.spark.sparkContext._jvm.System.gc()  # as in Step: the runs' shuffle files may go

    def repeated(self) -> DataFrame:
        """All entries whose key occurs more than once."""
        levels = self.levels()
        if not levels:
            return self.spark.createDataFrame([], ENTRY)
        batches = [n.removeprefix("levels=") for n in self.folder.names() if n.startswith("levels=")]
        keys = self.spark.read.schema("key bigint").parquet(*(f"{self.path}/again-{b}" for b in batches)).distinct()
        return self.spark.read.schema(ENTRY).parquet(*(f"{self.path}/{run}" for run in levels)).join(keys, "key")


CONTEXT = "key bigint, context bigint, before int, body binary"


def _contexts(texts: DataFrame, wanted: BitFilter, hot: BitFilter | None, take_hot: bool) -> DataFrame:
    """The bytes around the anchors of the wanted contexts, once for each in a task; either of hot keys or of the others.

    The filter of hot keys may count others among them, but then all contexts of such a key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for fresh in _texts(batches):
            rows = []
            for raw in fresh:
                a = anchors(np.frombuffer(raw, np.uint8))
                let = wanted.lets([a.key, a.context])
                if hot is not None:
                    let &= hot.lets([a.key]) == take_hot
                for i in np.flatnonzero(let).tolist():
                    context, pos, before = int(a.context[i]), int(a.pos[i]), int(a.before[i])
                    if context not in given:
                        given.add(context)
                        rows.append((int(a.key[i]), context, before, raw[pos - before:pos + int(a.after[i])]))
            if rows:
                yield _table(CONTEXT, list(zip(*rows, strict=True)))

    return texts.mapInArrow(run, CONTEXT)


def _sums(before: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash sums up to each place around the anchors, a row per context, and which 400-byte strings exist, a row per offset."""
    wide = np.zeros((len(bodies), LEFT + LENGTH), np.uint64)
    for row, (b, body) in enumerate(zip(before.tolist(), bodies, strict=True)):
        wide[row, LEFT - b:LEFT - b + len(body)] = BYTES[np.frombuffer(body, np.uint8)]
    sums = np.zeros((len(bodies), LEFT + LENGTH + 1), np.uint64)
    np.cumsum(wide * _powers.get(LEFT + LENGTH + 1)[0][:-1], axis=1, out=sums[:, 1:])
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
    start = np.arange(SPAN)[:, None]
    return sums, (start >= LEFT - before) & (start + LENGTH <= LEFT - before + lengths)


def _string_hashes(before: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each 400-byte string around the anchors, a row per offset, and which of them exist."""
    sums, valid = _sums(before, bodies)
    hashes = ((sums[:, LENGTH:] - sums[:, :SPAN]) * _powers.get(LEFT + LENGTH + 1)[1][:SPAN]).T
    return np.ascontiguousarray(hashes), valid


def _group_hashes(before: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what the strings of each group have in common, a row per group, then of all they cover; which of them exist."""
    sums, valid = _sums(before, bodies)
    first = np.arange(0, SPAN, GROUP)
    last = np.minimum(first + GROUP, SPAN) - 1
    begins, ends = np.concatenate([last, first]), np.concatenate([first, last]) + LENGTH
    hashes = ((sums[:, ends] - sums[:, begins]) * _powers.get(LEFT + LENGTH + 1)[1][begins]).T
    return hashes, np.concatenate([np.logical_or.reduceat(valid, first, axis=0), np.logical_and.reduceat(valid, first, axis=0)])


def _extent(again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a repeated string, and the least and greatest number of bytes before the anchor in one."""
    rows = np.flatnonzero(again.any(axis=0))
    first = again[:, rows].argmax(axis=0)
    last = SPAN - 1 - again[::-1, rows].argmax(axis=0)
    return rows, LEFT - last, LEFT - first


RESOLVED = "key bigint, context bigint, least int, most int"


def _again(values: np.ndarray) -> np.ndarray:
    """Which values of each row occur in it more than once."""
    order = np.argsort(values, axis=1)
    ranked = np.take_along_axis(values, order, axis=1)
    same = ranked[:, 1:] == ranked[:, :-1]
    edge = np.zeros((len(values), 1), bool)
    again = np.zeros(values.shape, bool)
    np.put_along_axis(again, order, np.hstack([edge, same]) | np.hstack([same, edge]), axis=1)
    return again


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts in order of key and context; strings equal to one of another context of the key."""
    held: list[pa.RecordBatch] = []

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, context = (table.column(c).to_numpy() for c in ("key", "context"))
        # several tasks may have given the same context; keys with one context are not compared
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])]))
        key = key[new]
        several = np.concatenate([[False], key[1:] == key[:-1]]) | np.concatenate([key[1:] == key[:-1], [False]])
        table = table.take(pa.array(new[several]))
        if not table.num_rows:
            return
        hashes, valid = _string_hashes(table.column("before").to_numpy(), table.column("body").to_pylist())
        rows, least, most = _extent(_again(hashes) & valid)
        picked = table.select(["key", "context"]).take(pa.array(rows))
        yield _table(RESOLVED, [picked.column(0).to_numpy(), picked.column(1).to_numpy(), least.astype(np.int32), most.astype(np.int32)])

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            held.append(batch.slice(at, 1024))
            if sum(b.num_rows for b in held) < 1024:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield from resolve(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from resolve(pa.Table.from_batches(held))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch, with each context once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            piece = batch.slice(at, 1024)
            yield piece.take(pa.array(np.unique(piece.column("context").to_numpy(), return_index=True)[1]))


def _by_value(hashes: np.ndarray, wanted: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
    """The wanted hashes, a row per offset, with their contexts and offsets."""
    offsets, rows = np.nonzero(wanted)
    values = mix(hashes[offsets, rows] + offsets.astype(np.uint64))
    return packed((values >> np.uint64(56)).astype(np.int64), [values, contexts[rows], offsets.astype(np.int16)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts and offsets of the hashes that several contexts have, and which is a hash's first."""
    for values, contexts, offsets in unpacked(batches, [np.uint64, np.int64, np.int16]):
        # a context that several batches gave is one context
        order = np.lexsort((contexts, values))
        values, contexts, offsets = values[order], contexts[order], offsets[order]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (contexts[1:] != contexts[:-1])])
        values, contexts, offsets = values[new], contexts[new], offsets[new]
        same = values[1:] == values[:-1]
        before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
        if same.any():
            yield tuple(c[before | after] for c in (contexts, offsets, ~before))


def _part(contexts: np.ndarray) -> np.ndarray:
    return contexts.view(np.uint64).astype(np.uint64) % np.uint64(PARTS)


def _groups(hot: DataFrame) -> DataFrame:
    """What comparing groups tells of each context; contexts of which no group's common part occurs again have no row.

    ``least`` and ``most`` bound the groups that another context has whole (``least`` is greater if there are none).
    ``groups`` has a bit for each group whose strings are still to be compared: those that may hold a repeated string
    but do not occur whole, and of those that do, the one of the least context.
    """
    count = -(-SPAN // GROUP)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _once(batches):
            hashes, valid = _group_hashes(piece.column("before").to_numpy(), piece.column("body").to_pylist())
            yield _by_value(hashes, valid, piece.column("context").to_numpy())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contexts, groups, first in _shared(batches):
            leads = first & (groups >= count)
            contexts, groups = np.concatenate([contexts, contexts[leads]]), np.concatenate([groups, groups[leads] + np.int16(count)])
            yield packed(_part(contexts), [contexts, groups])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contexts, groups in unpacked(batches, [np.int64, np.int16]):
            names, rows = np.unique(contexts, return_inverse=True)
            has = np.zeros((len(names), 3 * count), bool)
            has[rows, groups] = True
            common, whole, leads = has[:, :count], has[:, count:2 * count], has[:, 2 * count:]
            some = whole.any(axis=1)
            first = np.where(some, whole.argmax(axis=1), count)
            last = np.where(some, count - 1 - whole[:, ::-1].argmax(axis=1), -1)
            compared = common & (~whole | leads)
            least = np.where(some, LEFT - (np.minimum((last + 1) * GROUP, SPAN) - 1), LENGTH)
            most = np.where(some, LEFT - first * GROUP, 0)
            yield _table(GROUPS, [names, *(c.astype(np.int32) for c in (compared @ (1 << np.arange(count)), least, most))])

    found = dealt(dealt(hot.mapInArrow(deal, PACKED)).mapInArrow(compare, PACKED))
    return found.mapInArrow(gather, GROUPS)


def _dealt(hot: DataFrame) -> DataFrame:
    """Context and extent for keys with very many contexts: hashes go by their value to whoever compares them.

    ``hot`` is read twice. What is found comes back packed by context, so that each context makes two rows at most.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _once(batches):
            hashes, valid = _string_hashes(piece.column("before").to_numpy(), piece.column("body").to_pylist())
            may = piece.column("groups").to_numpy() >> (np.arange(SPAN) // GROUP)[:, None] & 1
            if (valid & (may == 1)).any():
                yield _by_value(hashes, valid & (may == 1), piece.column("context").to_numpy())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contexts, offsets, _ in _shared(batches):
            befores = LEFT - offsets
            found = _extents(contexts, befores, befores)
            yield packed(_part(found[0]), found)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for contexts, least, most in unpacked(batches, [np.int64, np.int16, np.int16]):
            yield _table(EXTENT, [c if i == 0 else c.astype(np.int32) for i, c in enumerate(_extents(contexts, least, most))])

    groups = staged(_groups(hot), "suffix-groups")
    rest = hot.join(groups.where("groups > 0").select("context", "groups"), "context")
    found = dealt(dealt(rest.mapInArrow(deal, PACKED)).mapInArrow(compare, PACKED)).mapInArrow(gather, EXTENT)
    return found.unionByName(groups.where("least <= most").drop("groups"))


GROUPS = "context bigint, groups int, least int, most int"
EXTENT = "context bigint, least int, most int"


def _extents(contexts: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """The least and the most of each context."""
    order = np.argsort(contexts, kind="stable")
    contexts, least, most = contexts[order], least[order], most[order]
    if not len(contexts):
        return [contexts, least, most]
    begins = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    return [contexts[begins], np.minimum.reduceat(least, begins), np.maximum.reduceat(most, begins)]


def repeated_spans(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``t`` (name of a text), ``whole`` and ``spans`` (sorted, disjoint begin and end) of texts that repeat somewhere.

    A text of at least 400 bytes that several rows have repeats as a whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies = (texts.where(F.octet_length("text") >= LENGTH).groupBy(F.substring(F.sha2("text", 256), 1, 32).alias("t"))
              .count().where("count > 1").select("t", F.lit(True).alias("whole")))
    held, entries, own = _entries(texts)
    index = SuffixIndex(spark, new_folder(spark, "suffix-index"))
    for batch in range(setting.batches):
        index.add(entries.where(F.pmod(F.xxhash64("t"), F.lit(setting.batches)) == batch))
    held.release()

    repeated = staged(index.repeated(), "suffix-repeated")
    index.folder.delete()
    contexts = staged(repeated.groupBy("key", "context").agg(
        F.count("*").alias("n"), F.min("before").alias("before"), F.min("after").alias("after")), "suffix-contexts")
    several = staged(contexts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "suffix-several")
    wanted = BitFilter(contexts.join(several, "key"), ["key", "context"])
    hot_keys = several.where(F.col("m") > setting.block)
    hot = None if hot_keys.isEmpty() else BitFilter(hot_keys, ["key"])
    cold = _contexts(texts, wanted, hot, False).repartition("key").sortWithinPartitions("key", "context")
    cold = cold.mapInArrow(_compared, RESOLVED)
    # equal contexts: every string around the anchor that lies within the text repeats
    equal = contexts.where("n > 1").select(
        "key", "context", (F.lit(LENGTH) - F.col("after")).alias("least"), F.col("before").alias("most")).where("least <= most")
    found = equal.unionByName(cold)
    if hot is not None:
        extents = staged(_dealt(staged(_contexts(texts, wanted, hot, True), "suffix-hot-contexts")), "suffix-hot")
        found = found.unionByName(contexts.join(extents, "context").select("key", "context", "least", "most"))
    found = staged(found.groupBy("key", "context").agg(F.min("least").alias("least"), F.max("most").alias("most")), "suffix-found")
    spans = repeated.join(found, ["key", "context"]).select(
        "t", (F.col("pos") - F.col("most")).alias("begin"), (F.col("pos") - F.col("least") + LENGTH).alias("end"))
    spans = spans.unionByName(own).groupBy("t").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))

    @F.pandas_udf("array<struct<begin: bigint, end: bigint>>")
    def joined(column: pd.Series) -> pd.Series:
        made = []
        for rows in column:
            begins, ends = merged_spans(np.array([r["begin"] for r in rows]), np.array([r["end"] for r in rows]))
            made.append([{"begin": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
        return pd.Series(made)

    spans = spans.join(copies.select("t"), "t", "left_anti").select("t", F.lit(False).alias("whole"), joined("spans").alias("spans"))
    return staged(spans.unionByName(copies, allowMissingColumns=True), "suffix-spans")


def _kept(text: str, spans) -> bytes:
    raw, at, parts = text.encode(), 0, []
    for span in spans:
        parts.append(raw[at:span["begin"]])
        at = span["end"]
    return b"".join([*parts, raw[at:]])


def _maybe(names: DataFrame):
    """A test whether a text's name may be among the given ones, for leaving out the rest before a shuffle."""
    def number(t: pd.Series) -> np.ndarray:
        return np.fromiter((int(x[:15], 16) for x in t), np.int64, len(t))

    let = BitFilter(names.select(F.conv(F.substring("t", 1, 15), 16, 10).cast("bigint").alias("t")), ["t"])

    @F.pandas_udf("boolean")
    def test(t: pd.Series) -> pd.Series:
        return pd.Series(let.lets([number(t)]) if len(t) else [], dtype=bool)

    return test


def measured(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Null and empty texts, and all below 400 bytes, lose nothing. Of equal texts from 400 bytes on, none
    keeps a byte. Repeated rows count as two places, so they are removed as well.
    """
    found = repeated_spans(docs, setting)
    rows = nested(docs).select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    maybe = _maybe(found.where("not whole"))
    rows = rows.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "sha", F.substring("sha", 1, 32).alias("t"), "text")
    rows = rows.select("doc_id", "n_bytes", "sha", "t", F.when(maybe("t"), F.col("text")).alias("text"))

    @F.pandas_udf("string")
    def hashed(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(_kept(t, s)).hexdigest() if t is not None and s is not None else None
                          for t, s in zip(text, spans, strict=True)], dtype=object)

    joined = rows.join(found, "t", "left")
    whole, part = F.coalesce("whole", F.lit(False)), F.col("spans").isNotNull()
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    joined = joined.withColumn("kept", hashed("text", "spans"))
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(part, lost).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(whole, 1).when(part, F.size("spans")).otherwise(0).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(part, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"))


def cleaned(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The documents without the repeated strings, in their own columns; a character that is cut in two goes whole."""
    found = repeated_spans(docs, setting)
    maybe = _maybe(found)
    named = docs.select(F.struct(F.col("*")).alias("row"), F.substring(
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), 1, 32).alias("t"))
    named = named.select("row", "t", maybe("t").alias("maybe"))

    @F.pandas_udf("string")
    def shortened(text: pd.Series, whole: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if w is None or t is None else "" if w else _kept(t, s).decode(errors="ignore")
                          for t, w, s in zip(text, whole, spans, strict=True)], dtype=object)

    hit = named.where("maybe").join(found, "t", "left").withColumn("new", shortened("row.text", "whole", "spans"))
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    changed = [F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return named.where("not maybe").select(*columns).unionByName(hit.select(*changed))
