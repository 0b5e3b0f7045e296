"""Similarity join of documents on word n-grams, by set size.

Sets are identified by a hash, so exact copies are one set from the start. Candidates come from a
size-aware index. A *small* set enumerates its subsets of the sizes that a similar set must share
with it; similar small sets meet in such a subset. A *large* set is posted in inverted lists under
the first tokens of a global order, rare tokens first, as many as a similar set cannot avoid.
The boundary between both is the one with the least cost for the sizes at hand.

Groups of near copies would make long lists and squares of pairs. Therefore lists are scanned three
times. First each set is compared with one leader, the smallest set of the lists it shares most. The
links found form components. Then only lists that still hold several components are scanned, and only
for pairs across components: first each set with its nearest in every list, in the end all that are left.
Bitmaps of the sets rule out most pairs without their tokens. All that is skipped is a pair whose sets
are connected already, or that is too different by a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywell.llm.bit_filter import BITS, BitFilter
from ferrywell.llm.components import connected_components
from ferrywell.llm.packed import PACKED, PARTS, dealt, packed, unpacked
from ferrywell.llm.shingles import mix, shingle_sets
from ferrywell.llm.staging import staged

SLICE = 512
MARKS = [f"b{i}" for i in range(8)]


@dataclass(frozen=True)
class Setting:
    width: int = 5
    percent: int = 80  # of the union, that two linked sets share at least
    buckets: int = 1 << 18  # counters of the frequency sketch
    filter_bits: int = BITS  # of the filter for documents with candidates
    scan_cost: int = 3  # of reading one inverted list, in enumerated subsets
    block: int = 4096  # longest stretch of a list that one task compares with another

    def shared(self, n: int) -> int:
        """Tokens of a set of n that a linked set has at least."""
        return -(-self.percent * n // 100)

    def apart(self, n, m):
        """Tokens that two linked sets of these sizes can have outside their intersection, at most."""
        return (n + m) - 2 * -(-self.percent * (n + m) // (100 + self.percent))


def similar_documents(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts have no shingles and are linked with nothing: their component is their own
    doc_id. Repeated rows are linked with each other like any equal sets. Rows without doc_id take
    part, but do not name a component. An empty table gives an empty result.
    """
    return _named(*_grouped(docs, setting))


def _grouped(docs: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame]:
    """A row per document (its id, the hash of its text, the name and size of its set), and the component of each linked set."""
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    sets, tokens = _described(docs, setting)
    classes = _frequency_classes(tokens, setting)
    boundary = _boundary(sets, setting)
    marks = staged(sets.where("n > 0").select("s", "n", *MARKS).dropDuplicates(["s"]), "jaccard-marks")
    postings = staged(_postings(docs, classes, boundary, setting), "jaccard-postings")
    ends = postings.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo != hi")
    # copies in different tasks post the same set
    lists = staged(postings.join(ends.select("key", "lo"), "key").dropDuplicates(["key", "s"]), "jaccard-lists")

    votes = lists.where("s != lo").groupBy("s", "lo").count()
    leaders = votes.groupBy("s").agg(F.max_by("lo", F.struct("count", "lo")).alias("lo"))
    near = leaders.select(F.col("lo").alias("a"), F.col("s").alias("b"))
    first = _linked(near, docs, sets, marks, setting)
    groups = connected_components(first)

    for nearest in (True, False):
        rest = _across(lists, groups, marks, setting, nearest)
        links = _linked(rest, docs, sets, marks, setting)
        if not links.isEmpty():
            known = groups.select(F.col("component").alias("a"), F.col("node").alias("b"))
            groups = connected_components(known.unionByName(links))
    return sets, groups


def _mapped(docs: DataFrame, schema: str, start) -> DataFrame:
    """Run ``start()`` once per task; it gets slices of ids and texts, and None at the end, and returns columns."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = work(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        columns = work(None)
        if columns is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, schema)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens & np.uint64(buckets - 1)).astype(np.int64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def set_name(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(docs: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: a row per document (hash of its text, name and size of its set), and each task's counts of hashed tokens."""
    width, buckets = setting.width, setting.buckets

    def start():
        counts = np.zeros(buckets, np.int64)

        def work(part: pa.RecordBatch | None):
            nonlocal counts
            if part is None:
                held = np.flatnonzero(counts)
                none = [None] * len(held)
                return none, none, none, counts[held], held, *([none] * len(MARKS))
            ids, names, sizes, maps = part.column(0).to_pylist(), [], [], []
            found = list(shingle_sets(part.column(1).to_pylist(), width))
            for tokens in found:
                names.append(set_name(tokens))
                sizes.append(len(tokens))
                maps.append(_marks(tokens))
            if found:
                counts += np.bincount(_bucket(np.concatenate(found), buckets), minlength=buckets)
            return ids, part.column(2), names, sizes, [None] * len(ids), *np.array(maps, np.int64).reshape(-1, len(MARKS)).T

        return work

    schema = "doc_id bigint, h bigint, s bigint, n bigint, bucket bigint" + "".join(f", {m} bigint" for m in MARKS)
    both = staged(_mapped(docs.select("doc_id", "text", _text_hash().alias("h")), schema, start), "jaccard-sets")
    return (both.where("bucket is null").select("doc_id", "h", "s", "n", *MARKS),
            both.where("bucket is not null").select("bucket", "n"))


def _frequency_classes(tokens: DataFrame, setting: Setting) -> np.ndarray:
    """How frequent the tokens of each bucket are, as a power of two. Its size is fixed by the setting."""
    counts = tokens.groupBy("bucket").agg(F.ceil(F.log2(F.sum("n"))).cast("int").alias("power")).toArrow()
    classes = np.zeros(setting.buckets, np.uint8)
    classes[counts["bucket"].to_numpy()] = counts["power"].to_numpy().astype(np.uint8)
    return classes


def _boundary(sets: DataFrame, setting: Setting, tried: tuple[int, ...] = (0, 5, 10, 15, 20, 25, 30)) -> int:
    """The size from which on sets are posted instead of enumerated, at the least cost."""
    sizes = {r["n"]: r["d"] for r in sets.where(F.col("n") < 2 * max(tried)).groupBy("n").agg(F.countDistinct("s").alias("d")).collect()}

    def cost(boundary: int) -> int:
        subsets = sum(d * sum(comb(n, c) for c in range(setting.shared(n), n + 1)) for n, d in sizes.items() if 0 < n < boundary)
        lists = sum(d * (n - setting.shared(n) + 1) for n, d in sizes.items() if n >= max(1, setting.shared(boundary)))
        return subsets + setting.scan_cost * lists

    return min(tried, key=cost)


def _subset_keys(tokens: np.ndarray, setting: Setting) -> list[int]:
    """A key for each subset of a size that a linked set can share as a whole."""
    parts = mix(tokens + np.uint64(0xA0761D6478BD642F))
    n, total, keys = len(tokens), parts.sum(dtype=np.uint64), []
    for left_out in range(n - setting.shared(n) + 1):
        places = np.array(list(combinations(range(n), left_out)), np.int64).reshape(comb(n, left_out), left_out)
        keys.append(mix(total - parts[places].sum(axis=1, dtype=np.uint64) + np.uint64(n - left_out)))
    return np.concatenate(keys).view(np.int64).tolist()


def _postings(docs: DataFrame, classes: np.ndarray, boundary: int, setting: Setting) -> DataFrame:
    """Rows of key, set, size and place in the global order (-1 for subsets)."""
    width, buckets, posted_from = setting.width, setting.buckets, setting.shared(boundary)
    shared_classes = docs.sparkSession.sparkContext.broadcast(classes)

    def start():
        order, seen = shared_classes.value, set()

        def work(part: pa.RecordBatch | None):
            if part is None:
                return None
            keys, names, sizes, places = [], [], [], []
            for tokens in shingle_sets(part.column(1).to_pylist(), width):
                n = len(tokens)
                name = set_name(tokens)
                if not n or name in seen:
                    continue
                seen.add(name)
                if n >= posted_from:
                    ranked = tokens[np.argsort(order[_bucket(tokens, buckets)], kind="stable")]
                    first = ranked[:n - setting.shared(n) + 1].view(np.int64).tolist()
                    keys += first
                    places += range(len(first))
                    names += [name] * len(first)
                    sizes += [n] * len(first)
                if n < boundary:
                    first = _subset_keys(tokens, setting)
                    keys += first
                    places += [-1] * len(first)
                    names += [name] * len(first)
                    sizes += [n] * len(first)
            return keys, names, sizes, places

        return work

    return _mapped(docs, "key bigint, s bigint, n int, place int", start)


def _parities(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bits that each hold the parity of the tokens that hash to it: two sets differ in at least as many tokens as bits."""
    odd = np.bincount((tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _marks(tokens: np.ndarray) -> np.ndarray:
    return _parities(tokens, 64 * len(MARKS)).view(np.int64)


def _bodies(docs: DataFrame, sets: DataFrame, wanted: DataFrame, setting: Setting) -> DataFrame:
    """The tokens of the wanted sets, one row each.

    Which documents to take them from is told to the tasks by a bit filter; what it lets through too
    much is dropped by the join that follows.
    """
    chosen = sets.join(wanted, "s").groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    let = BitFilter(chosen.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")), ["doc_id"], setting.filter_bits)
    width = setting.width

    def start():
        seen: set[int] = set()

        def work(part: pa.RecordBatch | None):
            if part is None:
                return None
            names, fine, bodies = [], [], []
            ids = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            texts = part.column(1).filter(pa.array(let.lets([ids]))).to_pylist()
            for tokens in shingle_sets(texts, width):
                name = set_name(tokens)
                if len(tokens) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    fine.append(_parities(tokens, 4096).tobytes())
                    bodies.append(tokens.tobytes())
            return names, fine, bodies

        return work

    made = _mapped(docs, "s bigint, fine binary, body binary", start)
    return staged(made.join(wanted, "s", "left_semi").dropDuplicates(["s"]), "jaccard-bodies")


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, marks: DataFrame, setting: Setting) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets are similar. Sizes and marks rule out most others before any tokens are read."""
    percent = setting.percent
    x, y = marks.alias("x"), marks.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.s")).join(y, F.col("b") == F.col("y.s"))
    n, m = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in MARKS), F.lit(0))
    apart = n + m - 2 * F.ceil((n + m) * percent / (100 + percent))
    possible = both.where((100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ <= apart))
    possible = staged(possible.select("a", "b", n.alias("n"), m.alias("m")), "jaccard-pairs")
    wanted = possible.select(F.col("a").alias("s")).union(possible.select("b")).distinct()
    bodies = _bodies(docs, sets, wanted, setting)
    def finer(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
        return int(np.bitwise_count(a ^ b).sum()) <= setting.apart(n, m)

    def similar(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
        both = np.sort(np.concatenate([a, b]))
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (n + m - common)

    # finer bits first, then the tokens of what is left
    close = staged(_tested(possible, bodies, "fine", finer), "jaccard-close")
    return staged(_tested(close, bodies, "body", similar).select("a", "b"), "jaccard-links")


def _tested(pairs: DataFrame, bodies: DataFrame, what: str, test) -> DataFrame:
    """The pairs whose sets pass a test on the given column."""
    left = bodies.select(F.col("s").alias("a"), F.col(what).alias("x"))
    right = bodies.select(F.col("s").alias("b"), F.col(what).alias("y"))
    names = ["a", "b", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True)
            values = zip(batch.column("x"), batch.column("y"), sizes, strict=True)
            keep = [i for i, (x, y, (n, m)) in enumerate(values)
                    if test(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), n, m)]
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    joined = pairs.join(left, "a").join(right, "b").select(*names, "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint, n bigint, m bigint")


def _across(lists: DataFrame, groups: DataFrame, marks: DataFrame, setting: Setting, nearest: bool) -> DataFrame:
    """Distinct pairs of sets that stand in a list together, are not connected yet and may be similar; or just the nearest of each."""
    rows = lists.join(groups.withColumnRenamed("node", "s"), "s", "left").select(
        "key", "s", "n", "place", F.coalesce("component", "s").alias("component"))
    rows = staged(rows, "jaccard-rows")
    open_lists = rows.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo != hi")
    rows = rows.join(open_lists.select("key", "m"), "key").join(marks.select("s", *MARKS), "s")
    # a list longer than a block is compared block by block, each pair of blocks on its own
    blocks = F.ceil(F.col("m") / setting.block).cast("int")
    own = F.pmod(F.xxhash64("s"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                       "own", "s", "n", "place", "component", *MARKS)
    spread = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "s")
    size = setting.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < size:
                continue
            table = pa.Table.from_batches(held)
            bounds = _bounds(table)
            yield from _compared(table, bounds[:-1], setting, nearest)
            held = table.slice(bounds[-2]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from _compared(table, _bounds(table), setting, nearest)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in unpacked(batches, [np.int64, np.int64]):
            once = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], ["a", "b"])

    # a pair that many lists hold becomes one row
    return dealt(spread.mapInArrow(run, PACKED)).mapInArrow(pairs, "a bigint, b bigint")


def _bounds(table: pa.Table) -> list[int]:
    """Where each list begins, and the end."""
    keys = [table.column(c).to_numpy() for c in ("key", "p", "q")]
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]


def _compared(table: pa.Table, bounds: list[int], setting: Setting, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Each row against the rows one, two, three .. places further in its list, all lists at once."""
    c = {name: table.column(name).to_numpy() for name in ("p", "q", "own", "s", "n", "place", "component")}
    maps = np.stack([table.column(m).to_numpy() for m in MARKS], axis=1).view(np.uint64)
    sizes = np.diff(bounds)
    last = np.repeat(np.asarray(bounds[1:]), sizes)
    rows = np.arange(len(last))
    whole, n = c["p"] == c["q"], c["n"].astype(np.int64)
    best, partner = np.full(len(last), 2.0), np.full(len(last), -1)
    found: list[np.ndarray] = []
    for step in range(1, int(sizes.max(initial=0))):
        rows = rows[rows + step < last[rows]]
        i, j = rows, rows + step
        # within a block each pair; across two blocks only pairs of one row from either
        ok = (c["component"][i] != c["component"][j]) & (c["s"][i] != c["s"][j]) & (whole[i] | (c["own"][i] != c["own"][j]))
        # what lies before the shared token in one order only is not shared
        apart = setting.apart(n[i], n[j])
        ok &= (np.abs(n[i] - n[j]) <= apart) & (np.abs(c["place"][i] - c["place"][j]) <= apart)
        i, j, apart = i[ok], j[ok], apart[ok]
        differ = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
        near = differ <= apart
        i, j = i[near], j[near]
        if not nearest:
            found.append(np.stack([i, j]))
            continue
        far = differ[near] / (n[i] + n[j])
        for one, other in ((i, j), (j, i)):
            better = far < best[one]
            best[one[better]], partner[one[better]] = far[better], other[better]
    if nearest:
        i = np.flatnonzero(partner >= 0)
        found.append(np.stack([i, partner[i]]))
    if found:
        i, j = np.concatenate(found, axis=1)
        a, b = np.unique(np.sort(np.stack([c["s"][i], c["s"][j]]), axis=0), axis=1)
        yield packed((mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) % np.uint64(PARTS)).astype(np.int64), [a, b])


def _named(sets: DataFrame, groups: DataFrame) -> DataFrame:
    full = sets.where("n > 0").join(groups.withColumnRenamed("node", "s"), "s", "left").select(
        "doc_id", "n", F.coalesce("component", "s").alias("component"))
    names = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def distinct_documents(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """The rows without near copies: of each group the one with the smallest doc_id, in its own columns.

    Each row is judged by its own text, so rows that share a doc_id, or have none, need not share a group.
    Texts without a word stay. A row without doc_id stays only if its group has no row with one. Of several
    rows that share the smallest doc_id of their group one stays.
    """
    sets, groups = _grouped(docs, setting)
    found = sets.where("n > 0").join(groups.withColumnRenamed("node", "s"), "s", "left").select(
        F.col("doc_id").alias("id"), "h", F.coalesce("component", "s").alias("group"))
    found = staged(found, "jaccard-documents")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    several = found.groupBy("group").agg(F.count("*").alias("n"), F.min(name).alias("first")).where("n > 1")
    members = found.join(several, "group").select("id", "h", "group", name.eqNullSafe(F.col("first")).alias("stays"))
    members = staged(members.dropDuplicates(["id", "h"]), "jaccard-members")
    let = BitFilter(members.select(F.coalesce("id", F.lit(-1)).alias("id"), "h"), ["id", "h"], setting.filter_bits)

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(let.lets([ids.to_numpy(np.int64), hashes.to_numpy(np.int64)]) if len(ids) else [], dtype=bool)

    rows = docs.select(F.struct(F.col("*")).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"), _text_hash().alias("own_h"))
    rows = rows.withColumn("maybe", maybe(F.coalesce("own_id", F.lit(-1)), "own_h"))
    # only rows that may belong to a group are shuffled
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("h"))
    joined = rows.where("maybe").join(members, same, "left")
    alone = joined.where("group is null").select("row.*")
    first = joined.where("stays").groupBy("group").agg(F.min_by("row", "row.text").alias("row")).select("row.*")
    return rows.where("not maybe").select("row.*").unionByName(alone).unionByName(first)
