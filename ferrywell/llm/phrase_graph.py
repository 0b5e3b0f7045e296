"""Collocations from a weighted de Bruijn graph of words.

Every place in a piece of text starts one gram of up to three words: an edge from the node of its first
two words to the node of its last two, or, near the end of a piece, what is left there. Only these are
counted, and edges that are rare for certain just as flow out of their first node. The count of two words is then the flow through their node, that of one word the flow out of
all nodes that begin with it; grams cut short by the end of a piece are the correction in both.
Chains of edges whose inner nodes let the whole flow through are compacted to paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ferrywell.llm.staging import staged

#: Ends of pieces; they become the sign ``;``, which no word can hold.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Places that a task counts at a time, and the words that its own numbering of words holds.
PLACES, NUMBERED = 1 << 19, 1 << 18
#: Counters of the sketch of pairs (as a power of two), and of one block of them. A full sketch only lets more through.
COUNTER_BITS, BLOCK_BITS = 26, 14
#: In how many parts a language's phrases are ranked first.
PARTS = 64


def _letters() -> bytes:
    table = bytearray(range(256))
    table[0x41:0x5B] = range(0x61, 0x7B)
    for end in PIECE_ENDS:
        table[end] = 10
    table[9] = 32
    return bytes(table)


LETTERS = _letters()


def pieces(text: str) -> list[bytes]:
    """The words of a text with ``;`` after each piece."""
    return (text.encode().translate(LETTERS) + b"\n").replace(b"\n", b" ; ").split()


class _Places:
    """Texts as numbers of words, 0 at the ends of pieces, some at a time and by language."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b";": 0}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> bool:
        """Whether it is time to take what is held."""
        words, numbers = pieces(text), self.numbers
        try:
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        except KeyError:
            for word in words:
                numbers.setdefault(word, len(numbers))
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.parts.setdefault(lang, []).append(ids)
        self.held += len(ids)
        return self.held >= PLACES or len(numbers) >= NUMBERED

    def take(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By language: each place's word and the next two (0: none in its piece), and the hash of its pair (0: none)."""
        hashes = np.fromiter(map(zlib.crc32, self.numbers), np.uint64, len(self.numbers))
        for lang, parts in self.parts.items():
            ids = np.concatenate([*parts, np.zeros(2, np.int64)])
            one, two, three = ids[:-2], ids[1:-1], ids[2:]
            two = np.where(one > 0, two, 0)
            three = np.where(two > 0, three, 0)
            mixed = (hashes[one] + np.uint64(zlib.crc32(lang.encode()))) * np.uint64(0x9E3779B97F4A7C15) + hashes[two]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield lang, one, two, three, mixed >> np.uint64(64 - COUNTER_BITS)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[_Places]:
    places = _Places()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if places.add(lang, text.as_py()):
                yield places
                places.clear()
    if places.held:
        yield places


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of hashed pairs, none above 255, in blocks."""
    counters = np.zeros(1 << COUNTER_BITS, np.uint8)
    for places in _taken(batches):
        for _, _, two, _, pair in places.take():
            at, n = np.unique(pair[two > 0], return_counts=True)
            counters[at] = np.minimum(counters[at] + n, 255)
    blocks = [(i, part) for i, part in enumerate(counters.reshape(-1, 1 << BLOCK_BITS)) if part.any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in blocks], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1) for _, part in blocks], pa.binary())],
        ["block", "counts"])


def _summed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
                held[block] = np.minimum(held.get(block, 0) + more.astype(np.int64), 255)
        bits = [np.packbits(counts >= min(least, 255)).tobytes() for counts in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])

    return run


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """One bit for each hash of a pair: set wherever a pair may occur ``least`` times; of fixed size."""
    blocks = texts.mapInArrow(_sketched, "block int, counts binary").repartition("block")
    packed = np.zeros((1 << (COUNTER_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in blocks.mapInArrow(_summed(least), "block int, bits binary").collect():
        packed[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return packed.reshape(-1)


def _counted(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value if frequent else None
        for places in _taken(batches):
            names = pa.array(list(places.numbers), pa.string())
            for lang, one, two, three, pair in places.take():
                if bits is not None:
                    known = (bits[pair >> np.uint64(3)] >> (7 - (pair & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    two = np.where(known, two, 0)
                    three = np.where(known & np.append(known[1:], False), three, 0)
                width = len(names)
                if width ** 3 < 1 << 62:
                    codes = (one * width + two) * width + three
                else:
                    codes = np.unique(one * width + two, return_inverse=True)[1] * width + three
                begun = np.flatnonzero(one)
                _, first, counts = np.unique(codes[begun], return_index=True, return_counts=True)
                at = begun[first]
                size = 1 + (two[at] > 0) + (three[at] > 0)
                for k in (1, 2, 3):
                    chosen = at[size == k]
                    grams = pc.binary_join_element_wise(*(names.take(pa.array(c[chosen])) for c in (one, two, three)[:k]), " ")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(chosen), pa.string()), grams.cast(pa.string()), pa.array(counts[size == k])],
                        ["lang", "gram", "n"])

    return run


def edges(docs: DataFrame, least: int = 1) -> DataFrame:
    """lang, gram, n: how often each longest gram occurs; shorter ones stand at the end of a piece.

    Where an edge occurs less than ``least`` times, as its pairs already show, only what flows through
    its first node counts, and it appears as that; in the same way a rare pair appears as its first word.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pairs(texts, least)) if least > 1 else None
    return texts.mapInArrow(_counted(frequent), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _front(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _back(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def _size(gram: str) -> Column:
    return F.length(gram) - F.length(F.replace(F.col(gram), F.lit(" "), F.lit(""))) + 1


def node_flows(graph: DataFrame) -> DataFrame:
    """lang, gram, n of all pairs of words, as the flow out of their nodes, ends of pieces included."""
    return graph.where(_size("gram") > 1).groupBy("lang", _front("gram", 2).alias("gram")).agg(F.sum("n").alias("n"))


def word_flows(graph: DataFrame) -> DataFrame:
    """lang, gram, n of all single words."""
    return graph.groupBy("lang", _front("gram", 1).alias("gram")).agg(F.sum("n").alias("n"))


def compacted(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, gram, n, head, step: on which path each edge lies, named by its first edge, and where.

    A node is inner when one edge brings and one edge takes its whole flow. No path closes to a ring,
    because a piece of text ends somewhere. Each round doubles how far an edge looks back.
    """
    spark = triples.sparkSession
    brought = triples.select("lang", F.col("gram").alias("prev"), _back("gram", 2).alias("node"), "n")
    taken = triples.select("lang", "gram", _front("gram", 2).alias("node"), "n")
    inner = pairs.select("lang", F.col("gram").alias("node"), "n")
    links = brought.join(inner, ["lang", "node", "n"]).join(taken, ["lang", "node", "n"]).select("lang", "gram", "prev")
    state = staged(
        triples.join(links, ["lang", "gram"], "left").select(
            "lang", "gram", "n", F.coalesce("prev", "gram").alias("head"),
            F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("step"), F.col("prev").isNotNull().alias("open")),
        "phrase-paths")
    while not state.where("open").isEmpty():
        before = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("far"), F.col("step").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(before, ["lang", "head"]).select(
            "lang", "gram", "n", F.col("far").alias("head"), (F.col("step") + F.col("more")).alias("step"), F.col("still").alias("open"))
        state = staged(state.where("not open").unionByName(moved), "phrase-paths")
    return state.drop("open")


def paths(edges_on_paths: DataFrame) -> DataFrame:
    """lang, phrase, n_words, n of every compacted path; none is longer than a piece of text."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("step", _back("gram", 1).alias("word")))), lambda s: s["word"])
    return edges_on_paths.groupBy("lang", "head", "n").agg(words.alias("words")).select(
        "lang", F.concat(_front("head", 2), F.lit(" "), F.array_join("words", " ")).alias("phrase"),
        (F.size("words") + 2).cast("bigint").alias("n_words"), "n")


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds l, r and score of the weakest cut; decimals of 38 digits hold all products."""
    def part(name: str) -> DataFrame:
        return counts.select("lang", F.col("gram").alias(f"{name}_gram"), F.col("n").alias(name))

    size = _size("phrase")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("l_gram"),
        F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)").alias("r_gram"))
    score = "cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)"
    return (cuts.join(part("l"), ["lang", "l_gram"]).join(part("r"), ["lang", "r_gram"])
            .withColumn("score", F.expr(score))
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language.

    A phrase occurs at least ``least`` times; it goes when a longer one around it reaches ``share``
    percent of its count. The weakest cut counts, of equal ones the first; equal scores are ranked by
    count, then by the phrase's bytes. A null text is empty, a null language is ``und``; repeated rows
    count each; long texts are counted in parts of a task without cutting a gram. An empty table gives
    no rows, and other columns, whatever their names, are not read.
    """
    graph = staged(edges(docs, least), "phrase-edges")
    triples = staged(graph.where((F.col("n") >= least) & (_size("gram") == 3)), "phrase-triples")
    pairs = staged(node_flows(graph).where(F.col("n") >= least), "phrase-pairs")
    words = staged(word_flows(graph), "phrase-words")

    on_paths = compacted(triples, pairs)
    ends = on_paths.groupBy("lang", "head", "n").agg(F.max_by("gram", "step").alias("tail"))
    around = ends.select(
        "lang", F.explode(F.array(_front("head", 2), _back("tail", 2))).alias("gram"), F.col("n").alias("longer"))
    inside = on_paths.where("step > 0").select("lang", _front("gram", 2).alias("gram"), F.col("n").alias("longer"))
    covered = around.unionByName(inside).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    free = pairs.join(covered, ["lang", "gram"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    candidates = free.select("lang", "gram", "n").unionByName(triples).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"))

    scored = _scored(candidates, words.unionByName(pairs))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
