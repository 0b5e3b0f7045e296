"""Removal of lines that are much like an earlier line, by an exact set-similarity join.

A line is the set of its words. Two lines match when their sets' Jaccard similarity reaches the
threshold; of matching lines the later one goes, by (doc_id, line). Lines with the same set are
one entry from the start. The rest follows from a global order of words, rare ones first (64-bit hashes stand for words;
in the order they are numbers of ``PLACES`` bits after a frequency, and two words with one number are merely candidates too many):

* prefix: matching sets share one of the first ``n - ceil(t * n) + 1`` words of either;
* length: the smaller set has at least ``t`` times the words of the larger one;
* position: of the first shared word; what stands before it in either set is lost to the overlap;
* parity bits: hashing all words to 128 bits, sets differ in at least as many words as bits. (With 64 bits, lines from
  about 140 words on would all pass: unrelated ones differ in 32 bits, and so many words may differ.)

Near copies of one line come in groups, which must not become squares of pairs. So each set is
first compared with the earliest set that has the same two least, largest or middle word hashes; only sets
that are still unmatched are then joined with all earlier ones. Lists of words are joined in ``PORTIONS`` of the
words, so that the shuffle files of one portion can go before the next comes; both sides of a join read the same
shuffle, since the sign of a set's ``code`` tells whether it is matched. Everything runs as DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywell.llm.columns import SPACE
from ferrywell.llm.staging import Step

#: Counters of word frequencies, and bits of the filter for lines with candidates: fixed, whatever the data.
BUCKETS, BITS = 1 << 18, 1 << 23
#: Bits of a word's hash in the global order; five bits of frequency stand before them.
PLACES = 26
#: Parts that the words are joined in, and entries of one word that are compared in one task.
PORTIONS, BLOCK = 2, 1 << 12
ORDER = ["d", "h", "line"]
#: Hashes of the two least and largest words, and of the two around zero.
KEYS = ["least", "largest", "middle"]


def _literal(values: list[int], kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines: document (id and hash), place and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line", "t"))


def _words(text: str) -> Column:
    """64-bit hashes of the distinct words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(text, SPACE), lambda word: F.xxhash64(word))), F.xxhash64(F.lit("")))


def _number(word: Column) -> Column:
    """A word's hash in ``PLACES`` bits; the last ones tell its counter, so words with one number are counted together."""
    return F.shiftrightunsigned(F.hash(word), 32 - PLACES)


def _frequency_table(docs: DataFrame) -> list[int]:
    """How often the words of each bucket occur, as a power of two; never less than their lists are long."""
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), SPACE)).alias("word"))
    counts = words.groupBy(_number(F.xxhash64("word")).bitwiseAND(BUCKETS - 1).alias("bucket")).count().toArrow()
    table = [0] * BUCKETS
    for bucket, count in zip(*(c.to_pylist() for c in counts.columns), strict=True):
        table[bucket] = min(count.bit_length(), 31)
    return table


def _ranked(words: Column, table: list[int]) -> Column:
    """The words as sorted numbers: frequency first, then bits of the hash."""
    counts = _literal(table, "int")
    return F.sort_array(F.transform(F.transform(words, _number), lambda number: F.shiftleft(
        F.coalesce(F.get(counts, number.bitwiseAND(BUCKETS - 1)), F.lit(0)), PLACES).bitwiseOR(number)))  # without nulls, sorted as plain numbers


def _shared(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100).cast("int")


def _parity(words: Column) -> Column:
    """64 bits, of which each word turns one."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, word: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.hash(word))))


def _measured(docs: DataFrame, table: list[int], percent: int) -> DataFrame:
    """One row per line with a word: two hashes that name its set, size, prefix, parity bits, and keys for leaders."""
    # tested on the text, since a test of the words would be pushed down and split every line twice
    rows = _lines(docs).where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(*ORDER, _words("t").alias("words")).select(*ORDER, F.sort_array("words").alias("words"))
    # words are sorted: those of the first 64 parity bits are the negative ones, the others have the second 64
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("below", (F.array_position(F.sort_array(F.concat("words", F.array(zero))), zero) - 1).cast("int"))
    n = F.size("words")
    return rows.select(
        *ORDER, F.xxhash64("words").alias("s1"), F.xxhash64(F.lit(1), F.col("words")).alias("s2"), n.alias("n"),
        F.slice(_ranked(F.col("words"), table), 1, n - _shared(n, percent) + 1).alias("prefix"),
        _parity(F.slice("words", 1, F.col("below"))).alias("b1"), _parity(F.slice("words", F.col("below") + 1, n)).alias("b2"),
        *(F.hash(F.get("words", at), F.get("words", at + 1)).alias(key) for key, at in zip(KEYS, (F.lit(0), n - 2, F.col("below") - 1), strict=True)))


def _sets(lines: DataFrame) -> DataFrame:
    """One row per distinct set with its first line and a number that follows the order of lines."""
    sets = lines.groupBy("s1", "s2").agg(
        F.min(F.struct(*ORDER)).alias("first"), *(F.first(c).alias(c) for c in ("n", "prefix", "b1", "b2", *KEYS)))
    sets = sets.select("first.*", "s1", "s2", "n", "prefix", "b1", "b2", *KEYS)
    return sets.orderBy(*ORDER).withColumn("id", F.monotonically_increasing_id())


def _possible(x: str, y: str, percent: int) -> Column:
    """Length and parity bits of two sets leave room for the threshold."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= _apart(n, m, percent))


def _apart(n: Column, m: Column, percent: int) -> Column:
    """Words outside the intersection, at most."""
    return n + m - 2 * F.ceil((n + m) * percent / (100 + percent))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> Step:
    """The numbers ``x`` of sets that match their partner ``y``, compared word by word.

    The lines are taken from the texts again. A bit table of fixed size leaves out most lines that have no
    candidate before they are shuffled; the join decides. Only lines with candidates are split into words.
    """
    pairs = Step(pairs, "line-pairs")
    numbers = pairs.df.select(F.col("x").alias("id")).union(pairs.df.select("y")).distinct()
    places = Step(sets.select(*ORDER, "id").join(numbers, "id"), "line-places")
    bit = F.pmod(F.xxhash64(*ORDER), F.lit(BITS))
    found = places.df.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    held = [0] * (BITS // 64)
    for at, bits in zip(*(c.to_pylist() for c in found.columns), strict=True):
        held[at] = bits
    # a subquery, since the plan's text, which the driver keeps, would hold a literal in full several times
    table = docs.sparkSession.createDataFrame([(held,)], "held array<bigint>").scalar()
    may = F.getbit(F.get(table, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1
    lines = _lines(docs).where(may).join(places.df, ORDER).dropDuplicates(ORDER)
    words = Step(lines.select("id", _words("t").alias("words")), "line-words")
    both = pairs.df.join(words.df.select(F.col("id").alias("x"), F.col("words").alias("sx")), "x").join(
        words.df.select(F.col("id").alias("y"), F.col("words").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    both = both.where(common * 100 >= (F.size("sx") + F.size("sy") - common) * percent)
    matched = Step(both.select("x").distinct(), "line-matched")
    for step in (pairs, places, words):
        step.release()
    return matched


def _leaders(sets: DataFrame, percent: int) -> DataFrame:
    """Each set ``x`` with the earliest set ``y`` of the same key."""
    keys = sets.select("id", "n", "b1", "b2", F.explode(F.array(*(F.hash(F.lit(i), F.col(k)) for i, k in enumerate(KEYS)))).alias("key"))
    leads = keys.groupBy("key").agg(F.min(F.struct("id", "n", "b1", "b2")).alias("y"), F.max("id").alias("last"))
    leads = leads.where("y.id != last").drop("last")
    pairs = keys.alias("x").join(leads, "key").where((F.col("x.id") != F.col("y.id")) & _possible("x", "y", percent))
    return pairs.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct()


def _pairs(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Entries of one list and deal: unmatched sets ``x`` with earlier sets ``y``, where length, place and parity bits allow a match."""
    x, y = x.alias("x"), y.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    common = (n + m - _apart(n, m, percent)) / 2
    place = (n - F.col("x.place") >= common) & (m - F.col("y.place") >= common)
    same = (F.col("x.word") == F.col("y.word")) & (F.col("x.deal") == F.col("y.deal"))
    pairs = x.join(y, same & (F.col("x.code") > F.abs("y.code")) & place & _possible("x", "y", percent))
    return pairs.select((F.col("x.code") - 1).alias("x"), (F.abs("y.code") - 1).alias("y"))


def _candidates(posted: DataFrame, percent: int) -> DataFrame:
    """Unmatched sets ``x`` and earlier sets ``y`` with a word of their prefixes in common.

    A list longer than ``BLOCK`` is dealt out: each of its sets to one task, each unmatched one to all of them. Words
    that the sketch shows to be rare cannot have such a list.
    """
    one = F.lit(0)
    rare = F.shiftright("word", PLACES) <= BLOCK.bit_length() - 1
    short = posted.where(rare).withColumn("deal", one)
    often = posted.where(~rare)
    lists = often.groupBy("word").count().where(F.col("count") > BLOCK)
    often = often.join(lists.select("word", F.ceil(F.col("count") / BLOCK).cast("int").alias("deals")), "word", "left")
    deals = F.coalesce("deals", F.lit(1))
    y = often.withColumn("deal", F.pmod(F.xxhash64("code"), deals).cast("int")).drop("deals")
    x = often.where("code > 0").withColumn("deal", F.explode(F.sequence(one, deals - 1))).drop("deals")
    return _pairs(short, short, percent).union(_pairs(x, y, percent)).distinct()


def matched_sets(docs: DataFrame, percent: int = 80) -> tuple[Step, Step, list[Step]]:
    """All lines with a word, all sets, and, in two parts, the numbers ``x`` of sets that match an earlier one."""
    docs = docs.select("doc_id", "text")
    lines = Step(_measured(docs, _frequency_table(docs), percent), "lines")
    all_sets = Step(_sets(lines.df), "line-sets")
    sets = all_sets.df
    first = _verified(_leaders(sets, percent), docs, sets, percent)

    known = first.df.select(F.col("x").alias("id"), F.lit(True).alias("matched"))
    code = F.when(F.col("matched"), -1 - F.col("id")).otherwise(F.col("id") + 1)  # the order of sets, negative for matched ones
    marked = Step(sets.select("id", "n", "b1", "b2", "prefix").join(known, "id", "left").select(
        code.alias("code"), "n", "b1", "b2", "prefix"), "line-marked")
    posted = marked.df.select("code", "n", "b1", "b2", F.posexplode("prefix").alias("place", "word"))
    parts = [Step(_candidates(posted.where(F.pmod("word", F.lit(PORTIONS)) == part), percent), "line-candidates")
             for part in range(PORTIONS)]
    marked.release()
    pairs = parts[0].df
    for part in parts[1:]:
        pairs = pairs.union(part.df)
    second = _verified(pairs.distinct(), docs, sets, percent)
    for part in parts:
        part.release()
    return lines, all_sets, [first, second]


def removed_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``d``, ``h`` (a document) and ``removed``, the sorted places of its lines that go; documents that lose none have no row."""
    lines, sets, matched = matched_sets(docs, percent)
    fate = matched[0].df.union(matched[1].df).select(F.col("x").alias("id"), F.lit(True).alias("gone"))
    firsts = sets.df.select("id", "s1", "s2", F.struct(*ORDER).alias("first")).join(fate, "id", "left").drop("id")
    gone = lines.df.select(*ORDER, "s1", "s2").join(firsts, ["s1", "s2"]).where((F.struct(*ORDER) != F.col("first")) | F.col("gone"))
    removed = Step(gone.groupBy("d", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")), "line-removed")
    for step in (lines, sets, *matched):
        step.release()
    return removed.df


def _with_removed(docs: DataFrame, percent: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col("*")).alias("row"), F.xxhash64(text).alias("h"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("d"))
    return rows.join(removed_lines(docs, percent), ["d", "h"], "left")


def decisions(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and the removed places of every row.

    Null and empty texts and lines without a word lose nothing. Rows without doc_id come first. Repeated
    rows are one document: each of them gets the same result. The order of other rows with one doc_id is that of a hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    slim = docs.select(F.col("doc_id"), F.size(has_word).cast("bigint").alias("n_lines"), F.xxhash64(text).alias("h"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("d"))
    none = F.array().cast("array<int>")
    removed = F.coalesce("removed", none)
    return slim.join(removed_lines(docs, percent), ["d", "h"], "left").select(
        "doc_id", "n_lines", F.size(removed).cast("bigint").alias("n_removed"), removed.alias("removed"))


def cleaned(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without the removed lines, in their own columns.

    A document that loses its last line with a word goes altogether; one that had none stays as it is.
    """
    rows = _with_removed(docs, percent)
    lines = F.split("row.text", "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed"), lambda i: F.get(lines, i))
    rows = rows.select("row", "removed", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(rest, "\n")).alias("new"))
    rows = rows.where(F.col("removed").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
