"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document. The ledger keeps its result as one bit, beside the
numbers the rule looked at; a policy is a version and a set of bits. Applying another policy, or
asking what a single rule costs, reads only the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywell.llm.columns import nested, split_words

WINDOW = 8
#: Name and condition of failure; the place in the list is the bit. New rules go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("capitals", "100 * n_capitals > 30 * word_chars"),
    ("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("stutter", "10 * n_stutter > 2 * n_words"),
)
BITS = {name: 1 << place for place, (name, _) in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_stutter")


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeats"))
CURRENT = Policy("2", (*BASE.rules, "symbols", "capitals", "repeated_lines", "stutter"))


def with_ledger(docs: DataFrame) -> DataFrame:
    """The columns ``row`` (the whole input row) and ``ledger`` (measurements and ``failed`` bits).

    Row by row without a shuffle, so repeated rows and any doc_id are fine. Null and empty texts
    measure zero everywhere and fail ``few_words``. Long texts are taken whole.
    """
    spaces = r"[^\x20\x09-\x0D]"
    step = nested(docs).select(
        "row", "text", split_words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(spaces)).alias("lines"))
    words, n = F.col("words"), F.size("words")
    step = step.select(
        "row", "words",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("bigint").alias("n_stutter"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).alias("hashes"))
    # few texts repeat a window; only they compare the windows themselves
    step = step.withColumn("grams", F.when(
        F.size("hashes") > F.size(F.array_distinct("hashes")),
        F.array_sort(F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("gram"), i.alias("place"))))))
    grams = F.col("grams")
    same = lambda g, i: F.get(grams, i)["gram"] == g["gram"]
    step = step.withColumn("places", F.array_sort(F.transform(
        F.filter(grams, lambda g, i: F.coalesce((i > 0) & same(g, i - 1), F.lit(False)) | F.coalesce(same(g, i + 1), F.lit(False))),
        lambda g: g["place"])))
    step = step.withColumn("n_repeat_words", F.coalesce(_covered(F.col("places")), F.lit(0)).cast("bigint"))
    failed = sum((F.when(F.expr(rule), F.lit(1 << place)).otherwise(0) for place, (_, rule) in enumerate(RULES)), F.lit(0))
    step = step.withColumn("failed", failed.cast("bigint"))
    return step.select("row", F.struct(*MEASURES, "failed").alias("ledger"))


def _covered(places: Column) -> Column:
    """Words inside the windows that start at the given sorted places."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places, start,
        lambda seen, p: F.struct((seen["total"] + F.least(F.lit(WINDOW), p - seen["last"])).alias("total"), p.alias("last")),
        lambda seen: seen["total"])


def ledger(docs: DataFrame) -> DataFrame:
    """One line per document: doc_id, source (where there is one), measurements, failed bits."""
    source = [F.col("row.source").alias("source")] if "source" in docs.columns else []
    return with_ledger(docs).select("row.doc_id", *source, "ledger.*")


def kept(failed: Column, policy: Policy = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def filtered(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their own columns."""
    # the condition needs a column that is not repeatable, so that it is not moved below the
    # measurements, which would write all of them out again for each use
    fenced = with_ledger(docs).withColumn("fence", F.monotonically_increasing_id())
    return fenced.where(kept(F.col("ledger.failed"), policy) & (F.col("fence") >= 0)).select("row.*")


def ablations(lines: DataFrame, policy: Policy = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """What each rule of a policy does, from the ledger alone.

    Per rule: documents that fail it, documents it alone rejects (they would stay without it),
    and the other rules that ever fail with it, as bits. Lines are first counted per distinct set of
    bits, of which there are at most two to the number of rules.
    """
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    patterns = lines.groupBy(*by, hit.alias("hit")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")) for r in policy.rules)))
    each = patterns.select("*", rules.alias("of")).where(F.col("hit").bitwiseAND(F.col("of.bit")) != 0)
    return each.groupBy(*by, F.col("of.rule").alias("rule"), F.col("of.bit").alias("bit")).agg(
        F.sum("n").alias("fails"),
        F.sum(F.when(F.col("hit") == F.col("of.bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.bit_or("hit").alias("seen_with")).withColumn("policy", F.lit(policy.version))
