"""Cleaning: trimming, null tokens, empty rows, duplicates, numeric coercion, outliers, quarantine.

Two profiles exist and differ on purpose. ``strict`` also trims headers, removes outliers and
keeps every removed row with its reason; ``basic`` has its own token list and keeps none.
"""

from __future__ import annotations

import math
from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import errors, text
from ferrywell.session import Staged

if TYPE_CHECKING:
    from ferrywell.sinks.versioned import VersionedTable

# The reasons given to removed rows.
EMPTY = "All values missing"
DUPLICATE = "Duplicate row"
OUTLIER = "Statistical outlier (z>5)"

COPIES = "__copies"
# Rows written out per task when a group of copies is expanded again.
EXPAND_CHUNK = 100_000


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def quoted(name: str) -> str:
    """A column's literal name for use in SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """A text for use in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    return F.col(quoted(name))


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip(text.WHITESPACE) for c in df.columns])


def trim_cells(df: DataFrame) -> DataFrame:
    return df.withColumns({c: text.stripped(column(c)) for c in string_columns(df)})


def null_tokens(df: DataFrame, profile: str = "strict", trimmed: bool = False) -> DataFrame:
    return df.withColumns(
        {c: F.when(~text.is_null_token(column(c), profile, trimmed), column(c)) for c in string_columns(df)}
    )


def all_null(df: DataFrame) -> Column:
    tests = []
    for f in df.schema:
        c = column(f.name)
        is_float = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        tests.append(c.isNull() | F.isnan(c) if is_float else c.isNull())
    return reduce(Column.__and__, tests)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(~all_null(df))


def nan_as_null(df: DataFrame) -> DataFrame:
    """A missing number is null, however it is written, so that rows with either are equal."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(column(c)), column(c)) for c in floats})


def count_copies(df: DataFrame) -> DataFrame:
    """One row per distinct row with its number of copies; copies merge before the shuffle."""
    df = nan_as_null(df)
    return df.groupBy(*[column(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(COPIES))


def expand_copies(grouped: DataFrame, copies: Column) -> DataFrame:
    """Repeat each row ``copies`` times without ever building one long array.

    A group may hold a third of the table, so its rows are first cut into chunks, the chunks
    are spread over the cluster, and each chunk is then written out on its own.
    """
    names = [c for c in grouped.columns if c != COPIES]
    chunk = F.lit(EXPAND_CHUNK)
    counted = grouped.withColumn(COPIES, copies).where(F.col(COPIES) > 0)
    chunks = counted.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(COPIES) - 1) / chunk)))
    ).withColumn("__rows", F.least(chunk, F.col(COPIES) - F.col("__chunk") * chunk))
    return (
        chunks.repartition(*[column(n) for n in names], F.col("__chunk"))
        .withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__rows"))))
        .select(*[column(n) for n in names])
    )


def dedup_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of identical rows; nulls equal nulls, and NaN is a null."""
    return nan_as_null(df).dropDuplicates()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """The surplus copies that ``dedup_rows`` leaves out, one row per copy."""
    return expand_copies(count_copies(df), F.col(COPIES) - 1)


def numeric_share(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Per string column: how many values are present, and how many are written as numbers."""
    names = string_columns(df)
    if not names:
        return {}
    row = df.agg(
        *[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.count_if(text.looks_numeric(column(c))).alias(f"p{i}") for i, c in enumerate(names)],
    ).first()
    return {c: (row[f"n{i}"], row[f"p{i}"]) for i, c in enumerate(names)}


def numeric_texts(shares: dict[str, tuple[int, int]], ratio: float) -> list[str]:
    return [c for c, (present, parsed) in shares.items() if present and parsed / present >= ratio]


def coerce_numeric(df: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Turn a string column into numbers when enough of its values are written as numbers."""
    chosen = numeric_texts(numeric_share(df), ratio)
    return df.withColumns({c: text.parsed_number(column(c)) for c in chosen})


def finite(c: Column) -> Column:
    """The value where it is an ordinary number, else null. NaN is greater than every number."""
    return F.when(F.abs(c) < float("inf"), c)


def _as_number(df: DataFrame, name: str) -> Column:
    return finite(column(name).cast("double"))


def _is_outlier(limits: list[tuple[Column, float | None, float | None]], z: float) -> Column:
    """True where any of the (value, mean, deviation) triples is further than z deviations off.

    Values and statistics are of finite numbers only. An infinite value is no outlier by itself: it
    has no distance in deviations. The deviation of very large numbers can overflow; then none is far.
    """
    tests = [
        F.coalesce(F.abs((value - F.lit(mean)) / F.lit(deviation + 1e-9)) > z, F.lit(False))
        for value, mean, deviation in limits
        if mean is not None and math.isfinite(mean) and math.isfinite(deviation)
    ]
    return reduce(Column.__or__, tests, F.lit(False))


def outlier_flag(df: DataFrame, z: float = 5.0) -> Column:
    names = numeric_columns(df)
    if not names:
        return F.lit(False)
    row = df.agg(
        *[F.avg(_as_number(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
        *[F.stddev_pop(_as_number(df, c)).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    return _is_outlier([(_as_number(df, c), row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names)], z)


def zscore_outliers(df: DataFrame, z: float = 5.0) -> DataFrame:
    """Remove rows with a numeric value more than z population deviations from its mean."""
    return df.where(~outlier_flag(df, z))


def preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[column(c) for c in order]).limit(n)


def classify_errors(df: DataFrame, message: str = "message") -> DataFrame:
    """How often each likely cause occurs, with its fix; unmatched texts have no cause."""
    counted = df.groupBy(errors.rule_number(column(message)).alias("rule")).agg(F.count(F.lit(1)).alias("errors"))
    return counted.select(
        errors.cause_of(F.col("rule")).alias("likely_cause"), errors.fix_of(F.col("rule")).alias("fix"), "errors"
    )


class CleanResult:
    """A cleaned table, the rows that were removed with their reason, and the counts of each step."""

    def __init__(self, raw: DataFrame, profile: str, ratio: float, z: float | None):
        self._profile = profile
        self._raw = trim_headers(raw) if profile == "strict" else raw
        self._names = self._raw.columns
        self._texts = string_columns(self._raw)
        self._numbers = numeric_columns(self._raw)
        # One shuffle serves empty rows, duplicates and their counts: identical rows meet in one group.
        cells = null_tokens(trim_cells(self._raw), profile, trimmed=True)
        self._staged = Staged(count_copies(cells), "clean")
        self._grouped = self._staged.df
        self._is_empty = all_null(cells)
        self._stats = self._measure()
        self._chosen = [
            (i, c) for i, c in enumerate(self._texts)
            if self._stats[f"n{i}"] and self._stats[f"p{i}"] / self._stats[f"n{i}"] >= ratio
        ]
        self._far = F.lit(False) if z is None else self._outlier(z)

    def _measure(self):
        """One pass over the distinct rows decides the coercion and gives the outlier statistics."""
        judged = self._grouped.select(
            F.col(COPIES).alias("copies"),
            self._is_empty.alias("empty"),
            *[column(c).isNotNull().alias(f"has{i}") for i, c in enumerate(self._texts)],
            *[text.parsed_number(column(c)).alias(f"t{i}") for i, c in enumerate(self._texts)],
            *[finite(text.parsed_number(column(c))).alias(f"u{i}") for i, c in enumerate(self._texts)],
            *[_as_number(self._raw, c).alias(f"x{i}") for i, c in enumerate(self._numbers)],
        )
        measures = [
            "sum(copies) as total",
            "sum(copies) filter (where empty) as empty",
            "sum(copies - 1) filter (where not empty) as surplus",
            "count_if(not empty) as distinct",
        ]
        for i, _ in enumerate(self._texts):
            measures += [f"count_if(has{i}) as n{i}", f"count(t{i}) as p{i}"]
            measures += [f"avg(u{i}) as tm{i}", f"stddev_pop(u{i}) as ts{i}"]
        for i, _ in enumerate(self._numbers):
            measures += [f"avg(x{i}) as m{i}", f"stddev_pop(x{i}) as s{i}"]
        return judged.agg(*[F.expr(m) for m in measures]).first()

    def _outlier(self, z: float) -> Column:
        s = self._stats
        limits = [(_as_number(self._raw, c), s[f"m{i}"], s[f"s{i}"]) for i, c in enumerate(self._numbers)]
        limits += [(finite(text.parsed_number(column(c))), s[f"tm{i}"], s[f"ts{i}"]) for i, c in self._chosen]
        return _is_outlier(limits, z)

    @property
    def _filled(self) -> DataFrame:
        return self._grouped.where(~self._is_empty)

    @cached_property
    def cleaned(self) -> DataFrame:
        kept = self._filled.where(~self._far).drop(COPIES)
        return kept.withColumns({c: text.parsed_number(column(c)) for _, c in self._chosen})

    @cached_property
    def quarantine(self) -> DataFrame:
        """Removed rows with their reason; texts are as they were before coercion."""
        copies = F.col(COPIES)
        return reduce(
            DataFrame.unionByName,
            [
                expand_copies(self._grouped.where(self._is_empty), copies).withColumn("reason", F.lit(EMPTY)),
                expand_copies(self._filled, copies - 1).withColumn("reason", F.lit(DUPLICATE)),
                self._filled.where(self._far).drop(COPIES).withColumn("reason", F.lit(OUTLIER)),
            ],
        )

    @cached_property
    def report(self) -> DataFrame:
        """(step, column, rows): rows in, removed and out, and cells changed per column."""
        s = self._stats
        steps = [
            ("rows in", None, s["total"] or 0),
            ("empty rows removed", None, s["empty"] or 0),
            ("duplicates removed", None, s["surplus"] or 0),
            ("columns", None, len(self._names)),
        ]
        steps += [("text to numeric", c, s[f"p{i}"]) for i, c in self._chosen]
        steps += [("values lost in coercion", c, s[f"n{i}"] - s[f"p{i}"]) for i, c in self._chosen]
        known = self._raw.sparkSession.createDataFrame(steps, "step string, column string, rows bigint")
        outcome = self._filled.agg(
            F.count_if(~self._far).alias("rows out"), F.count_if(self._far).alias("outliers removed")
        ).selectExpr("stack(2, 'rows out', null, `rows out`, 'outliers removed', null, `outliers removed`) as (step, column, rows)")
        return known.unionByName(outcome).unionByName(_changed_cells(self._raw, self._profile))

    def release(self) -> None:
        """Drop the staged rows once the results have been written."""
        self._staged.release()


def _changed_cells(raw: DataFrame, profile: str) -> DataFrame:
    """(step, column, rows) for the trimmed cells and the null tokens of each text column."""
    names = string_columns(raw)
    if not names:
        return raw.sparkSession.createDataFrame([], "step string, column string, rows bigint")
    counts, cells = [], []
    for i, c in enumerate(names):
        trimmed = text.stripped(column(c))
        counts.append(F.count_if(trimmed != column(c)).alias(f"trimmed{i}"))
        counts.append(F.count_if(text.is_null_token(trimmed, profile, True)).alias(f"nulls{i}"))
        cells.append(f"'trimmed', {literal(c)}, trimmed{i}, 'null tokens', {literal(c)}, nulls{i}")
    return raw.agg(*counts).selectExpr(f"stack({2 * len(names)}, {', '.join(cells)}) as (step, column, rows)")


def clean_strict(df: DataFrame, ratio: float = 0.85, z: float = 5.0) -> CleanResult:
    """Headers, cells, null tokens, empty rows, duplicates, numeric coercion, outliers."""
    return CleanResult(df, "strict", ratio, z)


def clean_basic(df: DataFrame, name: str, ratio: float = 0.85, target: VersionedTable | None = None) -> CleanResult:
    """Cells, null tokens, empty rows, duplicates, numeric coercion; result viewed as ``<name>_cleaned``.

    With a ``target`` the result is stored there, the view reads the stored table, and nothing stays staged.
    """
    result = CleanResult(df, "basic", ratio, None)
    if target is None:
        result.cleaned.createOrReplaceTempView(f"{name}_cleaned")
    else:
        target.replace(result.cleaned)
        target.read().createOrReplaceTempView(f"{name}_cleaned")
        result.release()
    return result
