"""Contracts: what a table's columns have to be, and the rows that break it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import text
from ferrywell.functions.types import spark_type
from ferrywell.operators.cleaning import column
from ferrywell.session import Staged


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # a target type such as NUMBER(12,2) or VARCHAR(40)
    nullable: bool = True
    pk: bool = False


def contract_from(df: DataFrame, table: str) -> list[Field]:
    """A contract kept as a table with ``table, column, type, nullable, pk``: one row per column."""
    rows = df.where(F.col("table") == table).select("column", "type", "nullable", "pk").collect()
    return [Field(*row) for row in rows]


def max_length(target: str) -> int | None:
    found = re.fullmatch(r"VARCHAR\((\d+)\)", target)
    return int(found.group(1)) if found else None


def number_size(target: str) -> tuple[int, int] | None:
    found = re.fullmatch(r"NUMBER\((\d+),(\d+)\)", target)
    return (int(found.group(1)), int(found.group(2))) if found else None


def _as_number(c: Column, kind: T.DataType) -> Column:
    """Text only counts as a number when it is written as one; casts alone accept more."""
    return F.when(text.looks_numeric(c), c) if isinstance(kind, T.StringType) else c


def conformed(c: Column, kind: T.DataType, target: str) -> Column:
    """The value as the target type, or null where it does not fit."""
    wanted = spark_type(target)
    size = number_size(target)
    if size is not None:
        return _as_number(c, kind).try_cast(T.DecimalType(*size)).try_cast(wanted)
    if target.startswith("NUMBER") or target == "FLOAT":
        return _as_number(c, kind).try_cast(wanted)
    if target == "TIME" and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "HH:mm:ss")
    return c.try_cast(wanted)


def conform(df: DataFrame, contract: list[Field]) -> DataFrame:
    """The contract's columns in its order and types; values that do not fit become null."""
    return df.select(
        *[conformed(column(f.name), df.schema[f.name].dataType, f.type).alias(f.name) for f in contract]
    )


def conform_violations(df: DataFrame, contract: list[Field]) -> DataFrame:
    """Per column: values of the wrong kind, numbers too large for it, texts too long for it, numbers it rounds."""
    measures, facts = [], []
    for i, f in enumerate(contract):
        c, kind = column(f.name), df.schema[f.name].dataType
        size, limit = number_size(f.type), max_length(f.type)
        overflow = rounded = F.lit(False)
        if size is not None:
            exact = T.DecimalType(38, 18)
            rounded = F.coalesce(conformed(c, kind, f.type).cast(exact) != _as_number(c, kind).try_cast(exact), F.lit(False))
            is_number = _as_number(c, kind).try_cast("double").isNotNull()
            overflow = is_number & conformed(c, kind, f.type).isNull()
            failed = c.isNotNull() & ~is_number
        else:
            failed = c.isNotNull() & conformed(c, kind, f.type).isNull()
        too_long = F.length(c) > limit if limit is not None else F.lit(False)
        measures += [
            F.count_if(failed).alias(f"f{i}"),
            F.count_if(overflow).alias(f"o{i}"),
            F.count_if(too_long).alias(f"l{i}"),
            F.count_if(rounded).alias(f"r{i}"),
        ]
        facts.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.type).alias("target_type"),
                F.col(f"f{i}").alias("cast_failures"),
                F.col(f"o{i}").alias("overflows"),
                F.col(f"l{i}").alias("over_length"),
                F.col(f"r{i}").alias("lost_fractions"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*facts)))


#: A rule: its column, its name, and the test of a row that breaks it.
Rule = tuple[str, str, Column]
#: Rules that one word of a mask holds.
WORD = 63


def _per_column(df: DataFrame, tests: list[Rule]) -> DataFrame:
    """(column_name, rule, violations) for row tests, all counted in one pass."""
    if not tests:
        return df.sparkSession.createDataFrame([], "column_name string, rule string, violations bigint")
    facts = [
        F.struct(F.lit(name).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (name, rule, _) in enumerate(tests)
    ]
    return df.agg(*[F.count_if(test).alias(f"v{i}") for i, (_, _, test) in enumerate(tests)]).select(
        F.inline(F.array(*facts))
    )


def _null_rules(contract: list[Field]) -> list[Rule]:
    return [(f.name, "NOT NULL", column(f.name).isNull()) for f in contract if not f.nullable or f.pk]


def _size_rules(df: DataFrame, contract: list[Field]) -> list[Rule]:
    tests = []
    for f in contract:
        limit, size = max_length(f.type), number_size(f.type)
        c = column(f.name)
        if limit is not None:
            tests.append((f.name, f.type, F.length(c.cast("string")) > limit))
        if size is not None:
            fits = conformed(c, df.schema[f.name].dataType, f.type).isNotNull()
            tests.append((f.name, f.type, c.isNotNull() & ~fits))
    return tests


def contract_nulls(df: DataFrame, contract: list[Field]) -> DataFrame:
    return _per_column(df, _null_rules(contract))


def contract_lengths(df: DataFrame, contract: list[Field]) -> DataFrame:
    """Texts longer than VARCHAR(n), and numbers that do not fit NUMBER(p,s)."""
    return _per_column(df, _size_rules(df, contract))


class ContractLedger:
    """Every row with a mask of the rules that it breaks, one bit a rule; written once, read by all its views.

    The key rule marks all rows of a repeated key. Repeated keys are counted on the map side and joined
    back, so a key with very many rows stays one row on that side.
    """

    REPEATED = "__repeated"
    BROKEN = "__broken"

    def __init__(self, df: DataFrame, contract: list[Field]):
        self.columns = df.columns
        self.rules = _null_rules(contract) + _size_rules(df, contract)
        keys = [f.name for f in contract if f.pk]
        marked = df
        if keys:
            self.rules.append((", ".join(keys), "PRIMARY KEY", F.col(self.REPEATED)))
            repeats = df.groupBy(*[column(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
            same = reduce(Column.__and__, [column(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
            marked = df.join(repeats.where("__n > 1"), same, "left").withColumn(self.REPEATED, F.col("__n").isNotNull())
        words = []
        for at in range(0, len(self.rules), WORD):
            bits = [F.when(F.coalesce(test, F.lit(False)), F.lit(1 << i)).otherwise(0).cast("bigint")
                    for i, (_, _, test) in enumerate(self.rules[at:at + WORD])]
            words.append(reduce(Column.bitwiseOR, bits))
        none = F.array().cast("array<bigint>")
        mask = F.array(*words) if words else none
        self.staged = Staged(marked.select(*map(column, df.columns), mask.alias(self.BROKEN)), "contract-ledger")

    def _bit(self, i: int) -> Column:
        return F.col(self.BROKEN)[i // WORD].bitwiseAND(F.lit(1 << i % WORD)) != 0

    @property
    def _whole(self) -> Column:
        return F.forall(self.BROKEN, lambda word: word == 0)

    def kept(self) -> DataFrame:
        """The rows that keep all rules."""
        return self.staged.df.where(self._whole).drop(self.BROKEN)

    def quarantine(self) -> DataFrame:
        """The other rows, with their mask and the rules they break as ``reason``."""
        names = [F.when(self._bit(i), f"{name}: {rule}") for i, (name, rule, _) in enumerate(self.rules)]
        broken = self.staged.df.where(~self._whole)
        return broken.select(*map(column, self.columns), F.col(self.BROKEN).alias("broken"), F.concat_ws("; ", *names).alias("reason"))

    def counts(self) -> DataFrame:
        """(column_name, rule, violations): rows are counted by mask, and the few masks by their bits."""
        masks = self.staged.df.groupBy(self.BROKEN).agg(F.count(F.lit(1)).alias("__n"))
        facts = [
            F.struct(F.lit(name).alias("column_name"), F.lit(rule).alias("rule"), F.when(self._bit(i), F.col("__n")).otherwise(0).alias("n"))
            for i, (name, rule, _) in enumerate(self.rules)
        ]
        if not facts:
            return self.staged.spark.createDataFrame([], "column_name string, rule string, violations bigint")
        return masks.select(F.inline(F.array(*facts))).groupBy("column_name", "rule").agg(F.sum("n").alias("violations"))


def contract_pk(df: DataFrame, contract: list[Field]) -> DataFrame:
    """(key_columns, repeated_keys, rows_in_repeats); counts combine on the map side."""
    keys = [f.name for f in contract if f.pk]
    if not keys:
        raise ValueError("the contract names no primary key")
    repeats = df.groupBy(*[column(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return repeats.agg(
        F.count(F.lit(1)).alias("repeated_keys"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_in_repeats"),
    ).select(F.lit(", ".join(keys)).alias("key_columns"), "repeated_keys", "rows_in_repeats")


def check_contract(df: DataFrame, contract: list[Field]) -> DataFrame:
    """All rules that are broken, as (column_name, rule, violations)."""
    found = contract_nulls(df, contract).unionByName(contract_lengths(df, contract))
    if any(f.pk for f in contract):
        found = found.unionByName(
            contract_pk(df, contract).select(
                F.col("key_columns").alias("column_name"),
                F.lit("PRIMARY KEY").alias("rule"),
                F.col("rows_in_repeats").alias("violations"),
            )
        )
    return found.where("violations > 0")


def standard_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Column names by alias if there is one, then upper case or quoted."""
    aliases = aliases or {}
    return df.toDF(*[text.standard_identifier_of(aliases.get(c, c)) for c in df.columns])


def business_names(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Add ``standard_name`` to a table of technical names; ``aliases`` has ``technical, business``."""
    joined = names.join(aliases.withColumnRenamed("technical", name), name, "left")
    known = F.coalesce(F.col("business"), column(name))
    return joined.withColumn("standard_name", text.standard_identifier(known)).drop("business")


def contract_table(spark: SparkSession, table: str, contract: list[Field]) -> DataFrame:
    rows = [(table, f.name, f.type, f.nullable, f.pk) for f in contract]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean, pk boolean")
