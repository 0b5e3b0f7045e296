"""Replace, append, upsert, export, quarantine and clustered writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import text
from ferrywell.operators.cleaning import COPIES, column
from ferrywell.session import Staged
from ferrywell.sinks.versioned import State, VersionedTable

#: An XML file is read by one task, so it gets at most so many rows.
XML_ROWS = 100_000


def export_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    """Write each row as an element, in as many files as tasks need to share the reading."""
    df.write.option("rowTag", row_tag).option("rootTag", root_tag).option("maxRecordsPerFile", XML_ROWS).xml(path)


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Write a result as csv with header, json (one record per line, nulls kept) or parquet.

    CSV cells are written as they are: white space kept, quotes doubled, line breaks inside quotes. An
    empty text is written as ``""`` and a null as nothing.
    """
    writer = df.write
    if fmt == "csv":
        writer.options(**text.CSV_WRITE).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def replace_table(target: VersionedTable, rows: DataFrame, state: dict[str, str] | None = None) -> int:
    return target.replace(rows, state)


def append_table(target: VersionedTable, rows: DataFrame, state: State = None) -> int:
    return target.append(rows, state)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Removed rows, filed under their reason."""
    df.write.partitionBy("reason").mode("append").parquet(path)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the highest in ``order``, then in the remaining columns; and the rows it stands for.

    A max over structs combines on the map side, so a key with very many rows shrinks to one
    row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordered = F.struct(*[column(c) for c in [*order, *rest]])
    return (
        df.groupBy(*[column(k) for k in keys])
        .agg(F.max(ordered).alias("__row"), F.count(F.lit(1)).alias(COPIES))
        .select(*[column(k) for k in keys], "__row.*", COPIES)
        .select(*[column(c) for c in df.columns], COPIES)
    )


def upsert_rows(
    target: VersionedTable, changes: DataFrame, order: list[str], measures: list[str], state_of: Callable[[Row], dict]
) -> Row:
    """Upsert, and publish what ``state_of`` makes of the batch's measures; returns the measures.

    The rows of the batch are staged once, so that a source is read only once.
    """
    base = target.commit()
    staged = Staged(latest_per_key(changes, target.keys, order), "upsert")
    try:
        found = target.summary(staged.df, [f"coalesce(sum({COPIES}), 0L) as rows", *measures])
        batch = staged.df.drop(COPIES)
        if base is None:
            target.replace(batch, state_of(found))
        elif found.touched:
            # which side is small enough to broadcast is left to the sizes Spark measures
            old = target.read(found.touched, base)
            kept = old.join(batch.select(*target.keys), target.keys, "left_anti")
            target.replace_buckets(kept.unionByName(batch), found.touched, base, state_of(found))
        elif state_of(found):
            target.set_state(state_of(found))
        return found
    finally:
        staged.release()


def upsert_table(
    target: VersionedTable, changes: DataFrame, order: list[str], state: dict[str, str] | None = None
) -> int:
    """Rows with a key of the batch are replaced, new keys are added; returns the version."""
    upsert_rows(target, changes, order, [], lambda found: state or {})
    return target.version


def pick_cluster_keys(
    dialect: str,
    types: dict[str, str],
    primary_key: list[str] = (),
    unique_index: list[str] = (),
    clustered_index: list[str] = (),
) -> list[str]:
    """Layout columns by the habits of the source system; at most two dates or three key columns."""
    primary_key, dialect = list(primary_key), dialect.lower()
    dates = [c for c, t in types.items() if any(k in t.lower() for k in ("timestamp", "date"))]
    times = [c for c, t in types.items() if "time" in t.lower() or c in dates]
    if dialect in ("sqlserver", "mssql") and clustered_index:
        return list(clustered_index)[:3]
    if dialect in ("postgresql", "postgres"):
        return (times or primary_key)[:2]
    if dialect == "erp":
        return (dates or primary_key)[:2]
    if dialect == "oracle":
        if unique_index:
            return list(unique_index)[:3]
        return primary_key[:3] or dates[:2]
    return primary_key[:3]


#: Ranks that the curve tells apart in each column, as a power of two.
CURVE_BITS = 8


def _as_number(df: DataFrame, name: str) -> Column:
    """A number in the column's order; of texts the first seven bytes."""
    kind, c = df.schema[name].dataType, column(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        start = F.rpad(F.substring(F.encode(c.cast("string"), "utf-8"), 1, 7), 7, F.lit(b"\0"))
        return F.conv(F.hex(start), 16, 10).cast("bigint")
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    return c


def curve_place(df: DataFrame, keys: list[str]) -> Column:
    """A row's place on a space-filling curve through its keys: the bits of their ranks in turn.

    Ranks come from each column's quantiles, of which there are a fixed number however large the table
    is, so skewed columns are told apart as well as even ones. Nulls come first.
    """
    shares = ", ".join(f"{i / (1 << CURVE_BITS)}D" for i in range(1, 1 << CURVE_BITS))
    numbers = df.select(*[_as_number(df, k).alias(f"k{i}") for i, k in enumerate(keys)])
    bounds = numbers.agg(*[F.expr(f"percentile_approx(k{i}, array({shares}))").alias(f"k{i}") for i in range(len(keys))]).first()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(CURVE_BITS))])
    place = F.lit(0).cast("bigint")
    for i, key in enumerate(keys):
        if bounds[i] is None:
            continue  # nothing but nulls
        number, limits = _as_number(df, key), F.lit(list(bounds[i])).cast(T.ArrayType(numbers.schema[i].dataType))
        rank = F.aggregate(steps, F.lit(0), lambda r, step: r + F.when(number >= F.get(limits, r + step - 1), step).otherwise(0))
        for b in range(CURVE_BITS):
            bit = F.shiftright(rank, b).bitwiseAND(1).cast("bigint")
            place = place.bitwiseOR(F.shiftleft(bit, b * len(keys) + len(keys) - 1 - i))
    return place


def clustered_write(df: DataFrame, path: str, keys: list[str], partitions: int | None = None, curve: bool = False) -> None:
    """Lay the table out by key ranges so that readers skip files by their column statistics.

    In the order of the keys only a filter on the first one skips files; along the ``curve`` a filter on
    any of them skips some. The number of the reading task comes after the keys, so a range boundary can fall inside one
    key value, and a hot key is spread over several tasks. Unlike a random number it is the same
    when a lost task is repeated.
    """
    ties = df.withColumn("__task", F.spark_partition_id())
    by = [column(k) for k in keys]
    if curve:
        ties = ties.withColumn("__place", curve_place(df, keys))
        by = [F.col("__place"), *by]
    order = [by[0], F.col("__task")] if curve else [*by, F.col("__task")]
    ranged = ties.repartitionByRange(partitions, *order) if partitions else ties.repartitionByRange(*order)
    ranged.sortWithinPartitions(*by).drop("__task", "__place").write.parquet(path)


def files_met(df: DataFrame, condition_on: str, low, high) -> DataFrame:
    """(files, met): how many files a written table has, and how many a filter on a range of a column cannot skip."""
    files = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(column(condition_on)).alias("a"), F.max(column(condition_on)).alias("z"))
    return files.agg(F.count("*").alias("files"), F.count_if((F.col("a") <= high) & (F.col("z") >= low)).alias("met"))
