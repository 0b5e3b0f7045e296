"""Change-data-capture: numbered change feeds and JSON change logs, last change per key wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions.positions import bound, is_number, position
from ferrywell.operators.cleaning import column
from ferrywell.session import Staged
from ferrywell.sinks.versioned import VersionedTable

# Operation codes of a numbered feed.
DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4
SYSTEM = ["op", "lsn", "seq"]

# Position and tombstone columns that a change-applied target carries besides its data.
POSITION, DELETED = "__position", "__deleted"
HIGHEST = "highest position"
# Where a row began anew, and where each of its values comes from (targets of partial changes).
CUT, PLACES = "__cut", "__places"
# Which columns a change gives; null or no such column: all.
NAMED = "__named"

CHANGE_SCHEMA = (
    "action string, "
    "columns array<struct<name: string, value: string>>, "
    "identity array<struct<name: string, value: string>>, "
    "_broken string"
)
# Action names of a JSON log.
ACTIONS = {"I": INSERT, "insert": INSERT, "U": AFTER, "update": AFTER, "D": DELETE, "delete": DELETE}


def cdc_window(feed: DataFrame, from_lsn=None, to_lsn=None) -> DataFrame:
    """Changes after ``from_lsn`` (exclusive, it was applied by the last run) up to ``to_lsn``.

    Whole numbers are compared as they are, so that the scan can skip files; other positions by their bytes.
    """
    kind = feed.schema["lsn"].dataType
    place = F.col("lsn") if is_number(kind) else position(F.col("lsn"), kind)

    def given(value) -> Column:
        return F.lit(int(value)) if is_number(kind) else bound(value, kind)

    if from_lsn is not None:
        feed = feed.where(place > given(from_lsn))
    if to_lsn is not None:
        feed = feed.where(place <= given(to_lsn))
    return feed


def _places(feed: DataFrame) -> list[Column]:
    """Position and sequence number in a form that compares."""
    kinds = [feed.schema[c].dataType for c in ("lsn", "seq")]
    return [F.col(c) if is_number(kind) else position(F.col(c), kind) for c, kind in zip(("lsn", "seq"), kinds, strict=True)]


def cdc_latest(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of every key, with its operation and position; before-images are dropped.

    A max over structs combines on the map side, so a key with very many changes shrinks to
    one row per task before the shuffle. Equal positions are settled by operation, then values.
    """
    rest = [c for c in feed.columns if c not in keys and c not in SYSTEM]
    # a map or variant cannot be ordered, but its text can
    plain = [F.to_json(F.struct(column(c))) if isinstance(feed.schema[c].dataType, (T.MapType, T.VariantType)) else column(c) for c in rest]
    ordered = F.struct(*_places(feed), "op", *plain)
    return (
        feed.where(F.col("op") != BEFORE)
        .groupBy(*[column(k) for k in keys])
        .agg(F.max_by(F.struct(*[column(c) for c in [*rest, *SYSTEM]]), ordered).alias("__row"))
        .select(*[column(k) for k in keys], *[F.col("__row")[c].alias(c) for c in [*rest, *SYSTEM]])
    )


def cdc_apply(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The target after the feed: changed keys leave it, their last images enter unless deleted.

    The last changes are staged: they are read twice, and a feed can be costly to parse and sort. A
    change without a key is refused.
    """
    latest = Staged(cdc_latest(feed, keys), "changes").df
    if not latest.where(reduce(Column.__or__, [column(k).isNull() for k in keys])).isEmpty():
        raise ValueError(f"a change has no value for one of its keys {keys}")
    kept = target.join(latest.select(*keys), keys, "left_anti")
    images = latest.where(F.col("op") != DELETE).select(*[column(c) for c in target.columns])
    return kept.unionByName(images)


def cdc_counts(feed: DataFrame) -> DataFrame:
    return feed.agg(
        F.count_if(F.col("op") == INSERT).alias("inserts"),
        F.count_if(F.col("op") == AFTER).alias("updates"),
        F.count_if(F.col("op") == DELETE).alias("deletes"),
    )


def _last_of_each_name(entries: Column) -> Column:
    """Repeated names in one change: the later entry counts."""
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["name"] == e["name"]
        ),
    )


def _read_change(change: Column) -> Column:
    entries = F.coalesce(change["columns"], change["identity"])
    nameless = F.coalesce(F.exists(entries, lambda e: e["name"].isNull()), F.lit(False))
    valid = change["_broken"].isNull() & change["action"].isNotNull() & ~nameless
    codes = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return F.struct(
        F.when(valid, change["action"]).alias("action"),
        F.when(valid, F.try_element_at(codes, change["action"])).alias("op"),
        F.when(valid, F.map_from_entries(_last_of_each_name(entries))).alias("cells"),
    )


def parse_change_json(log: DataFrame, data: str = "data") -> DataFrame:
    """Add ``action``, ``op`` and ``cells`` (column name to text) to a JSON log; broken lines get nulls.

    A delete carries its key under ``identity``; the other actions carry ``columns``. The line
    is parsed inside a generator with one output row: filters and projections on the result
    then read what was parsed, where the optimizer would otherwise repeat the parsing in each.
    """
    change = F.from_json(column(data), CHANGE_SCHEMA, {"columnNameOfCorruptRecord": "_broken"})
    return log.select("*", F.inline(F.transform(F.array(change), _read_change)))


def broken_changes(log: DataFrame, data: str = "data") -> DataFrame:
    """The lines that could not be read, for the quarantine."""
    return (
        parse_change_json(log, data)
        .where(F.col("action").isNull())
        .drop("action", "op", "cells")
        .withColumn("reason", F.lit("Malformed change"))
    )


def _unreadable(schema: T.StructType, keys: list[str]) -> Column:
    """A cell that is given but does not fit its column, or a key that is not given."""
    tests = []
    for f in schema:
        cell = F.try_element_at("cells", F.lit(f.name))
        read = cell.try_cast(f.dataType)
        tests.append(read.isNull() if f.name in keys else cell.isNotNull() & read.isNull())
    return reduce(Column.__or__, tests, F.lit(False))


def unreadable_changes(log: DataFrame, schema: T.StructType, keys: list[str], data: str = "data") -> DataFrame:
    """Changes with a cell that does not fit, or without a key, for the quarantine; they are not applied."""
    return (
        parse_change_json(log, data)
        .where(F.col("op").isNotNull() & _unreadable(schema, keys))
        .drop("action", "op", "cells")
        .withColumn("reason", F.lit("Unreadable cell or key"))
    )


def log_as_feed(log: DataFrame, schema: T.StructType, data: str = "data", keys: list[str] = ()) -> DataFrame:
    """A JSON log as a numbered feed with the target's columns; other actions are ignored.

    So are changes that ``unreadable_changes`` reports: a cell that cannot be read must not become a null.
    """
    parsed = parse_change_json(log, data).where(F.col("op").isNotNull() & ~_unreadable(schema, keys))
    cells = [F.try_element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema]
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    return parsed.select(*cells, "op", "lsn", seq.alias("seq"))


def log_as_cells(log: DataFrame, schema: T.StructType, data: str = "data", keys: list[str] = ()) -> DataFrame:
    """Like ``log_as_feed``, with the names of the columns that each change gives."""
    parsed = parse_change_json(log, data).where(F.col("op").isNotNull() & ~_unreadable(schema, keys))
    return parsed_as_cells(parsed, schema)


def parsed_as_cells(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    cells = [F.try_element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema]
    seq = F.col("seq") if "seq" in parsed.columns else F.lit(0)
    return parsed.select(*cells, F.map_keys("cells").alias(NAMED), "op", "lsn", seq.alias("seq"))


def judged_changes(log: DataFrame, schema: T.StructType, keys: list[str], data: str = "data") -> DataFrame:
    """Every line parsed once, with the ``reason`` why it is set aside, or null."""
    parsed = parse_change_json(log, data)
    return parsed.withColumn(
        "reason",
        F.when(F.col("action").isNull(), "Malformed change")
        .when(F.col("op").isNotNull() & _unreadable(schema, keys), "Unreadable cell or key"))


def cdc_apply_json(target: DataFrame, log: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """The target after a JSON log; a column that a change leaves out keeps its value."""
    from ferrywell.operators import cells

    return cells.apply(target, log_as_cells(log, target.schema, data, keys), keys)


# -- applying to a stored target -----------------------------------------------------------------


def with_position(df: DataFrame) -> DataFrame:
    """Rows of a full load, as they are kept in a change-applied target: older than any change."""
    return df.withColumns({POSITION: F.lit(None).cast("binary"), DELETED: F.lit(False)})


def current_rows(target: VersionedTable) -> DataFrame:
    """The rows of a change-applied target, without tombstones and positions."""
    return target.read().where(~F.col(DELETED)).drop(PLACES, CUT, POSITION, DELETED)


def cdc_merge(target: VersionedTable, feed: DataFrame, state: dict[str, str] | None = None) -> int:
    """Apply a feed to a stored target; late changes lose against what was already applied.

    Deletes stay as tombstones, so an older change cannot bring the row back. Only buckets
    that hold a changed key are read and rewritten. The highest position is committed too: a
    batch that starts after it cannot be late, and its keys need not be compared with the target.
    """
    keys, base = target.keys, target.commit()
    latest = cdc_latest(feed, keys)
    columns = [c for c in latest.columns if c not in SYSTEM]
    staged = Staged(
        latest.select(
            *[column(c) for c in columns],
            F.concat(*[position(F.col(c), latest.schema[c].dataType) for c in ("lsn", "seq")]).alias(POSITION),
            (F.col("op") == DELETE).alias(DELETED),
        ),
        "changes",
    )
    try:
        batch = staged.df
        found = target.summary(batch, [f"hex(min({POSITION})) as first", f"hex(max({POSITION})) as last"])
        if not found.touched:
            return target.set_state(state or {}) if base else target.replace(batch, state)
        applied = base["state"].get(HIGHEST) if base else None
        highest = found.last if applied is None else max(found.last, applied)  # hex of one width
        state = {**(state or {}), HIGHEST: highest}
        if base is None:
            return target.replace(batch, state)
        old = target.read(found.touched, base)
        newer = batch
        # the joins may broadcast the batch: Spark decides by its measured size
        if applied is not None and found.first <= applied:
            stored = old.where(F.col(POSITION).isNotNull()).select(*keys, F.col(POSITION).alias("__applied"))
            late = batch.join(stored, keys, "inner").where(F.col("__applied") >= F.col(POSITION))
            newer = batch.join(late.select(*keys), keys, "left_anti")
        kept = old.join(newer.select(*keys), keys, "left_anti")
        return target.replace_buckets(kept.unionByName(newer), found.touched, base, state)
    finally:
        staged.release()
