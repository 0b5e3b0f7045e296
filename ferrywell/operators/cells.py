"""Changes that give only some of a row's columns: the last change that names a cell decides it.

A column that a change leaves out keeps its value, one that is given as null becomes null. Inserts and
deletes cut history: what was given before them no longer counts. The state of a row is the place of
its last cut and, for each column, the place of the change that its value comes from; two states are
merged cell by cell, so batches may come late, twice or in any order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions.positions import position
from ferrywell.operators.cdc import BEFORE, CUT, DELETE, DELETED, INSERT, NAMED, PLACES, POSITION, SYSTEM
from ferrywell.operators.cleaning import column, quoted
from ferrywell.session import Staged
from ferrywell.sinks.versioned import VersionedTable


def _place(feed: DataFrame) -> Column:
    """A change's place in the log, the operation last; also orders changes of equal position."""
    parts = [position(F.col(c), feed.schema[c].dataType) for c in ("lsn", "seq")]
    return F.concat(*parts, F.unhex(F.lpad(F.hex(F.col("op").cast("bigint")), 2, "0")))


def _data(df: DataFrame, keys: list[str]) -> list[str]:
    own = {*keys, *SYSTEM, NAMED, POSITION, DELETED, CUT, PLACES}
    return [c for c in df.columns if c not in own]


def _after_cut(value: Column, place: Column, cut: Column) -> tuple[Column, Column]:
    """A value and its place, nothing if the row began anew after it; a full load's value has no place."""
    stands = cut.isNull() | (place >= cut)
    return F.when(stands, value), F.when(stands, place)


def folded(feed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the state that its changes alone give.

    All changes of a key are combined on the map side, a cell at a time. Without a column of given
    names every change gives all columns.
    """
    data = _data(feed, keys)
    if NAMED not in feed.columns:
        feed = feed.withColumn(NAMED, F.lit(None).cast("array<string>"))
    changes = feed.where(F.col("op") != BEFORE).withColumn("__place", _place(feed))
    place = F.col("__place")

    def last(name: str) -> Column:
        kind = changes.schema[name].dataType
        plain = F.to_json(F.struct(column(name))) if isinstance(kind, (T.MapType, T.VariantType)) else column(name)
        given = (F.col("op") != DELETE) & (F.col(NAMED).isNull() | F.array_contains(NAMED, name))
        return F.max_by(
            F.when(given, F.struct(column(name).alias("value"), place.alias("place"))), F.when(given, F.struct(place, plain)))

    rows = changes.groupBy(*[column(k) for k in keys]).agg(
        *[last(c).alias(f"__cell{i}") for i, c in enumerate(data)],
        F.max(F.when(F.col("op").isin(DELETE, INSERT), place)).alias(CUT),
        F.max(place).alias(POSITION),
        F.max_by(F.col("op") == DELETE, place).alias(DELETED),
    )
    cells = [_after_cut(F.col(f"__cell{i}.value"), F.col(f"__cell{i}.place"), F.col(CUT)) for i in range(len(data))]
    return rows.select(
        *[column(k) for k in keys], *[value.alias(c) for c, (value, _) in zip(data, cells, strict=True)],
        F.struct(*[p.alias(c) for c, (_, p) in zip(data, cells, strict=True)]).alias(PLACES), CUT, POSITION, DELETED)


def with_places(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a full load as they are kept in a target of cells: older than any change."""
    nothing = F.lit(None).cast("binary")
    return df.withColumns({
        PLACES: F.struct(*[nothing.alias(c) for c in _data(df, keys)]), CUT: nothing, POSITION: nothing, DELETED: F.lit(False)})


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two states as one: for each cell the later place counts, unless a cut of either side is later still."""
    data = _data(old, keys)
    a, b = old.select(*keys, F.struct(*map(column, old.columns)).alias("__a")), new.select(*keys, F.struct(*map(column, new.columns)).alias("__b"))
    both = a.join(b, keys, "full_outer")

    def side(name: str, field: str) -> Column:
        return F.col(f"{name}.{quoted(field)}")

    newer = side("__b", POSITION).isNotNull() & (side("__a", POSITION).isNull() | (side("__b", POSITION) >= side("__a", POSITION)))
    cut = F.greatest(side("__a", CUT), side("__b", CUT))
    values, places = [], []
    for c in data:
        pa, pb = F.col(f"__a.{PLACES}.{quoted(c)}"), F.col(f"__b.{PLACES}.{quoted(c)}")
        later = pb.isNotNull() & (pa.isNull() | (pb >= pa))
        value, place = _after_cut(
            F.when(later, side("__b", c)).otherwise(side("__a", c)), F.when(later, pb).otherwise(pa), F.col(CUT))
        values.append(value.alias(c))
        places.append(place.alias(c))
    both = both.withColumn(CUT, cut)
    return both.select(
        *[column(k) for k in keys], *values, F.struct(*places).alias(PLACES), CUT,
        F.when(newer, side("__b", POSITION)).otherwise(side("__a", POSITION)).alias(POSITION),
        F.when(newer, side("__b", DELETED)).otherwise(side("__a", DELETED)).alias(DELETED),
    ).select(*map(column, old.columns))


def _refuse_missing_keys(rows: DataFrame, keys: list[str]) -> None:
    if not rows.where(reduce(Column.__or__, [column(k).isNull() for k in keys])).isEmpty():
        raise ValueError(f"a change has no value for one of its keys {keys}")


def apply(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The target's rows after the feed."""
    states = Staged(folded(feed, keys), "cells").df
    _refuse_missing_keys(states, keys)
    after = merged(with_places(target, keys), states.select(*with_places(target, keys).columns), keys)
    return after.where(~F.col(DELETED)).select(*map(column, target.columns))


def merge(target: VersionedTable, feed: DataFrame, state: dict[str, str] | None = None) -> int:
    """Apply a feed to a stored target of cells; only buckets that hold a changed key are read and rewritten."""
    base, staged = target.commit(), Staged(folded(feed, target.keys), "cells")
    try:
        found = target.summary(staged.df)
        if base is None:
            return target.replace(staged.df, state)
        if not found.touched:
            return target.set_state(state or {})
        old = target.read(found.touched, base)
        if PLACES not in old.columns:
            raise ValueError("the target does not keep where its values come from; load it with_places")
        return target.replace_buckets(merged(old, staged.df.select(*old.columns), target.keys), found.touched, base, state)
    finally:
        staged.release()
