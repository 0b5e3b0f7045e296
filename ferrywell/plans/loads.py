"""Loads into a versioned target: full, incremental by a high-watermark, and change data."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import errors
from ferrywell.functions.positions import is_number, position
from ferrywell.operators import cdc, cells
from ferrywell.operators.cleaning import column, quoted
from ferrywell.operators.reconcile import reconcile
from ferrywell.sinks.tables import append_table, replace_table, upsert_rows
from ferrywell.sinks.versioned import VersionedTable

# Stored as they are; every other type becomes text.
PRIMITIVE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType, T.BinaryType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _utc_without_zone(c: Column) -> Column:
    """The instant as a UTC date and time; exact also where the session's zone repeats an hour."""
    seconds = (F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def coerce_for_target(df: DataFrame) -> DataFrame:
    """Nested values become JSON text, zoned timestamps lose their zone after a shift to UTC."""
    fields = []
    for f in df.schema:
        c = column(f.name)
        if isinstance(f.dataType, NESTED):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = _utc_without_zone(c)
        elif not isinstance(f.dataType, PRIMITIVE):
            c = c.cast("string")
        fields.append(c.alias(f.name))
    return df.select(*fields)


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def prepared(df: DataFrame) -> DataFrame:
    return upper_names(coerce_for_target(df))


def load_stats(mode: str, rows: int, started: float) -> dict:
    elapsed = time.monotonic() - started
    return {
        "mode": mode,
        "rows_loaded": rows,
        "elapsed_seconds": round(elapsed, 2),
        "rows_per_second": round(rows / max(elapsed, 0.1)),
        "finished_at": dt.datetime.now(dt.timezone.utc).isoformat(),
    }


def full_load(source: DataFrame, target: VersionedTable, state: dict[str, str] | None = None) -> dict:
    """Replace the target by the source; readers see the old rows until all new ones are there."""
    started = time.monotonic()
    replace_table(target, prepared(source), state)
    # a count without columns is answered from the file footers
    return load_stats("full_load", target.read().count(), started)


def next_watermark(df: DataFrame, watermark: str) -> DataFrame:
    """The resume value for the next run: the highest one seen."""
    return df.agg(F.max(column(watermark)).alias("next_watermark"))


def _comparable(df: DataFrame, watermark: str) -> Column:
    c = column(watermark)
    return _utc_without_zone(c) if isinstance(df.schema[watermark].dataType, T.TimestampType) else c


def resume_point(target: DataFrame | None, watermark: str, stored: str | None = None) -> str | None:
    """Highest value in the target, else the stored one; as text, times in UTC."""
    if target is None:
        return stored
    found = target.agg(F.max(_comparable(target, watermark)).cast("string")).first()[0]
    return stored if found is None else found


def rows_after(source: DataFrame, watermark: str, resume: str | None, inclusive: bool = False) -> DataFrame:
    if resume is None:
        return source
    kind = source.schema[watermark].dataType
    # a literal of the column's own type, so that the comparison reaches the scan
    bound = F.lit(f"{resume}Z" if isinstance(kind, T.TimestampType) else resume).cast(kind)
    c = column(watermark)
    return source.where(c >= bound if inclusive else c > bound)


def incremental_extract(
    source: DataFrame, target: DataFrame | None, watermark: str, stored: str | None = None, inclusive: bool = False
) -> DataFrame:
    """Source rows after the target's highest watermark; all rows when there is no resume point.

    ``inclusive`` reads the boundary again, for sources where rows with an equal watermark
    arrive late; it needs a keyed target.
    """
    return rows_after(source, watermark, resume_point(target, watermark, stored), inclusive)


def _matching(names: list[str], wanted: str) -> str:
    return next(n for n in names if n.lower() == wanted.lower())


def incremental_load(
    source: DataFrame, target: VersionedTable, watermark: str, stored: str | None = None, inclusive: bool = False
) -> dict:
    """Extract after the watermark, then upsert by the target's keys, or append if it has none.

    The new watermark is committed together with the rows. While it is there, the next run
    starts from it and need not search the target for its maximum.
    """
    started = time.monotonic()
    if inclusive and not target.keys:
        raise ValueError("reading the boundary again needs a keyed target")
    slot = f"watermark:{watermark.lower()}"
    known = target.state.get(slot)
    if known is None and target.commit() is not None:
        current = target.read()
        resume = resume_point(current, _matching(current.columns, watermark), stored)
    else:
        resume = stored if known is None else known
    extracted = prepared(rows_after(source, watermark, resume, inclusive))
    mark = _matching(extracted.columns, watermark)
    highest = f"cast(max({quoted(mark)}) as string) as highest"

    def state_of(found: Row) -> dict:
        return {} if found.highest is None else {slot: found.highest}

    if target.keys:
        found = upsert_rows(target, extracted, [mark], [highest], state_of)
    else:
        found = _append_extracted(target, extracted, highest, state_of)
    return {**load_stats("incremental", found.rows, started), "new_watermark": found.highest}


def _append_extracted(target: VersionedTable, extracted: DataFrame, highest: str, state_of) -> Row:
    """Append, with the watermark taken from the rows as written; an empty batch is not published."""
    found = []

    def state(written: DataFrame) -> dict | None:
        found.append(written.agg(F.expr("count(1) as rows"), F.expr(highest)).first())
        return state_of(found[0]) if found[0].rows or target.commit() is None else None

    append_table(target, extracted, state)
    return found[0]


def cdc_load(feed: DataFrame, target: VersionedTable, to_lsn=None, mode: str = "cdc_feed") -> dict:
    """Apply the changes after the stored position; the position moves only with the data.

    Whole numbers are stored as such, other positions as hex text of their bytes. A feed that says
    which columns a change gives goes to a target of cells.
    """
    started = time.monotonic()
    kind = feed.schema["lsn"].dataType
    window = cdc.cdc_window(feed, target.state.get("lsn"), to_lsn)
    lsn = F.max("lsn") if is_number(kind) else F.hex(F.max(position(F.col("lsn"), kind)))
    row = window.agg(
        lsn.alias("lsn"),
        F.count_if(F.col("op") == cdc.INSERT).alias("inserts"),
        F.count_if(F.col("op") == cdc.AFTER).alias("updates"),
        F.count_if(F.col("op") == cdc.DELETE).alias("deletes"),
    ).first()
    if row.lsn is not None:
        # the upper bound is fixed here, so changes arriving meanwhile wait for the next run
        merge = cells.merge if cdc.NAMED in feed.columns else cdc.cdc_merge
        merge(target, cdc.cdc_window(window, to_lsn=row.lsn), {"lsn": str(row.lsn)})
    counts = {"inserts": row.inserts, "updates": row.updates, "deletes": row.deletes}
    return {**load_stats(mode, sum(counts.values()), started), **counts}


@dataclass
class LoadJob:
    """What to load, how, and whether to compare source and target afterwards."""

    name: str
    mode: str  # full_load, incremental, cdc_feed or cdc_log
    source: DataFrame
    target: VersionedTable
    watermark: str | None = None
    auto_reconcile: bool = False
    reconcile_with: DataFrame | None = None  # the source table, where ``source`` is a change feed
    options: dict = field(default_factory=dict)


RUN_SCHEMA = (
    "job string, mode string, status string, rows_loaded bigint, row_count_diff bigint, "
    "reconciled boolean, error string, elapsed_seconds double, finished_at string"
)


# Fixed value: characters of an error that are shown.
SHOWN = 500


def _load(job: LoadJob) -> dict:
    if job.mode == "full_load":
        return full_load(job.source, job.target)
    if job.mode == "incremental":
        if not job.watermark:
            raise ValueError("an incremental load needs a watermark column")
        return incremental_load(job.source, job.target, job.watermark, **job.options)
    if job.mode == "cdc_feed":
        return cdc_load(job.source, job.target, **job.options)
    if job.mode == "cdc_log":
        schema = T.StructType(
            [f for f in job.target.read().schema if f.name not in (cdc.PLACES, cdc.CUT, cdc.POSITION, cdc.DELETED)]
        )
        return cdc_load(cdc.log_as_cells(job.source, schema, keys=job.target.keys), job.target, mode="cdc_log", **job.options)
    raise ValueError(f"unknown mode: {job.mode}")


def run_job(spark: SparkSession, job: LoadJob) -> DataFrame:
    """Run one load and return its ledger row; a failure is recorded, not raised."""
    started = time.monotonic()
    run = {"job": job.name, "mode": job.mode, "status": "success", "rows_loaded": 0,
           "row_count_diff": None, "reconciled": None, "error": None}
    try:
        run["rows_loaded"] = _load(job)["rows_loaded"]
        if job.auto_reconcile:
            rows = cdc.current_rows(job.target) if job.mode.startswith("cdc") else job.target.read()
            # what a load turns into text has to be compared as text
            expected = job.reconcile_with if job.reconcile_with is not None else coerce_for_target(job.source)
            verdict = reconcile(expected, rows).first()
            run |= {"row_count_diff": verdict.row_count_diff, "reconciled": verdict.overall_passed}
    except Exception as failure:  # the ledger keeps the reason
        run |= {"status": "error", "error": str(failure)}
    run["elapsed_seconds"] = round(time.monotonic() - started, 2)
    run["finished_at"] = dt.datetime.now(dt.timezone.utc).isoformat()
    return spark.createDataFrame([run], RUN_SCHEMA)


def explained(runs: DataFrame) -> DataFrame:
    """Ledger rows with the likely cause of each error, told from its whole text, which is cut for display only."""
    cause = errors.cause_of(errors.rule_number(F.col("error")))
    return runs.withColumns({"likely_cause": cause, "error": F.substring("error", 1, SHOWN)})
