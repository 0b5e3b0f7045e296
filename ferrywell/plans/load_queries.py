"""Load, change-data and reconciliation queries; targets are written to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywell.operators import cdc, cells
from ferrywell.operators.reconcile import changed_buckets, reconcile, reconcile_counts, reconcile_sums
from ferrywell.plans import loads
from ferrywell.plans.inputs import table
from ferrywell.plans.registry import SHARED, query
from ferrywell.session import new_folder
from ferrywell.sinks.tables import append_table, upsert_table
from ferrywell.sinks.versioned import VersionedTable


def _upper(columns: str) -> str:
    return ", ".join(f"{c} as {c.upper()}" for c in columns.split(", "))


LINEITEM = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)
ORDER_VERSION = "o_orderkey, o_custkey, o_totalprice, created_at, updated_at"
RESUME = "(select max(updated_at) from target_orders)"


def _target(spark, label, keys=()):
    return VersionedTable(spark, new_folder(spark, label), keys=list(keys))


@query("full_load", f"select {_upper(LINEITEM)} from lineitem")
def full_load(spark, sf):
    target = _target(spark, "lineitem")
    loads.full_load(table(spark, sf, "lineitem"), target)
    return target.read()


@query("load_stats", "select 'full_load' as mode, cast(count(*) as bigint) as rows_loaded from lineitem")
def load_stats(spark, sf):
    stats = loads.full_load(table(spark, sf, "lineitem"), _target(spark, "lineitem"))
    return spark.createDataFrame([(stats["mode"], stats["rows_loaded"])], "mode string, rows_loaded bigint")


def _loaded_orders(spark, sf, keys):
    target = _target(spark, "orders", keys)
    loads.full_load(table(spark, sf, "target_orders"), target)
    return target


@query(
    "append_load",
    f"select {_upper(ORDER_VERSION)} from (select * from target_orders union all "
    f"select * from orders_versioned where updated_at > {RESUME})",
    ["target_orders"],
)
def append_load(spark, sf):
    target = _loaded_orders(spark, sf, [])
    new = loads.incremental_extract(
        table(spark, sf, "orders_versioned"), table(spark, sf, "target_orders"), "updated_at"
    )
    append_table(target, loads.prepared(new))
    return target.read()


UPSERTED = f"""
    select {_upper(ORDER_VERSION)} from (
      select * from target_orders t where not exists (
        select 1 from orders_versioned s where s.updated_at > {RESUME} and s.o_orderkey = t.o_orderkey)
      union all select * from orders_versioned where updated_at > {RESUME})"""


@query("upsert_load", UPSERTED, ["target_orders"])
def upsert_load(spark, sf):
    target = _loaded_orders(spark, sf, ["O_ORDERKEY"])
    new = loads.incremental_extract(
        table(spark, sf, "orders_versioned"), table(spark, sf, "target_orders"), "updated_at"
    )
    upsert_table(target, loads.prepared(new), ["UPDATED_AT"])
    return target.read()


@query("incremental_extract", f"select * from orders_versioned where updated_at > {RESUME}", ["target_orders"])
def incremental_extract(spark, sf):
    return loads.incremental_extract(
        table(spark, sf, "orders_versioned"), table(spark, sf, "target_orders"), "updated_at"
    )


@query("incremental_load", f"select {_upper(ORDER_VERSION)} from orders_versioned", ["orders_versioned"])
def incremental_load(spark, sf):
    target = _loaded_orders(spark, sf, ["O_ORDERKEY"])
    loads.incremental_load(table(spark, sf, "orders_versioned"), target, "updated_at")
    return target.read()


@query(
    "next_watermark",
    f"select max(updated_at) as next_watermark from orders_versioned where updated_at > {RESUME}",
    ["target_orders"],
)
def next_watermark(spark, sf):
    return loads.next_watermark(incremental_extract(spark, sf), "updated_at")


@query(
    "coerce_for_target",
    """select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' as detail,
         '["' || event_type || '","' || cast(user_id as varchar) || '"]' as tags, ts as seen_at, value
       from events""",
)
def coerce_for_target(spark, sf):
    table(spark, sf, "events")
    nested = spark.sql(
        """select event_id, named_struct('k', cast(get_json_object(props, '$.k') as int), 'type', event_type) as detail,
             array(event_type, cast(user_id as string)) as tags, cast(ts as timestamp) as seen_at, value
           from events"""
    )
    return loads.coerce_for_target(nested)


# -- change data -----------------------------------------------------------------------------

SHARED["last_changes"] = (
    ["change_feed"],
    """select * exclude (place) from (
         select *, row_number() over (partition by k order by lsn desc, seq desc) as place
         from change_feed where op <> 3) where place = 1""",
)
SHARED["applied"] = (
    ["last_changes", "cdc_base"],
    """select k, price from cdc_base b where not exists (select 1 from last_changes c where c.k = b.k)
       union all select k, price from last_changes where op <> 1""",
)
SHARED["read_changes"] = (
    ["change_log"],
    """select lsn, json_extract_string(data, '$.action') as action,
         cast(coalesce(json_extract_string(data, '$.columns[0].value'), json_extract_string(data, '$.identity[0].value')) as bigint) as k,
         try_cast(json_extract_string(data, '$.columns[1].value') as decimal(12,2)) as price
       from (select * from change_log where json_valid(data))""",
)


def _feed(spark, sf):
    return table(spark, sf, "change_feed")


@query("cdc_window", "select * from change_feed where lsn > 1 and lsn <= 4", ["change_feed"])
def cdc_window(spark, sf):
    return cdc.cdc_window(_feed(spark, sf), 1, 4)


@query("cdc_latest", "select * from last_changes", ["last_changes"])
def cdc_latest(spark, sf):
    return cdc.cdc_latest(_feed(spark, sf), ["k"])


@query("cdc_apply", "select * from applied", ["applied"])
def cdc_apply(spark, sf):
    return cdc.cdc_apply(table(spark, sf, "cdc_base"), _feed(spark, sf), ["k"])


@query(
    "cdc_counts",
    """select cast(count(*) filter (where op = 2) as bigint) as inserts, cast(count(*) filter (where op = 4) as bigint) as updates,
         cast(count(*) filter (where op = 1) as bigint) as deletes from change_feed""",
    ["change_feed"],
)
def cdc_counts(spark, sf):
    return cdc.cdc_counts(_feed(spark, sf))


@query(
    "cdc_parse_json",
    """select lsn, action, k, price, cast(null as varchar) as reason from read_changes
       union all select lsn, null, null, null, 'Malformed change' from change_log where not json_valid(data)""",
    ["change_log", "read_changes"],
)
def cdc_parse_json(spark, sf):
    log = table(spark, sf, "change_log")
    good = cdc.parse_change_json(log).where(F.col("action").isNotNull())
    cells = good.select(
        "lsn", "action",
        F.try_element_at("cells", F.lit("k")).cast("bigint").alias("k"),
        F.try_element_at("cells", F.lit("price")).cast("decimal(12,2)").alias("price"),
        F.lit(None).cast("string").alias("reason"),
    )
    return cells.unionByName(cdc.broken_changes(log).select("lsn", "reason"), allowMissingColumns=True)


@query(
    "cdc_apply_json",
    """with last_read as (
         select * exclude (place) from (
           select *, row_number() over (partition by k order by lsn desc) as place from read_changes) where place = 1)
       select k, price from cdc_base b where not exists (select 1 from last_read c where c.k = b.k)
       union all select k, price from last_read where action <> 'D'""",
    ["cdc_base", "read_changes"],
)
def cdc_apply_json(spark, sf):
    return cdc.cdc_apply_json(table(spark, sf, "cdc_base"), table(spark, sf, "change_log"), ["k"])


SHARED["partial_rows"] = (
    ["partial_changes"],
    """select k, max(lsn) filter (where action in ('D', 'I')) as cut, max_by(action, lsn) = 'D' as gone,
         max(lsn) filter (where has_price) as at_price, max(lsn) filter (where has_status) as at_status,
         max(lsn) filter (where has_priority) as at_priority
       from partial_changes group by k""",
)
SHARED["partial_applied"] = (
    ["partial_base", "partial_changes", "partial_rows"],
    """select k, price, status, priority from partial_base b where not exists (select 1 from partial_rows r where r.k = b.k)
       union all
       select r.k,
         case when at_price >= coalesce(cut, 0) then p.price when cut is null then b.price end,
         case when at_status >= coalesce(cut, 0) then s.status when cut is null then b.status end,
         case when at_priority >= coalesce(cut, 0) then o.priority when cut is null then b.priority end
       from partial_rows r left join partial_base b on b.k = r.k
       left join partial_changes p on p.k = r.k and p.lsn = at_price
       left join partial_changes s on s.k = r.k and s.lsn = at_status
       left join partial_changes o on o.k = r.k and o.lsn = at_priority
       where not gone""",
)


@query("cdc_apply_partial", "select * from partial_applied", ["partial_applied"])
def cdc_apply_partial(spark, sf):
    """Changes that give only some columns; the others keep their values, unless the row begins anew."""
    return cdc.cdc_apply_json(table(spark, sf, "partial_base"), table(spark, sf, "partial_log"), ["k"])


@query("cdc_merge_partial", "select * from partial_applied", ["partial_applied"])
def cdc_merge_partial(spark, sf):
    """The same into a stored target, the late changes last: each cell is decided by itself."""
    base, log = table(spark, sf, "partial_base"), table(spark, sf, "partial_log")
    target = _target(spark, "partial", ["k"])
    target.replace(cells.with_places(base, ["k"]))
    changes = cdc.log_as_cells(log, base.schema, keys=["k"])
    for part in (changes.where("lsn in (3, 4, 7)"), changes.where("lsn not in (3, 4, 7)")):
        cells.merge(target, part)
    return cdc.current_rows(target)


FAR = 3_000_000_000  # positions over 32 bits, of different lengths in hex


@query(
    "cdc_positions",
    "select spelling, k, price from applied, (values ('binary'), ('halves'), ('hex'), ('number')) t(spelling)",
    ["applied"],
)
def cdc_positions(spark, sf):
    """One feed with its positions as whole numbers, binary values, hex text and hex halves."""
    base, feed, far = table(spark, sf, "cdc_base"), _feed(spark, sf), F.col("lsn").cast("bigint") * FAR
    plain = F.hex(far)
    spellings = {
        "number": (far, 0, 5 * FAR),
        "hex": (F.concat(F.lit("0x"), F.lower(plain)), "0x00", hex(5 * FAR)),
        "binary": (F.unhex(F.lpad(plain, 20, "0")), bytes(10), (5 * FAR).to_bytes(10)),
        "halves": (F.concat(F.hex(F.shiftright(far, 32)), F.lit("/"), F.hex(far.bitwiseAND(0xFFFFFFFF))), "0/0", f"{5 * FAR >> 32:X}/{5 * FAR & 0xFFFFFFFF:X}"),
    }
    parts = []
    for name, (lsn, first, last) in spellings.items():
        changes = cdc.cdc_window(feed.withColumn("lsn", lsn), first, last)
        parts.append(cdc.cdc_apply(base, changes, ["k"]).select(F.lit(name).alias("spelling"), "k", "price"))
    return reduce(DataFrame.unionByName, parts)


# -- reconciliation --------------------------------------------------------------------------

WHOLES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FLOATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sums(column: str, whole: str) -> str:
    """Sums of both sides; ``whole`` is the exact form of a value."""
    one = f"(select coalesce(sum({whole}), 0) from {{}})"
    return (f"select '{column}' as column_name, {one.format('source_lineitem')} as s, {one.format('target_lineitem')} as t")


def _listed(kind: str, columns: list[str], whole: str, text: str) -> str:
    parts = " union all ".join(_sums(c, whole.format(c)) for c in columns)
    return (f"select column_name, {text.format('s')} as source_sum, {text.format('t')} as target_sum, "
            f"abs(s - t) < 0.01 as sum_match from ({parts}) {kind}")


SHARED["sums"] = (
    ["source_lineitem", "target_lineitem"],
    " union all ".join([
        _listed("whole", WHOLES, "cast({} as hugeint)", "cast({} as varchar)"),
        _listed("float", FLOATS, "cast({} as decimal(28,9))", "cast({} as varchar)"),
        _listed("big", ["big_value"], "cast({} as hugeint)", "cast({} as varchar) || '.000000000'"),
        _listed("small", ["small_value"], "{}", "cast({} as varchar)"),
    ]),
)


def _sides(spark, sf):
    return table(spark, sf, "source_lineitem"), table(spark, sf, "target_lineitem")


COUNTS = "(select count(*) as s from lineitem), (select count(*) as t from target_lineitem)"


@query(
    "reconcile_counts",
    f"""select cast(s as bigint) as source_rows, cast(t as bigint) as target_rows, s = t as row_count_match,
          cast(abs(s - t) as bigint) as row_count_diff from {COUNTS}""",
    ["target_lineitem"],
)
def reconcile_counts_query(spark, sf):
    return reconcile_counts(*_sides(spark, sf))


@query(
    "reconcile_sums",
    "select *, cast(0 as bigint) as source_lost, cast(0 as bigint) as target_lost from sums",
    ["sums"],
)
def reconcile_sums_query(spark, sf):
    return reconcile_sums(*_sides(spark, sf))


@query(
    "reconcile_verdict",
    f"""select cast(s as bigint) as source_rows, cast(t as bigint) as target_rows, s = t as row_count_match,
          cast(abs(s - t) as bigint) as row_count_diff, 10 as checked_columns,
          cast(failed as int) as failed_columns, 3 as content_columns, changed = 0 as content_match,
          failed = 0 as sums_passed, s = t and failed = 0 and changed = 0 as overall_passed
        from {COUNTS}, (select count(*) as failed from sums where not sum_match),
          (select count(*) as changed from (
            (select l_returnflag, l_linestatus, l_shipdate from source_lineitem
             except all select l_returnflag, l_linestatus, l_shipdate from target_lineitem)
            union all (select l_returnflag, l_linestatus, l_shipdate from target_lineitem
             except all select l_returnflag, l_linestatus, l_shipdate from source_lineitem)))""",
    ["source_lineitem", "target_lineitem", "sums"],
)
def reconcile_verdict(spark, sf):
    return reconcile(*_sides(spark, sf))


@query(
    "reconcile_buckets",
    """with s as (select l_orderkey % 97 as bucket, l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate from lineitem),
       t as (select l_orderkey % 97 as bucket, l_orderkey, l_linenumber,
               case when l_orderkey % 1000 = 11 then 'X' else l_returnflag end as l_returnflag, l_linestatus,
               case when l_orderkey % 1400 = 13 then l_shipdate + interval '1' day else l_shipdate end as l_shipdate
             from lineitem where l_orderkey % 1000 <> 3),
       different as (
         select bucket from ((select * from s except all select * from t) union all (select * from t except all select * from s)) group by bucket)
       select bucket, (select count(*) from s where s.bucket = d.bucket) as source_rows,
         (select count(*) from t where t.bucket = d.bucket) as target_rows from different d""",
)
def reconcile_buckets(spark, sf):
    """Lost rows, changed texts and changed times are found, and in which buckets of keys."""
    lines = table(spark, sf, "lineitem")
    after = lines.where("l_orderkey % 1000 <> 3").withColumns({
        "l_returnflag": F.expr("case when l_orderkey % 1000 = 11 then 'X' else l_returnflag end"),
        "l_shipdate": F.expr("case when l_orderkey % 1400 = 13 then l_shipdate + interval '1' day else l_shipdate end")})
    return changed_buckets(lines, after, ["l_orderkey", "l_linenumber"], bucket="l_orderkey % 97")


@query(
    "load_job_run",
    """select 'lineitem' as job, 'full_load' as mode, 'success' as status, count(*) as rows_loaded, cast(0 as bigint) as row_count_diff,
         true as reconciled, cast(null as varchar) as likely_cause from lineitem
       union all select 'orders', 'incremental', 'success', count(*), 0, true, null from orders_versioned
         where updated_at > (select max(updated_at) from target_orders)
       union all select 'order changes', 'cdc_feed', 'success', count(*), 0, true, null from change_feed where op <> 3
       union all select 'orders again', 'incremental', 'error', 0, null, null, null
       union all select 'orders far', repeat('far ', 200) || 'connection refused', 'error', 0, null, null, 'Server unreachable'""",
    ["target_orders", "change_feed"],
)
def load_job_run(spark, sf):
    base = _target(spark, "changed", ["k"])
    base.replace(cdc.with_position(table(spark, sf, "cdc_base")))
    feed, versions = _feed(spark, sf), table(spark, sf, "orders_versioned")
    after = cdc.cdc_apply(table(spark, sf, "cdc_base"), feed, ["k"])
    keyed = _loaded_orders(spark, sf, ["O_ORDERKEY"])
    jobs = [
        loads.LoadJob("lineitem", "full_load", table(spark, sf, "lineitem"), _target(spark, "lineitem"), auto_reconcile=True),
        loads.LoadJob("orders", "incremental", versions, keyed, "updated_at", auto_reconcile=True),
        loads.LoadJob("order changes", "cdc_feed", feed, base, auto_reconcile=True, reconcile_with=after),
        loads.LoadJob("orders again", "incremental", versions, keyed),  # names no watermark column
        loads.LoadJob("orders far", "far " * 200 + "connection refused", versions, keyed),  # a long error, its cause at the end
    ]
    ledger = _target(spark, "ledger")
    for job in jobs:
        append_table(ledger, loads.run_job(spark, job))
    return loads.explained(ledger.read()).select(
        "job", "mode", "status", "rows_loaded", "row_count_diff", "reconciled", "likely_cause"
    )
