"""Cleaning queries over a spoilt copy of the events table."""

from __future__ import annotations

from ferrywell.operators import cleaning
from ferrywell.plans.inputs import table
from ferrywell.plans.registry import SHARED, query
from ferrywell.session import new_folder
from ferrywell.sinks.versioned import VersionedTable

# The token lists, written out for the SQL side.
STRICT = "('na', 'n/a', 'null', 'none', 'nan', '-', '', 'undefined', 'nil')"
BASIC = "('NA', 'N/A', 'null', 'NULL', 'None', 'none', '-', '', 'undefined', 'nil', '#N/A', 'NaN')"
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
TEXTS = ["user_txt", "type_txt", "amount_txt"]
ALL = "event_id, user_txt, type_txt, amount_txt, value"
EMPTY = "event_id is null and user_txt is null and type_txt is null and amount_txt is null and (value is null or isnan(value))"


def _texts(form: str) -> str:
    return ", ".join(f"{form.format(c=c)} as {c}" for c in TEXTS)


SHARED["trimmed"] = (
    ["odd_events"],
    f"select event_id, {_texts('trim({c}, chr(32) || chr(9))')}, value from odd_events",
)
SHARED["strict_cells"] = (
    ["trimmed"],
    f"select event_id, {_texts('case when lower({c}) in ' + STRICT + ' then null else {c} end')}, value from trimmed",
)
SHARED["basic_cells"] = (
    ["trimmed"],
    f"select event_id, {_texts('case when {c} in ' + BASIC + ' then null else {c} end')}, value from trimmed",
)
# a missing number is a null when rows are compared
NO_NAN = "* replace (case when not isnan(value) then value end as value)"
SHARED["strict_distinct"] = (["strict_cells"], f"select distinct {NO_NAN} from strict_cells where not ({EMPTY})")
SHARED["basic_distinct"] = (["basic_cells"], f"select distinct {NO_NAN} from basic_cells where not ({EMPTY})")
NUMERIC_USER = (
    f"case when user_txt = '1e999' then cast('Infinity' as double) "
    f"when regexp_full_match(user_txt, '{NUMBER}') then cast(user_txt as double) end"
)


def _finite(value: str) -> str:
    return f"(case when isfinite({value}) then {value} end)"


FINITE_USER, FINITE_VALUE = _finite(NUMERIC_USER), _finite("value")
SHARED["strict_judged"] = (
    ["strict_distinct"],
    f"""select d.*, {NUMERIC_USER} as user_number,
          coalesce(abs((event_id - me) / (se + 1e-9)) > 5, false)
          or coalesce(abs(({FINITE_VALUE} - mv) / (sv + 1e-9)) > 5, false)
          or coalesce(abs(({FINITE_USER} - mu) / (su + 1e-9)) > 5, false) as far
        from strict_distinct d, (
          select avg(event_id) as me, stddev_pop(event_id) as se, avg({FINITE_VALUE}) as mv, stddev_pop({FINITE_VALUE}) as sv,
            avg({FINITE_USER}) as mu, stddev_pop({FINITE_USER}) as su from strict_distinct) s""",
)


def _dirty(spark, sf):
    return table(spark, sf, "odd_events")


def _strict_cells(spark, sf):
    return cleaning.null_tokens(cleaning.trim_cells(_dirty(spark, sf)), "strict")


@query("clean_trim_headers", "select * from odd_events", ["odd_events"])
def clean_trim_headers(spark, sf):
    dirty = _dirty(spark, sf)
    return cleaning.trim_headers(dirty.toDF(*[f"  {c}\t" for c in dirty.columns]))


@query("clean_trim_cells", "select * from trimmed", ["trimmed"])
def clean_trim_cells(spark, sf):
    return cleaning.trim_cells(_dirty(spark, sf))


@query(
    "clean_null_tokens_strict",
    f"select event_id, {_texts('case when lower(trim({c}, chr(32) || chr(9))) in ' + STRICT + ' then null else {c} end')}, value from odd_events",
    ["odd_events"],
)
def clean_null_tokens_strict(spark, sf):
    return cleaning.null_tokens(_dirty(spark, sf), "strict")


@query(
    "clean_null_tokens_basic",
    f"select event_id, {_texts('case when {c} in ' + BASIC + ' then null else {c} end')}, value from odd_events",
    ["odd_events"],
)
def clean_null_tokens_basic(spark, sf):
    return cleaning.null_tokens(_dirty(spark, sf), "basic")


@query("clean_drop_empty", f"select * from strict_cells where not ({EMPTY})", ["strict_cells"])
def clean_drop_empty(spark, sf):
    return cleaning.drop_empty_rows(_strict_cells(spark, sf))


@query("clean_coerce_numeric", f"select * replace ({NUMERIC_USER} as user_txt) from strict_cells", ["strict_cells"])
def clean_coerce_numeric(spark, sf):
    return cleaning.coerce_numeric(_strict_cells(spark, sf))


@query("clean_dedup", "select * from strict_distinct", ["strict_distinct"])
def clean_dedup(spark, sf):
    return cleaning.dedup_rows(cleaning.drop_empty_rows(_strict_cells(spark, sf)))


SURPLUS = f"""
    select {ALL} from (
      select *, row_number() over (partition by {ALL} order by event_id) as copy
      from (select {NO_NAN} from strict_cells where not ({EMPTY}))) where copy > 1"""


@query("clean_duplicates_removed", SURPLUS, ["strict_cells"])
def clean_duplicates_removed(spark, sf):
    return cleaning.duplicates_removed(cleaning.drop_empty_rows(_strict_cells(spark, sf)))


@query(
    "clean_outliers",
    f"""select d.* from odd_events d, (
         select avg(event_id) as me, stddev_pop(event_id) as se, avg({FINITE_VALUE}) as mv, stddev_pop({FINITE_VALUE}) as sv
         from odd_events) s
       where not (coalesce(abs((event_id - me) / (se + 1e-9)) > 5, false)
               or coalesce(abs(({FINITE_VALUE} - mv) / (sv + 1e-9)) > 5, false))""",
    ["odd_events"],
)
def clean_outliers(spark, sf):
    return cleaning.zscore_outliers(_dirty(spark, sf))


@query(
    "clean_strict",
    "select event_id, user_number as user_txt, type_txt, amount_txt, value from strict_judged where not far",
    ["strict_judged"],
)
def clean_strict(spark, sf):
    return cleaning.clean_strict(_dirty(spark, sf)).cleaned


@query(
    "clean_quarantine",
    f"""select {ALL}, 'All values missing' as reason from (select {NO_NAN} from strict_cells where {EMPTY})
        union all select {ALL}, 'Duplicate row' from ({SURPLUS})
        union all select {ALL}, 'Statistical outlier (z>5)' from strict_judged where far""",
    ["strict_cells", "strict_judged"],
)
def clean_quarantine(spark, sf):
    return cleaning.clean_strict(_dirty(spark, sf)).quarantine


@query(
    "clean_basic",
    f"select * replace ({NUMERIC_USER} as user_txt) from basic_distinct",
    ["basic_distinct"],
)
def clean_basic(spark, sf):
    cleaning.clean_basic(_dirty(spark, sf), "odd_events")
    return spark.table("odd_events_cleaned")


@query(
    "clean_basic_stored",
    f"select * replace ({NUMERIC_USER} as user_txt) from basic_distinct",
    ["basic_distinct"],
)
def clean_basic_stored(spark, sf):
    """The cleaned rows as a stored table, which the view reads."""
    cleaning.clean_basic(_dirty(spark, sf), "stored_events", target=VersionedTable(spark, new_folder(spark, "cleaned")))
    return spark.table("stored_events_cleaned")


def _cell_counts(step: str, test: str) -> str:
    return " union all ".join(
        f"select '{step}', '{c}', cast(count(*) filter (where {test.format(c=c)}) as bigint) from odd_events" for c in TEXTS
    )


@query(
    "clean_report",
    f"""select 'rows in' as step, cast(null as varchar) as "column", count(*) as rows from odd_events
        union all select 'empty rows removed', null, count(*) from strict_cells where {EMPTY}
        union all select 'duplicates removed', null, count(*) from ({SURPLUS})
        union all select 'outliers removed', null, count(*) from strict_judged where far
        union all select 'rows out', null, count(*) from strict_judged where not far
        union all select 'columns', null, 5
        union all select 'text to numeric', 'user_txt', count(user_number) from strict_judged
        union all select 'values lost in coercion', 'user_txt', count(user_txt) - count(user_number) from strict_judged
        union all {_cell_counts('trimmed', 'trim({c}, chr(32) || chr(9)) <> {c}')}
        union all {_cell_counts('null tokens', 'lower(trim({c}, chr(32) || chr(9))) in ' + STRICT)}""",
    ["strict_cells", "strict_judged"],
)
def clean_report(spark, sf):
    return cleaning.clean_strict(_dirty(spark, sf)).report


@query("preview_rows", "select * from orders order by o_orderkey limit 5")
def preview_rows(spark, sf):
    return cleaning.preview(table(spark, sf, "orders"), ["o_orderkey"])


@query(
    "classify_errors",
    """with caused as (
         select case when message ilike '%connection refused%' then 'Server unreachable'
           when message ilike '%timed out%' then 'Server did not respond'
           when message ilike '%login failed%' then 'Username or password is incorrect'
           when message ilike '%ssl%' then 'SSL/TLS handshake failed'
           when message ilike '%database%does not exist%' then 'Database or file not found'
           when message ilike '%tns%' then 'Oracle service name not recognized' end as likely_cause
         from error_log)
       select likely_cause, case likely_cause
           when 'Server unreachable' then 'Use a public endpoint and allow this network in the firewall'
           when 'Server did not respond' then 'Check that the server is up and not behind a firewall or VPN'
           when 'Username or password is incorrect' then 'Verify the credentials'
           when 'SSL/TLS handshake failed' then 'Check the SSL setting and the server certificate'
           when 'Database or file not found' then 'Verify the name; it may be case-sensitive'
           when 'Oracle service name not recognized' then 'Verify the service name on the listener' end as fix,
         cast(count(*) as bigint) as errors from caused group by 1""",
    ["error_log"],
)
def classify_errors(spark, sf):
    return cleaning.classify_errors(table(spark, sf, "error_log"))
