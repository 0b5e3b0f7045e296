"""Profiling, contract and metadata queries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywell.functions.names import sap_names
from ferrywell.functions.types import map_types, type_rows
from ferrywell.operators import contracts, metadata, profile
from ferrywell.operators.contracts import Field
from ferrywell.plans import clean_queries  # noqa: F401  (its cleaned cells are read below)
from ferrywell.plans.inputs import table
from ferrywell.plans.registry import SHARED, query
from ferrywell.session import Staged, new_folder
from ferrywell.sinks.tables import clustered_write, files_met, pick_cluster_keys
from ferrywell.sinks.versioned import VersionedTable

# -- profiling -------------------------------------------------------------------------------

DIRTY = [("event_id", "bigint"), ("user_txt", "string"), ("type_txt", "string"), ("amount_txt", "string"), ("value", "double")]


@query(
    "profile_table",
    "with f(position, column_name, column_type) as (values "
    + ", ".join(f"({i + 1}, '{n}', '{t}')" for i, (n, t) in enumerate(DIRTY))
    + ") select (select count(*) from dirty_events) as total_rows, 5 as total_columns, f.* from f",
    ["dirty_events"],
)
def profile_table(spark, sf):
    return profile.profile_table(table(spark, sf, "dirty_events"))


@query("profile_sample", "select cast(3 as bigint) as shown, cast(3 as bigint) as found")
def profile_sample(spark, sf):
    """Sample rows beside the profile: so many are shown, and each is a row of the table."""
    lines = table(spark, sf, "lineitem")
    shown = Staged(profile.sample_rows(lines), "sample").df
    there = lines.distinct().withColumn("there", F.lit(True))
    return shown.join(there, lines.columns, "left").agg(F.count("*").alias("shown"), F.count("there").alias("found"))


def _share(test: str) -> str:
    return f"cast(count(*) filter (where {test}) / nullif(count(c), 0) as decimal(5,4))"


TESTS = {
    "datetime": r"regexp_matches(c, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}')",
    "date": r"regexp_matches(c, '^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$')",
    "boolean": "lower(c) in ('true', 'false', 'yes', 'no', '1', '0')",
    "number": rf"regexp_full_match(c, '{clean_queries.NUMBER}')",
}


def _column_facts(name: str, kind: str, source: str) -> str:
    as_text = {"double": "cast(cast({} as decimal(38,10)) as varchar)", "timestamp_ntz": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"}.get(
        kind, "cast({} as varchar)"
    )
    if kind == "string":
        shares = ", ".join(f"{_share(test)} as {k}_share" for k, test in TESTS.items())
        enough = {k: f"count(*) filter (where {test}) >= 0.85 * count(c)" for k, test in TESTS.items()}
        digits = f"count(*) filter (where c in ('0', '1')) = count(*) filter (where {TESTS['boolean']})"
        detected = (
            f"case when count(c) = 0 then 'string' when {enough['datetime']} then 'datetime' when {enough['date']} then 'date' "
            f"when {enough['boolean']} and not ({digits}) then 'boolean' when {enough['number']} then 'number' else 'string' end"
        )
    else:
        shares = ", ".join(f"cast(null as decimal(5,4)) as {k}_share" for k in TESTS)
        detected = {"bigint": "'number'", "int": "'number'", "double": "'number'", "timestamp_ntz": "'datetime'"}[kind]
    return (
        f"select '{name}' as column_name, '{kind}' as declared_type, count(*) as total_rows, count(*) - count(c) as null_rows, "
        f"count(distinct c) as distinct_values, {as_text.format('min(c)')} as min_value, {as_text.format('max(c)')} as max_value, "
        f"{shares}, {detected} as detected_type from (select {name} as c from {source})"
    )


LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


@query("profile_columns", " union all ".join(_column_facts(n, k, "lineitem") for n, k in LINEITEM))
def profile_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "lineitem"), exact=True)


@query(
    "profile_text_columns",
    " union all ".join(_column_facts(n, k, "dirty_events") for n, k in DIRTY),
    ["dirty_events"],
)
def profile_text_columns(spark, sf):
    return profile.profile_columns(table(spark, sf, "dirty_events"), exact=True)


@query(
    "profile_states",
    "select column_name, total_rows, null_rows, min_value, max_value, detected_type, distinct_values, true as estimate_close from ("
    + " union all ".join(_column_facts(n, k, "lineitem") for n, k in LINEITEM) + ")",
)
def profile_states(spark, sf):
    """The profile of a table that grew by batches, from their stored states, beside the exact number of distinct values."""
    lines, path = table(spark, sf, "lineitem"), new_folder(spark, "profile-states")
    for number in (0, 1, 1):  # one batch comes twice
        profile.add_state(lines.where(F.pmod("l_orderkey", F.lit(2)) == number), path, str(number))
    stored = profile.stored_profile(spark, path, lines.schema).withColumnRenamed("distinct_values", "estimate")
    close = F.abs(F.col("estimate") - F.col("distinct_values")) <= 0.06 * F.col("distinct_values")
    return stored.join(profile.distinct_counts(lines), "column_name").select(
        "column_name", "total_rows", "null_rows", "min_value", "max_value", "detected_type", "distinct_values", close.alias("estimate_close"))


NULL_COUNTS = " union all ".join(
    f"select 'missing values' as issue, '{c}' as column_name, count(*) filter (where {c} is null) as affected_rows, count(*) as total from strict_cells"
    for c, _ in DIRTY
)
SURPLUS_ROWS = (
    f"(select count(*) from strict_cells where not ({clean_queries.EMPTY})) - (select count(*) from strict_distinct)"
)


@query(
    "quality_issues",
    f"""with issues as ({NULL_COUNTS}
          union all select 'duplicate rows', null, {SURPLUS_ROWS}, (select count(*) from strict_cells))
        select issue, column_name, cast(affected_rows as bigint) as affected_rows,
          case when affected_rows >= 0.2 * total then 'high' when affected_rows >= 0.05 * total then 'medium' else 'low' end as severity
        from issues where affected_rows > 0""",
    ["strict_cells", "strict_distinct"],
)
def quality_issues(spark, sf):
    return profile.quality_issues(table(spark, sf, "dirty_events"))


@query(
    "quality_score",
    f"""with counted as (
          select count(*) as rows, count(*) * 5 as cells, cast(({' + '.join(f'count(*) filter (where {c} is null)' for c, _ in DIRTY)}) as bigint) as null_cells,
            {SURPLUS_ROWS} as duplicate_rows from strict_cells)
        select *, cast(round(100 * (1 - null_cells / cells) * (1 - duplicate_rows / rows), 2) as decimal(5,2)) as score from counted""",
    ["strict_cells", "strict_distinct"],
)
def quality_score(spark, sf):
    return profile.quality_score(table(spark, sf, "dirty_events"))


def _candidate(rank: int, name: str, score: int) -> str:
    return (
        f"select {rank} as rank, '{name}' as column_name, 'timestamp_ntz' as column_type, {score} as score, "
        f"count(*) - count({name}) as null_rows, strftime(max({name}), '%Y-%m-%d %H:%M:%S.%f') as max_value from orders_versioned"
    )


@query(
    "watermark_candidates",
    f"{_candidate(1, 'updated_at', 15)} union all {_candidate(2, 'created_at', 12)}",
    ["orders_versioned"],
)
def watermark_candidates(spark, sf):
    return profile.watermark_candidates(table(spark, sf, "orders_versioned"))


def _key_test(names: list[str], source: str) -> str:
    some_null = " or ".join(f"{n} is null" for n in names)
    return (
        f"select '{source}' as table_name, '{', '.join(names)}' as key_columns, count(*) as total_rows, "
        f"count(*) filter (where {some_null}) as null_rows, "
        f"count(*) filter (where {some_null}) = 0 and (select max(n) from (select count(*) as n from {source} group by {', '.join(names)})) = 1 as is_key from {source}"
    )


CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(
    "key_candidates",
    " union all ".join(
        [_key_test([n], "lineitem") for n, _ in LINEITEM]
        + [_key_test(["l_orderkey", "l_linenumber"], "lineitem")]
        + [_key_test([n], "customer") for n in CUSTOMER_COLUMNS]
        + [_key_test(["c_nationkey", "c_acctbal"], "customer")]
    ),
)
def key_candidates(spark, sf):
    lines = profile.key_candidates(table(spark, sf, "lineitem"), [["l_orderkey", "l_linenumber"]])
    customers = profile.key_candidates(table(spark, sf, "customer"), [["c_nationkey", "c_acctbal"]])
    return lines.withColumn("table_name", F.lit("lineitem")).unionByName(
        customers.withColumn("table_name", F.lit("customer"))
    )


def _lattice_sql(name: str, columns: list[str], up_to: int) -> str:
    """All sets of columns with their test, the smallest of those that pass."""
    sets = [c for size in range(1, up_to + 1) for c in combinations(columns, size)]
    tests = " union all ".join(
        f"select [{', '.join(repr(n) for n in c)}] as s, (select count(*) = (select count(*) from {name}) from (select distinct {', '.join(c)} from {name}"
        f" where {' and '.join(f'{n} is not null' for n in c)})) as is_key" for c in sets)
    return (f"select '{name}' as table_name, array_to_string(s, ', ') as key_columns, cast(len(s) as integer) as n_columns, "
            f"(select count(*) from {name}) as total_rows from (select s from ({tests}) where is_key) k where not exists ("
            f"select 1 from ({tests}) o where o.is_key and len(o.s) < len(k.s) and len(list_intersect(o.s, k.s)) = len(o.s))")


LATTICE = {
    "customer": CUSTOMER_COLUMNS,
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [n for n, _ in LINEITEM],
}


@query("key_lattice", " union all ".join(_lattice_sql(name, columns, 3) for name, columns in LATTICE.items()))
def key_lattice(spark, sf):
    """Keys of up to three columns that the search finds by itself."""
    found = [profile.key_lattice(table(spark, sf, name)).withColumn("table_name", F.lit(name)) for name in LATTICE]
    return reduce(DataFrame.unionByName, found)


@query("clustered_write", "select * from lineitem")
def clustered_write_query(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = pick_cluster_keys("postgresql", dict(lines.dtypes), ["l_orderkey", "l_linenumber"])
    path = new_folder(spark, "clustered")
    clustered_write(lines, path, keys)
    return spark.read.parquet(path)


@query(
    "clustered_curve",
    "select true as later_keys_skip_too, count(*) as rows, cast(sum(l_orderkey) as bigint) as keys, cast(sum(l_partkey) as bigint) as parts from lineitem",
)
def clustered_curve(spark, sf):
    """Along the curve a filter on the second and third key skips files, which in the order of keys it does not; all rows are there."""
    lines, keys = table(spark, sf, "lineitem"), ["l_shipdate", "l_partkey", "l_extendedprice"]
    met = {}
    for curve in (False, True):
        path = new_folder(spark, "layout")
        clustered_write(lines, path, keys, 64, curve)
        laid = spark.read.schema(lines.schema).parquet(path)
        at = laid.agg(*[F.expr(f"percentile_approx({k}, 0.5)") for k in keys[1:]]).first()
        met[curve] = [files_met(laid, k, v, v).first().met for k, v in zip(keys[1:], at, strict=True)]
    fewer = all(a < b for a, b in zip(met[True], met[False], strict=True))
    return laid.agg(F.lit(fewer).alias("later_keys_skip_too"), F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"), F.sum("l_partkey").alias("parts"))


# -- types and contracts ---------------------------------------------------------------------

SHARED["known_types"] = (
    [],
    "select * from (values "
    + ", ".join(f"('{d}', '{b}', '{m}')" for d, b, m in type_rows())
    + ") as t(dialect_name, base_type, mapped)",
)


@query(
    "map_types",
    r"""with sized as (
          select c.*, lower(c.dialect) as d, trim(string_split(lower(source_type), '(')[1]) as b,
            coalesce(length, try_cast(nullif(regexp_extract(source_type, '\((\d+)', 1), '') as int)) as len,
            coalesce(precision, try_cast(nullif(regexp_extract(source_type, '\((\d+)', 1), '') as int)) as prec,
            coalesce(scale, try_cast(nullif(regexp_extract(source_type, '\(\d+,\s*(\d+)\)', 1), '') as int)) as sc
          from column_catalogue c)
        select column_id, dialect, source_type, length, precision, scale,
          case when mapped is null then case when d = 'abap' then 'VARCHAR(255)' else 'VARIANT' end
            when mapped = 'VARCHAR SIZED' then 'VARCHAR(' || least(case when coalesce(len, 0) = 0 then 1 else len end, 16777216) || ')'
            when mapped = 'NUMBER SIZED' then 'NUMBER(' || least(case when coalesce(len, 0) = 0 then 15 else len end, 38) || ','
              || least(coalesce(sc, 0), least(case when coalesce(len, 0) = 0 then 15 else len end, 38)) || ')'
            when mapped = 'AMOUNT SIZED' then 'NUMBER(' || least(case when coalesce(len, 0) = 0 then 15 else len end, 38) || ','
              || least(case when coalesce(sc, 0) = 0 then 2 else sc end, least(case when coalesce(len, 0) = 0 then 15 else len end, 38)) || ')'
            when mapped = 'VARCHAR' and coalesce(len, 0) <> 0 then 'VARCHAR(' || least(len, 16777216) || ')'
            when mapped = 'NUMBER' and prec is not null then 'NUMBER(' || least(prec, 38) || ',' || greatest(0, least(coalesce(sc, 0), 38)) || ')'
            else mapped end as target_type
        from sized left join known_types on d = dialect_name and b = base_type""",
    ["column_catalogue", "known_types"],
)
def map_types_query(spark, sf):
    return map_types(table(spark, sf, "column_catalogue"))


ORDER_CONTRACT = [
    Field("o_orderkey", "NUMBER(19,0)", nullable=False, pk=True),
    Field("o_custkey", "NUMBER(10,0)", nullable=False),
    Field("o_totalprice", "NUMBER(7,2)"),
    Field("o_orderpriority", "VARCHAR(8)"),
    Field("o_orderdate", "DATE", nullable=False),
]


@query(
    "conform_cast",
    """select cast(o_orderkey as bigint) as o_orderkey, try_cast(o_custkey as decimal(10,0)) as o_custkey,
         try_cast(o_totalprice as decimal(7,2)) as o_totalprice, o_orderpriority, try_cast(o_orderdate as date) as o_orderdate
       from order_texts""",
    ["order_texts"],
)
def conform_cast(spark, sf):
    return contracts.conform(table(spark, sf, "order_texts"), ORDER_CONTRACT)


@query(
    "conform_violations",
    """select 'o_orderkey' as column_name, 'NUMBER(19,0)' as target_type, 0 as cast_failures, 0 as overflows, 0 as over_length, cast(0 as bigint) as lost_fractions
       union all select 'o_custkey', 'NUMBER(10,0)', count(*) filter (where o_custkey like 'cust-%'), 0, 0, 0 from order_texts
       union all select 'o_totalprice', 'NUMBER(7,2)', count(*) filter (where o_totalprice = 'twelve'),
         count(*) filter (where try_cast(o_totalprice as double) >= 100000), 0, 0 from order_texts
       union all select 'o_orderpriority', 'VARCHAR(8)', 0, 0, count(*) filter (where length(o_orderpriority) > 8), 0 from order_texts
       union all select 'o_orderdate', 'DATE', count(*) filter (where o_orderdate like '31/02/%'), 0, 0, 0 from order_texts""",
    ["order_texts"],
)
def conform_violations(spark, sf):
    return contracts.conform_violations(table(spark, sf, "order_texts"), ORDER_CONTRACT)


@query(
    "contract_nulls",
    """select 'o_orderkey' as column_name, 'NOT NULL' as rule, count(*) filter (where o_orderkey is null) as violations from order_texts
       union all select 'o_custkey', 'NOT NULL', count(*) filter (where o_custkey is null) from order_texts
       union all select 'o_orderdate', 'NOT NULL', count(*) filter (where o_orderdate is null) from order_texts""",
    ["order_texts"],
)
def contract_nulls(spark, sf):
    return contracts.contract_nulls(table(spark, sf, "order_texts"), ORDER_CONTRACT)


def _repeats(name: str, keys: str) -> str:
    return (
        f"select '{name}' as table_name, '{keys}' as key_columns, count(*) as repeated_keys, "
        f"cast(coalesce(sum(n), 0) as bigint) as rows_in_repeats "
        f"from (select count(*) as n from {name} group by {keys} having count(*) > 1)"
    )


@query("contract_pk", f"{_repeats('lineitem', 'l_orderkey, l_linenumber')} union all {_repeats('orders', 'o_orderkey')}")
def contract_pk(spark, sf):
    line_key = [Field("l_orderkey", "NUMBER(19,0)", False, True), Field("l_linenumber", "NUMBER(10,0)", False, True)]
    lines = contracts.contract_pk(table(spark, sf, "lineitem"), line_key)
    orders = contracts.contract_pk(table(spark, sf, "orders"), ORDER_CONTRACT)
    return lines.withColumn("table_name", F.lit("lineitem")).unionByName(orders.withColumn("table_name", F.lit("orders")))


@query(
    "contract_lengths",
    """select 'customer' as table_name, 'c_name' as column_name, 'VARCHAR(10)' as rule, count(*) filter (where length(c_name) > 10) as violations from customer
       union all select 'customer', 'c_acctbal', 'NUMBER(5,2)', count(*) filter (where c_acctbal is not null and try_cast(c_acctbal as decimal(5,2)) is null) from customer
       union all select 'orders', 'o_totalprice', 'NUMBER(5,2)', count(*) filter (where try_cast(o_totalprice as decimal(5,2)) is null) from orders""",
)
def contract_lengths(spark, sf):
    customers = contracts.contract_lengths(
        table(spark, sf, "customer"), [Field("c_name", "VARCHAR(10)"), Field("c_acctbal", "NUMBER(5,2)")]
    )
    orders = contracts.contract_lengths(table(spark, sf, "orders"), [Field("o_totalprice", "NUMBER(5,2)")])
    return customers.withColumn("table_name", F.lit("customer")).unionByName(orders.withColumn("table_name", F.lit("orders")))


BROKEN_ORDERS = """
    case when o_orderkey is null then 1 else 0 end + case when o_custkey is null then 2 else 0 end
    + case when o_orderdate is null then 4 else 0 end
    + case when o_custkey like 'cust-%' then 16 else 0 end
    + case when o_totalprice = 'twelve' or try_cast(o_totalprice as double) >= 100000 then 32 else 0 end
    + case when length(o_orderpriority) > 8 then 64 else 0 end"""


@query(
    "contract_quarantine",
    f"""select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate, cast(broken as bigint) as broken,
         array_to_string(list_filter([
           case when broken & 2 > 0 then 'o_custkey: NOT NULL' end, case when broken & 16 > 0 then 'o_custkey: NUMBER(10,0)' end,
           case when broken & 32 > 0 then 'o_totalprice: NUMBER(7,2)' end,
           case when broken & 64 > 0 then 'o_orderpriority: VARCHAR(8)' end], lambda r: r is not null), '; ') as reason
       from (select *, {BROKEN_ORDERS} as broken from order_texts) where broken > 0""",
    ["order_texts"],
)
def contract_quarantine(spark, sf):
    """The rows that break a rule, each with all of its reasons."""
    ledger = contracts.ContractLedger(table(spark, sf, "order_texts"), ORDER_CONTRACT)
    return ledger.quarantine().withColumn("broken", F.col("broken")[0])


@query(
    "contract_kept",
    f"select o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderdate from (select *, {BROKEN_ORDERS} as broken from order_texts) where broken = 0",
    ["order_texts"],
)
def contract_kept(spark, sf):
    return contracts.ContractLedger(table(spark, sf, "order_texts"), ORDER_CONTRACT).kept()


@query(
    "contract_mask_counts",
    """with k as (select *, count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem)
       select 'l_orderkey' as column_name, 'NOT NULL' as rule, cast(count(*) filter (where l_orderkey is null) as bigint) as violations from k
       union all select 'l_linenumber', 'NOT NULL', count(*) filter (where l_linenumber is null) from k
       union all select 'l_returnflag', 'VARCHAR(1)', count(*) filter (where length(l_returnflag) > 1) from k
       union all select 'l_extendedprice', 'NUMBER(6,2)', count(*) filter (where try_cast(l_extendedprice as decimal(6,2)) is null) from k
       union all select 'l_orderkey, l_linenumber', 'PRIMARY KEY', count(*) filter (where n > 1) from k""",
)
def contract_mask_counts(spark, sf):
    """Counts of broken rules from the rows' masks, repeated keys included."""
    contract = [Field("l_orderkey", "BIGINT", False, True), Field("l_linenumber", "INT", False, True),
                Field("l_returnflag", "VARCHAR(1)"), Field("l_extendedprice", "NUMBER(6,2)")]
    return contracts.ContractLedger(table(spark, sf, "lineitem"), contract).counts()


@query(
    "standard_names",
    """select p_partkey as P_PARTKEY, p_name as "PRODUCT_NAME", p_type as "P_TYPE", p_size as '"p size"',
         case p_size when 1 then 'MATERIAL_MASTER_GENERAL' when 2 then 'SALES_ORDER_HEADER' when 3 then 'UNIVERSAL_JOURNAL'
           when 4 then 'MATERIAL_TAX' when 5 then upper(replace(p_name, ' ', '_')) else case when regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') then upper(p_name)
             else '"' || p_name || '"' end end as "STANDARD_NAME"
       from part""",
)
def standard_names(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "p_type", "p_size as `p size`",
        "case p_size when 1 then 'MARA' when 2 then 'VBAK' when 3 then 'ACDOCA' when 4 then 'MLAN' "
        "when 5 then replace(p_name, ' ', '_') else p_name end as technical_name",
    )
    named = contracts.business_names(parts, "technical_name", sap_names(spark))
    return contracts.standard_names(named.drop("technical_name"), {"p_name": "product_name"})


# -- metadata tables -------------------------------------------------------------------------

ORDER_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


def _snapshot_sql(name: str, source: str) -> str:
    rows = ", ".join(f"({i + 1}, '{c}', '{t}')" for i, (c, t) in enumerate(ORDER_COLUMNS))
    return (
        f"select '{name}' as table_name, f.position, f.column_name, f.column_type, (select count(*) from {source}) as row_count "
        f"from (values {rows}) as f(position, column_name, column_type)"
    )


@query(
    "schema_snapshot",
    f"{_snapshot_sql('orders', 'orders')} union all {_snapshot_sql('orders again', 'orders')}",
)
def schema_snapshot(spark, sf):
    orders = table(spark, sf, "orders")
    kept = VersionedTable(spark, new_folder(spark, "snapshots"))
    for name in ("orders", "orders again"):
        kept.append(metadata.schema_snapshot(orders, name))
    return kept.read()


@query(
    "schema_drift",
    """select * from (values ('o_orderstatus', 'removed', 'string', null), ('o_orderdate', 'removed', 'timestamp_ntz', null),
         ('o_orderpriority', 'removed', 'string', null), ('o_totalprice', 'retyped', 'double', 'decimal(12,2)'),
         ('created_at', 'added', null, 'timestamp_ntz'), ('updated_at', 'added', null, 'timestamp_ntz'))
         as f(column_name, change, old_type, new_type), (select cast(null as bigint) as row_difference)
       union all select null, 'row count', null, null, (select count(*) from target_orders) - (select count(*) from orders)""",
    ["target_orders"],
)
def schema_drift(spark, sf):
    old = metadata.schema_snapshot(table(spark, sf, "orders"), "orders")
    new = metadata.schema_snapshot(table(spark, sf, "target_orders"), "orders")
    return metadata.schema_drift(old, new)


@query(
    "lineage_closure",
    """with recursive reach(target, upstream) as (
         select target, source from lineage_edges
         union select r.target, e.source from reach r join lineage_edges e on e.target = r.upstream)
       select target, upstream from reach""",
    ["lineage_edges"],
    recursive=True,
)
def lineage_closure(spark, sf):
    return metadata.lineage_closure(table(spark, sf, "lineage_edges"))


@query(
    "run_summary",
    """with last_runs as (
         select * from (select *, row_number() over (partition by pipeline_id order by started_at desc, run_id desc) as place from run_ledger)
         where place = 1)
       select pipeline_id, count(*) as runs, count(*) filter (where r.status = 'error') as errors,
         cast(sum(r.rows_loaded) as bigint) as total_rows,
         cast(round(sum(r.rows_loaded) / greatest(sum(r.elapsed_seconds), 0.1)) as bigint) as rows_per_second,
         any_value(l.started_at) as last_started_at, any_value(l.run_id) as last_run_id, any_value(l.status) as last_status
       from run_ledger r join last_runs l using (pipeline_id) group by pipeline_id""",
    ["run_ledger"],
)
def run_summary(spark, sf):
    return metadata.run_summary(table(spark, sf, "run_ledger"))


@query(
    "query_history_stats",
    """with ranked as (
         select *, row_number() over (partition by connection_id order by execution_time_ms) as place,
           count(*) over (partition by connection_id) as total from query_history)
       select connection_id, count(*) as queries, cast(sum(row_count) as bigint) as total_rows,
         cast(sum(execution_time_ms) as bigint) as total_ms, max(execution_time_ms) as max_ms,
         min(execution_time_ms) filter (where place * 2 >= total) as median_ms,
         min(execution_time_ms) filter (where place * 20 >= total * 19) as p95_ms
       from ranked group by connection_id""",
    ["query_history"],
)
def query_history_stats(spark, sf):
    return metadata.query_history_stats(table(spark, sf, "query_history"))
