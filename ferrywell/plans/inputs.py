"""The provided tables, and the dirty, changing and drifting inputs derived from them.

The derived SQL reads every row of its table; arithmetic on the keys decides what happens to
a row (which cell is spoilt, which change it receives), in syntax that Spark and DuckDB share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DERIVED = {
    "dirty_events": """
        with b as (select * from events union all select * from events where event_id % 40 = 0)
        select case when event_id % 101 = 0 then null else event_id end as event_id,
          case when event_id % 101 = 0 then 'N/A'
               when event_id % 9 = 0 then '  ' || cast(user_id as varchar(20)) || chr(9)
               when event_id % 23 = 0 then 'unknown'
               else cast(user_id as varchar(20)) end as user_txt,
          case when event_id % 101 = 0 then ' - '
               when event_id % 7 = 0 then upper(event_type) || ' '
               when event_id % 13 = 0 then 'NULL'
               when event_id % 17 = 0 then 'nUlL'
               else event_type end as type_txt,
          case when event_id % 101 = 0 then ''
               when event_id % 3 = 0 then 'abc'
               else cast(cast(value as decimal(12,2)) as varchar(20)) end as amount_txt,
          case when event_id % 101 = 0 then null else value end as value
        from b""",
    # the same with numbers that are none, and a text whose number is infinite
    "odd_events": """
        select event_id, case when event_id % 211 = 3 then '1e999' else user_txt end as user_txt, type_txt, amount_txt,
          case when event_id % 307 = 5 then cast('Infinity' as double)
               when event_id % 120 = 0 then cast('NaN' as double) else value end as value
        from dirty_events""",
    # the target before the feed, and the feed of changes: together they read all orders
    "cdc_base": """
        select o_orderkey as k, cast(o_totalprice as decimal(12,2)) as price
        from orders where o_orderkey % 2 = 0""",
    "change_feed": """
        select o_orderkey as k, cast(o_totalprice as decimal(12,2)) as price, 2 as op, 1 as lsn, 1 as seq
          from orders where o_orderkey % 2 = 1
        union all select o_orderkey, cast(o_totalprice as decimal(12,2)), 3, 2, 1
          from orders where o_orderkey % 6 = 0
        union all select o_orderkey, cast(o_totalprice + 100 as decimal(12,2)), 4, 2, 2
          from orders where o_orderkey % 6 = 0
        union all select o_orderkey, cast(o_totalprice + 100 as decimal(12,2)), 3, 3, 1
          from orders where o_orderkey % 12 = 0
        union all select o_orderkey, cast(o_totalprice + 200 as decimal(12,2)), 4, 3, 2
          from orders where o_orderkey % 12 = 0
        union all select o_orderkey, cast(o_totalprice as decimal(12,2)), 1, 4, 1
          from orders where o_orderkey % 10 = 0
        union all select o_orderkey, cast(o_totalprice + 300 as decimal(12,2)), 2, 5, 1
          from orders where o_orderkey % 20 = 0""",
    "change_log": """
        select lsn * 10 + seq as lsn,
          case when k % 97 = 0 then '{broken'
               when op = 1 then '{"action":"D","identity":[{"name":"k","value":' || cast(k as varchar(20)) || '}]}'
               else '{"action":"' || case when op = 2 then 'I' else 'U' end
                    || '","columns":[{"name":"k","value":' || cast(k as varchar(20))
                    || '},{"name":"price","value":' || cast(price as varchar(20)) || '}]}' end as data
        from change_feed where op <> 3""",
    # changes that give only some columns: inserts without a priority, updates of one column, deletes, rows that return,
    # and a status set to null; has_ says whether the change gives the column
    "partial_base": """
        select o_orderkey as k, cast(o_totalprice as decimal(12,2)) as price, o_orderstatus as status, o_orderpriority as priority
        from orders where o_orderkey % 2 = 0""",
    "partial_changes": """
        select o_orderkey as k, 1 as lsn, 'I' as action, true as has_price, cast(o_totalprice as decimal(12,2)) as price,
            true as has_status, o_orderstatus as status, false as has_priority, cast(null as varchar(20)) as priority
          from orders where o_orderkey % 2 = 1
        union all select o_orderkey, 2, 'U', true, cast(o_totalprice + 100 as decimal(12,2)), false, null, false, null
          from orders where o_orderkey % 3 = 0
        union all select o_orderkey, 3, 'U', false, null, true, 'X', false, null from orders where o_orderkey % 5 = 0
        union all select o_orderkey, 4, 'D', false, null, false, null, false, null from orders where o_orderkey % 7 = 0
        union all select o_orderkey, 5, 'I', false, null, false, null, true, o_orderpriority from orders where o_orderkey % 14 = 0
        union all select o_orderkey, 6, 'U', false, null, true, null, false, null from orders where o_orderkey % 21 = 0
        union all select o_orderkey, 7, 'U', true, cast(o_totalprice as decimal(12,2)), false, null, true, null
          from orders where o_orderkey % 4 = 0""",
    "partial_log": """
        select lsn, case when action = 'D' then '{"action":"D","identity":[{"name":"k","value":' || cast(k as varchar(20)) || '}]}'
          else '{"action":"' || action || '","columns":[{"name":"k","value":' || cast(k as varchar(20)) || '}'
            || case when has_price then ',{"name":"price","value":' || cast(price as varchar(20)) || '}' else '' end
            || case when has_status then ',{"name":"status","value":' || coalesce('"' || status || '"', 'null') || '}' else '' end
            || case when has_priority then ',{"name":"priority","value":' || coalesce('"' || priority || '"', 'null') || '}' else '' end
            || ']}' end as data
        from partial_changes""",
    # two more columns: floats above 1e15, and decimals whose cents do not tell them apart
    "source_lineitem": """
        select *, cast(floor(l_extendedprice) as double) * cast(1000000000000 as double) as big_value,
          cast(l_linenumber * 0.00001 as decimal(18,8)) as small_value
        from lineitem""",
    "target_lineitem": """
        select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
          case when l_orderkey % 500 = 7 then l_extendedprice + 0.5 else l_extendedprice end as l_extendedprice,
          l_discount, case when l_orderkey % 50 = 7 then l_tax + 0.01 else l_tax end as l_tax,
          l_returnflag, l_linestatus, l_shipdate, cast(floor(l_extendedprice) as double) * cast(1000000000000 as double) as big_value,
          cast(l_linenumber * 0.00001 as decimal(18,8)) + cast(0.00000400 as decimal(18,8)) as small_value
        from lineitem where l_orderkey % 1000 <> 3""",
    "orders_versioned": """
        select o_orderkey, o_custkey, cast(o_totalprice as decimal(12,2)) as o_totalprice, o_orderdate as created_at,
          case when o_orderkey % 8 = 0 then o_orderdate + interval '400' day else o_orderdate end as updated_at
        from orders""",
    "target_orders": """
        select o_orderkey, o_custkey, o_totalprice, created_at,
          case when updated_at <= timestamp '1999-12-31' then updated_at else created_at end as updated_at
        from orders_versioned where created_at <= timestamp '1999-12-31'""",
    "run_ledger": """
        select user_id % 20 as pipeline_id, event_id as run_id, ts as started_at,
          case when event_type = 'error' then 'error' else 'success' end as status,
          cast(floor(value * 100) as bigint) as rows_loaded, event_id % 37 as elapsed_seconds
        from events""",
    "query_history": """
        select 'connection-' || cast(user_id % 20 as varchar(20)) as connection_id,
          cast(floor(value * 100) as bigint) as execution_time_ms, event_id % 1000 as row_count
        from events""",
    "error_log": """
        select event_id,
          case event_id % 8
            when 0 then 'Connection refused by host' when 1 then 'Login failed for user'
            when 2 then 'Operation timed out' when 3 then 'SSL handshake error'
            when 4 then 'Unknown database dev does not exist' when 5 then 'ORA TNS no listener'
            when 6 then 'connection refused: timed out' else 'Other failure' end as message
        from events""",
    # one field description per part: which dialect, type and sizes follows from the part key
    "column_catalogue": """
        select p_partkey as column_id,
          case p_partkey % 9 when 0 then 'sqlserver' when 1 then 'postgresql' when 2 then 'mysql' when 3 then 'oracle'
            when 4 then 'sap_hana' when 5 then 'abap' when 6 then 'MariaDB' when 7 then 'redshift' else 'mssql' end as dialect,
          case p_size when 1 then 'varchar' when 2 then 'NVARCHAR(80)' when 3 then 'decimal' when 4 then 'DECIMAL(10)'
            when 5 then 'decimal(12,2)' when 6 then 'numeric(45,3)' when 7 then 'int' when 8 then 'bigint'
            when 9 then 'smallint' when 10 then 'tinyint' when 11 then 'mediumint' when 12 then 'money'
            when 13 then 'float' when 14 then 'double precision' when 15 then 'double' when 16 then 'real'
            when 17 then 'bit' when 18 then 'boolean' when 19 then 'date' when 20 then 'time'
            when 21 then 'datetime' when 22 then 'datetimeoffset' when 23 then 'timestamp'
            when 24 then 'timestamp with time zone' when 25 then 'text' when 26 then 'clob' when 27 then 'json'
            when 28 then 'xml' when 29 then 'uuid' when 30 then 'uniqueidentifier' when 31 then 'blob'
            when 32 then 'varbinary' when 33 then 'number' when 34 then 'NUMBER(20,4)' when 35 then 'varchar2(400)'
            when 36 then 'char(1)' when 37 then 'CURR' when 38 then 'QUAN' when 39 then 'DEC' when 40 then 'CHAR'
            when 41 then 'DATS' when 42 then 'ACCP' when 43 then 'INT4' when 44 then 'interval' when 45 then 'year'
            when 46 then 'rowid' when 47 then 'st_point' when 48 then 'array' when 49 then 'varchar(20000000)'
            else 'made_up_type' end as source_type,
          cast(case when p_partkey % 4 = 1 then p_size when p_partkey % 4 = 2 then 0 end as int) as length,
          cast(case when p_partkey % 4 = 3 then p_size end as int) as precision,
          cast(case when p_partkey % 8 = 3 then 2 when p_partkey % 8 = 7 then 60 end as int) as scale
        from part""",
    # every order as a text row, some of its cells unfit for the contract
    "order_texts": """
        select cast(o_orderkey as varchar(20)) as o_orderkey,
          case when o_orderkey % 11 = 0 then null when o_orderkey % 19 = 0 then 'cust-' || cast(o_custkey as varchar(20))
               else cast(o_custkey as varchar(20)) end as o_custkey,
          case when o_orderkey % 13 = 0 then 'twelve'
               else cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) end as o_totalprice,
          o_orderpriority,
          case when o_orderkey % 29 = 0 then '31/02/' || cast(1990 + o_orderkey % 9 as varchar(4))
               else cast(cast(o_orderdate as date) as varchar(10)) end as o_orderdate
        from orders""",
    # regions feed nations, nations feed customers, customers feed orders; each nation also has a
    # view that reads the nation and writes back to it, so the graph has cycles
    "lineage_edges": """
        select 'region:' || cast(n_regionkey as varchar(20)) as source, 'nation:' || cast(n_nationkey as varchar(20)) as target from nation
        union all select 'nation:' || cast(n_nationkey as varchar(20)), 'view:' || cast(n_nationkey as varchar(20)) from nation
        union all select 'view:' || cast(n_nationkey as varchar(20)), 'nation:' || cast(n_nationkey as varchar(20)) from nation
        union all select 'nation:' || cast(c_nationkey as varchar(20)), 'customer:' || cast(c_custkey as varchar(20)) from customer
        union all select 'customer:' || cast(o_custkey as varchar(20)), 'order:' || cast(o_orderkey as varchar(20)) from orders""",
}

# which views each derived view reads
NEEDS = {
    "dirty_events": ["events"],
    "odd_events": ["dirty_events"],
    "cdc_base": ["orders"],
    "change_feed": ["orders"],
    "change_log": ["change_feed"],
    "partial_base": ["orders"],
    "partial_changes": ["orders"],
    "partial_log": ["partial_changes"],
    "source_lineitem": ["lineitem"],
    "target_lineitem": ["lineitem"],
    "orders_versioned": ["orders"],
    "target_orders": ["orders_versioned"],
    "run_ledger": ["events"],
    "query_history": ["events"],
    "error_log": ["events"],
    "column_catalogue": ["part"],
    "order_texts": ["orders"],
    "lineage_edges": ["nation", "customer", "orders"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided or derived table, also registered as a view of that name."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        for needed in NEEDS[name]:
            table(spark, sf_dir, needed)
        df = spark.sql(DERIVED[name])
    df.createOrReplaceTempView(name)
    return df
