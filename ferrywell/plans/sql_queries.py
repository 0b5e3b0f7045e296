"""Ad-hoc SQL over registered tables: one statement per operator family."""

from __future__ import annotations

from ferrywell.plans.inputs import table
from ferrywell.plans.registry import query

JOINS = """
    select 'inner and left' as kind, n.n_name as grp, count(o.o_orderkey) as n,
      cast(sum(cast(o.o_totalprice as decimal(18,2))) as decimal(28,2)) as amount
    from customer c join nation n on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey
    group by n.n_name
    union all
    select 'semi', c_mktsegment, count(*), cast(sum(cast(c_acctbal as decimal(18,2))) as decimal(28,2))
    from customer where exists (select 1 from orders where o_custkey = c_custkey) group by c_mktsegment
    union all
    select 'anti', p_brand, count(*), cast(sum(cast(p_retailprice as decimal(18,2))) as decimal(28,2))
    from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')
    group by p_brand
    union all
    select 'range', o_orderpriority, count(*), cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2))
    from orders join lineitem on l_orderkey = o_orderkey
      and l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval '900' day
    group by o_orderpriority"""


def _tables(spark, sf, names):
    for name in names.split():
        table(spark, sf, name)


@query("sql_joins", JOINS)
def sql_joins(spark, sf):
    _tables(spark, sf, "customer nation orders part lineitem")
    return spark.sql(JOINS)


AGGREGATES = """
    select 'rollup' as kind, l_returnflag as a, l_linestatus as b, count(*) as n,
      cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as amount
    from lineitem group by rollup (l_returnflag, l_linestatus)
    union all
    select 'cube', o_orderstatus, o_orderpriority, count(*), cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2))
    from orders group by cube (o_orderstatus, o_orderpriority)
    union all
    select 'grouping sets', p_brand, p_type, count(*), cast(sum(cast(p_retailprice as decimal(18,2))) as decimal(28,2))
    from part group by grouping sets ((p_brand), (p_type), ())
    union all
    select 'distinct', l_returnflag, null, count(distinct l_suppkey), null from lineitem group by l_returnflag
    union all
    select 'having', cast(o_custkey as varchar(20)), null, count(*), cast(max(cast(o_totalprice as decimal(18,2))) as decimal(28,2))
    from orders group by o_custkey having count(*) > 15"""


@query("sql_aggregates", AGGREGATES)
def sql_aggregates(spark, sf):
    _tables(spark, sf, "lineitem orders part")
    return spark.sql(AGGREGATES)


# Days are summed before the window, so a window holds at most the days of one priority.
WINDOWS = """
    with daily as (
      select o_orderpriority as priority, o_orderdate as day, count(*) as orders,
        cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as amount
      from orders group by o_orderpriority, o_orderdate)
    select priority, day, orders,
      cast(rank() over (partition by priority order by amount desc) as bigint) as amount_rank,
      cast(dense_rank() over (partition by priority order by orders desc) as bigint) as orders_rank,
      cast(row_number() over (partition by priority order by day) as bigint) as day_number,
      cast(ntile(10) over (partition by priority order by day) as bigint) as tenth,
      lag(orders) over (partition by priority order by day) as orders_before,
      lead(orders, 2) over (partition by priority order by day) as orders_after,
      cast(sum(amount) over (partition by priority order by day rows between unbounded preceding and current row) as decimal(38,2)) as running_amount,
      max(amount) over (partition by priority order by day rows between 6 preceding and current row) as week_best,
      first_value(amount) over (partition by priority order by day rows between 1 preceding and 1 following) as amount_first
    from daily"""


@query("sql_windows", WINDOWS)
def sql_windows(spark, sf):
    _tables(spark, sf, "orders")
    return spark.sql(WINDOWS)


SETOPS = """
    with buyers as (select o_custkey as id from orders where o_orderstatus = 'F'),
      others as (select o_custkey as id from orders where o_orderstatus = 'O'),
      unions as (select id from buyers union select id from others),
      both_sides as (select id from buyers intersect select id from others),
      only_first as (select id from buyers except select id from others),
      top_orders as (select o_orderkey as id, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25)
    select 'union' as kind, id from unions
    union all select 'intersect', id from both_sides
    union all select 'except', id from only_first
    union all select 'top 25', id from top_orders"""


@query("sql_setops_topk", SETOPS)
def sql_setops_topk(spark, sf):
    _tables(spark, sf, "orders")
    return spark.sql(SETOPS)


SCALARS = """
    select e.event_id, upper(e.event_type) as type_upper, substr(e.event_type, 1, 3) as type_head,
      cast(length(e.event_type) as int) as type_length, replace(e.event_type, 'e', '_') as type_replaced,
      concat(e.event_type, '-', cast(e.user_id as varchar(20))) as tag, lpad(cast(e.user_id as varchar(20)), 8, '0') as padded,
      coalesce(nullif(e.event_type, 'click'), 'pressed') as type_or, reverse(e.event_type) as type_reversed,
      cast(year(e.ts) as int) as y, cast(month(e.ts) as int) as m, cast(day(e.ts) as int) as d, cast(hour(e.ts) as int) as h,
      date_trunc('month', e.ts) as month_start,
      cast(floor(e.value) as bigint) as low, cast(ceil(e.value) as bigint) as high, abs(e.value - 100) as off,
      cast(round(cast(e.value as decimal(18,4)), 1) as decimal(18,1)) as rounded, e.event_id % 7 as remainder, cast(sign(e.value - 50) as int) as side,
      greatest(e.event_id, e.user_id) as larger, cast({json} as int) as k,
      case when {json} in ('1', '2', '3') then 'low' else 'high' end as k_band
    from events e"""


@query("sql_scalars", SCALARS.format(json="json_extract_string(e.props, '$.k')"))
def sql_scalars(spark, sf):
    _tables(spark, sf, "events")
    return spark.sql(SCALARS.format(json="get_json_object(e.props, '$.k')"))
