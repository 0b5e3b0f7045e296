"""File formats and streams: the tables are written in the format, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywell.functions import text
from ferrywell.operators import cdc, cells
from ferrywell.plans.inputs import table
from ferrywell.plans.registry import SHARED, query
from ferrywell.session import new_folder
from ferrywell.sinks.tables import export, export_xml
from ferrywell.sinks.versioned import VersionedTable
from ferrywell.sources import files
from ferrywell.streaming.streams import cdc_log_stream, cdc_stream, incremental_stream

DELIMITERS = [",", ";", "\t", "|"]


@query("scan_delimited", "select * from customer")
def scan_delimited(spark, sf):
    customers = table(spark, sf, "customer")
    path = new_folder(spark, "delimited")
    for i, sep in enumerate(DELIMITERS):
        part = customers.where(F.pmod("c_custkey", F.lit(len(DELIMITERS))) == i)
        # files of one folder may also list the columns in another order
        part.select(*part.columns[::-1] if i % 2 else part.columns).write.mode("append").option("header", True).option("sep", sep).csv(path)
    return files.read_delimited(spark, path, schema=customers.schema)


SHARED["flat_customers"] = (
    [],
    "select c_custkey as id, c_name as name, c_acctbal as account_balance, c_mktsegment as account_segment, "
    "cast(c_nationkey as bigint) as account_nation_key from customer",
)


@query(
    "scan_json_records",
    """select 'customer' as kind, c_custkey as id, c_acctbal as account_balance, cast(c_nationkey as bigint) as account_nation_key from customer
       union all select 'segment ' || c_mktsegment, c_custkey, null, null from customer""",
)
def scan_json_records(spark, sf):
    """Documents that hold their records in a member, beside another, empty list."""
    table(spark, sf, "customer")
    documents = spark.sql(
        """select concat('{"meta":{"size":2},"rows":[',
             to_json(named_struct('kind', 'customer', 'id', c_custkey, 'account',
               named_struct('balance', c_acctbal, 'nation', named_struct('key', c_nationkey)))), ',',
             to_json(named_struct('kind', concat('segment ', c_mktsegment), 'id', c_custkey)), '],"errors":[]}') as value
           from customer"""
    )
    path = new_folder(spark, "json-documents")
    documents.write.text(path)
    return files.read_json_records(spark, path, lines=True)


@query("scan_json_lines", "select * from flat_customers", ["flat_customers"])
def scan_json_lines(spark, sf):
    customers = table(spark, sf, "customer")
    nested = customers.selectExpr(
        "c_custkey as id", "c_name as name",
        "named_struct('balance', c_acctbal, 'segment', c_mktsegment, 'nation', named_struct('key', c_nationkey)) as account",
    )
    path = new_folder(spark, "json-lines")
    export(nested, path, "json")
    return files.read_json_records(spark, path, lines=True)


@query("scan_parquet", "select * from lineitem")
def scan_parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/lineitem.parquet")


@query("scan_xml", "select * from customer")
def scan_xml(spark, sf):
    customers = table(spark, sf, "customer")
    path = new_folder(spark, "xml")
    export_xml(customers, path, "row", "rows")
    return files.read_xml(spark, path, "row", customers.schema)


@query("list_objects")
def list_objects(spark, sf):
    return files.list_objects(spark, sf)


@query(
    "list_table_objects",
    "select l_returnflag, count(*) as rows, true as all_listed from lineitem group by l_returnflag",
)
def list_table_objects(spark, sf):
    """The inventory of a stored table: every file that holds its rows is listed, with its size."""
    path = new_folder(spark, "inventory")
    table(spark, sf, "lineitem").write.partitionBy("l_returnflag").parquet(path)
    name = "regexp_replace({}, '^([a-z0-9]+):/+', '$1:/')"  # one or three strokes after the scheme
    listed = files.list_objects(spark, path).selectExpr(f"{name.format('path')} as file", "length")
    held = spark.read.parquet(path).groupBy("l_returnflag", "_metadata.file_path", "_metadata.file_size").count()
    held = held.selectExpr("l_returnflag", f"{name.format('file_path')} as file", "file_size", "count")
    return held.join(listed, "file", "left").groupBy("l_returnflag").agg(
        F.sum("count").alias("rows"), F.every(F.coalesce(F.col("length") == F.col("file_size"), F.lit(False))).alias("all_listed"))


@query(
    "register_view",
    r"""with named as (
          select p_partkey, regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[-. ]', '_', 'g'), '[^a-z0-9_]', '', 'g') as plain
          from part)
        select p_partkey, case when plain = '' or regexp_matches(plain, '^\d') then 't_' || plain else plain end as table_name from named""",
)
def register_view(spark, sf):
    name = files.register_view(table(spark, sf, "part"), "My-Parts v1.2.parquet")
    names = spark.sql(f"select p_partkey, concat(p_name, '-', p_brand, '.csv') as filename from {name}")
    return names.select("p_partkey", text.table_name(F.col("filename")).alias("table_name"))


def _round_trip(spark, sf, fmt):
    orders = table(spark, sf, "orders")
    path = new_folder(spark, f"export-{fmt}")
    export(orders, path, fmt)
    reader = spark.read.schema(orders.schema)
    return reader.options(**text.CSV_READ, multiLine=True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


@query("export_csv", "select * from orders")
def export_csv(spark, sf):
    return _round_trip(spark, sf, "csv")


@query("export_csv_texts", "select * from documents")
def export_csv_texts(spark, sf):
    """Texts with quotes, line breaks and white space at their ends, exported and read by the reader for uploads."""
    docs = table(spark, sf, "documents")
    path = new_folder(spark, "export-texts")
    export(docs, path, "csv")
    return files.read_delimited(spark, path, schema=docs.schema)


@query("export_json", "select * from orders")
def export_json(spark, sf):
    return _round_trip(spark, sf, "json")


@query("export_parquet", "select * from orders")
def export_parquet(spark, sf):
    return _round_trip(spark, sf, "parquet")


# -- streams ---------------------------------------------------------------------------------


@query(
    "stream_incremental",
    "select o_orderkey as O_ORDERKEY, o_custkey as O_CUSTKEY, o_totalprice as O_TOTALPRICE, created_at as CREATED_AT, "
    "updated_at as UPDATED_AT from orders_versioned",
    ["orders_versioned"],
)
def stream_incremental(spark, sf):
    """The old state arrives first, then what changed since, then the old state once more, late; each run sees only the new files."""
    old, new = table(spark, sf, "target_orders"), table(spark, sf, "orders_versioned")
    arrivals, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "stream")
    target = VersionedTable(spark, new_folder(spark, "stream-target"), ["O_ORDERKEY"])
    for i, part in enumerate((old, new, old)):
        part.write.parquet(f"{arrivals}/{i}")
        incremental_stream(spark, arrivals, new.schema, target, "updated_at", checkpoint).awaitTermination()
    return target.read()


@query("stream_cdc", "select * from applied", ["applied"])
def stream_cdc(spark, sf):
    """Changes arrive out of order: the last positions first, the early ones late."""
    feed = table(spark, sf, "change_feed")
    arrivals, checkpoint = new_folder(spark, "changes"), new_folder(spark, "stream")
    target = VersionedTable(spark, new_folder(spark, "stream-target"), ["k"])
    target.replace(cdc.with_position(table(spark, sf, "cdc_base")))
    for i, part in enumerate((feed.where("lsn > 3"), feed.where("lsn <= 2"), feed.where("lsn = 3"))):
        part.write.parquet(f"{arrivals}/{i}")
        cdc_stream(spark, arrivals, feed.schema, target, checkpoint).awaitTermination()
    return cdc.current_rows(target)


@query(
    "stream_cdc_json",
    """with last_read as (
         select * exclude (place) from (
           select *, row_number() over (partition by k order by lsn desc) as place from read_changes) where place = 1)
       select k, price, cast(null as varchar) as reason from cdc_base b where not exists (select 1 from last_read c where c.k = b.k)
       union all select k, price, null from last_read where action <> 'D'
       union all select null, null, 'Malformed change' from change_log where not json_valid(data)""",
    ["cdc_base", "read_changes"],
)
def stream_cdc_json(spark, sf):
    """A JSON log arrives out of order; the target, and the reasons of what was set aside."""
    log, base = table(spark, sf, "change_log"), table(spark, sf, "cdc_base")
    arrivals, checkpoint, aside = new_folder(spark, "log"), new_folder(spark, "stream"), new_folder(spark, "aside")
    target = VersionedTable(spark, new_folder(spark, "stream-target"), ["k"])
    target.replace(cells.with_places(base, ["k"]))
    for i, part in enumerate((log.where("lsn > 30"), log.where("lsn <= 30"))):
        part.write.parquet(f"{arrivals}/{i}")
        cdc_log_stream(spark, arrivals, log.schema, base.schema, target, aside, checkpoint).awaitTermination()
    return cdc.current_rows(target).unionByName(spark.read.parquet(aside).select("reason"), allowMissingColumns=True)
