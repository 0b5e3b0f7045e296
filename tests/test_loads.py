import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import positions
from ferrywell.operators import cdc, cells
from ferrywell.operators.reconcile import changed_buckets, reconcile, reconcile_sums
from ferrywell.plans import loads
from ferrywell.session import Folder, new_folder, shared_folder
from ferrywell.sinks import tables
from ferrywell.sinks.versioned import VersionedTable
from ferrywell.streaming.streams import cdc_stream, incremental_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def target(spark):
    return VersionedTable(spark, new_folder(spark, "test"), keys=["k"], buckets=4)


def feed(spark, *changes):
    return spark.createDataFrame(changes, "k int, v string, op int, lsn int, seq int")


def data_files(spark, table):
    return Folder(spark, f"{table.path}/data").names()


# -- versioned tables ------------------------------------------------------------------------


def test_unfinished_write_is_not_seen(spark, target):
    target.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    # a writer that died: data without commit, and a commit cut off in the middle
    spark.createDataFrame([(9, "z")], "k int, v string").write.parquet(f"{target.path}/data/000000000002-dead")
    Folder(spark, f"{target.path}/commits").create_text("000000000002.json", '{"version": 2, "sch')
    assert rows(target.read()) == [(1, "a")]
    more = spark.createDataFrame([(2, "b")], "k int, v string")
    with pytest.raises(Exception, match="(?i)exist"):
        target.append(more)
    target.drop_damaged_commits()
    target.append(more)
    assert rows(target.read()) == [(1, "a"), (2, "b")]


def test_second_writer_of_a_version_fails(spark, target):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    target.replace(df)
    commit = target.commit()
    with pytest.raises(Exception, match="(?i)exist"):
        target._write_commit(commit)


def test_write_in_between_is_not_undone(spark, target):
    target.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    base = target.commit()
    kept = target.read(None, base).where("k = 2")
    tables.upsert_table(target, spark.createDataFrame([(1, "other writer")], "k int, v string"), [])
    with pytest.raises(Exception, match="(?i)exist"):
        target.replace_buckets(kept, list(range(4)), base)
    assert rows(target.read()) == [(1, "other writer"), (2, "b")]


def test_other_columns_or_keys_are_refused(spark, target):
    target.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(ValueError, match="columns differ"):
        target.append(spark.createDataFrame([(1, 2)], "k int, v int"))
    with pytest.raises(ValueError, match="keyed by"):
        VersionedTable(spark, target.path, ["v"], 4).append(target.read())


def test_upsert_rewrites_only_touched_buckets(spark, target):
    target.replace(spark.range(100).selectExpr("cast(id as int) as k", "'old' as v"))
    tables.upsert_table(target, spark.createDataFrame([(7, "new"), (200, "new")], "k int, v string"), [])
    commit = target.commit()
    touched = target.summary(spark.createDataFrame([(7,), (200,)], "k int")).touched
    assert len(touched) < 4 and commit["parts"][-1]["buckets"] == touched
    assert set(commit["parts"][0]["buckets"]) == set(range(4)) - set(touched)
    assert target.read().count() == 101
    assert rows(target.read().where("v = 'new'")) == [(200, "new"), (7, "new")]


def test_upsert_may_read_the_table_it_writes(spark, target):
    target.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    tables.upsert_table(target, target.read().selectExpr("k", "upper(v) as v"), [])
    assert rows(target.read()) == [(1, "A"), (2, "B")]


def test_null_keys_are_rejected(spark, target):
    target.replace(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(ValueError, match="null key"):
        tables.upsert_table(target, spark.createDataFrame([(None, "x")], "k int, v string"), [])
    assert rows(target.read()) == [(1, "a")]


def test_batch_keeps_the_highest_of_equal_keys(spark, target):
    batch = spark.createDataFrame([(1, "a", 5), (1, "b", 9), (1, "c", 9)], "k int, v string, w int")
    tables.upsert_table(target, batch, ["w"])
    assert rows(target.read()) == [(1, "c", 9)]


def test_many_versions_are_merged_and_old_ones_dropped(spark):
    table = VersionedTable(spark, new_folder(spark, "test"), keys=["k"], buckets=2, max_versions=3)
    for i in range(8):
        tables.upsert_table(table, spark.createDataFrame([(i, "x"), (0, str(i))], "k int, v string"), ["v"])
    assert len(table.commit()["parts"]) <= 3
    assert rows(table.read()) == sorted([(0, "7")] + [(i, "x") for i in range(1, 8)], key=repr)
    table.drop_old_versions()
    assert set(data_files(spark, table)) == {p["folder"] for p in table.commit()["parts"]}
    assert table.read().count() == 8


def test_small_parts_are_merged_and_large_ones_left(spark):
    table = VersionedTable(spark, new_folder(spark, "test"), keys=["k"], buckets=64, max_versions=4)
    table.replace(spark.range(500).selectExpr("cast(id as int) as k", "'old' as v"))
    large = table.commit()["parts"][0]["folder"]
    for i in range(9):
        tables.upsert_table(table, spark.createDataFrame([(i, "new")], "k int, v string"), [])
        assert len(table.commit()["parts"]) <= 5
    assert large in {p["folder"] for p in table.commit()["parts"]}
    assert rows(table.read()) == sorted([(i, "new" if i < 9 else "old") for i in range(500)], key=repr)


def test_hot_bucket_is_written_by_several_tasks(spark):
    skewed = spark.range(200_000, numPartitions=8).selectExpr(
        "case when id % 3 = 0 then 1 else id end as k", "md5(cast(id as string)) as v"
    )
    table = VersionedTable(spark, new_folder(spark, "test"), keys=["k"], buckets=8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "512KB")
    try:
        table.replace(skewed)
    finally:
        spark.conf.set(size, before)
    files = table.read().groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("hot")).collect()
    assert sum(f.n for f in files) == 200_000
    assert sum(f.hot > 0 for f in files) > 1 and max(f.n for f in files) < 66_000


def test_append_leaves_files_alone(spark):
    table = VersionedTable(spark, new_folder(spark, "test"))
    table.append(spark.range(3).toDF("k"))
    first = data_files(spark, table)
    table.append(spark.range(2).toDF("k"))
    assert set(first) < set(data_files(spark, table)) and table.read().count() == 5


def test_empty_table_can_be_read(spark, target):
    target.replace(spark.createDataFrame([], "k int, v string"))
    assert target.read().columns == ["k", "v"] and target.read().count() == 0


def test_cluster_needs_a_named_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Conf.get = lambda self, key, default: "hdfs://shared/folder/"
    assert shared_folder(Session()) == "hdfs://shared/folder"


# -- full and incremental --------------------------------------------------------------------


def test_coercion_for_the_target(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql(
            """select array(1, 2) as a, map('k', 1) as m, named_struct('x', 1) as s, cast(null as array<int>) as n,
                 timestamp '2024-10-27 01:30:00Z' as t, 1.5D as d, date '2024-01-01' as day"""
        )
        row = loads.coerce_for_target(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # 01:30 UTC is the second of two equal local times that night
    assert row[:] == ("[1,2]", '{"k":1}', '{"x":1}', None, dt.datetime(2024, 10, 27, 1, 30), 1.5, dt.date(2024, 1, 1))


def test_watermark_filter_reaches_the_scan(spark):
    path = new_folder(spark, "scan")
    spark.range(10).selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id as int)) as t").write.parquet(path)
    source = spark.read.parquet(path)
    found = loads.rows_after(source, "t", "2024-01-05 00:00:00")
    assert found.count() == 5
    plan = found.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t,2024-01-05T00:00)" in plan


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_watermarks_resume_in_utc(spark, target, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        source = spark.sql("select 1 as k, timestamp '2024-05-01 10:00:00Z' as t union all select 2, timestamp '2024-05-01 11:00:00Z'")
        table = VersionedTable(spark, new_folder(spark, "test"), keys=["K"], buckets=2)
        loads.incremental_load(source, table, "t")
        assert table.state["watermark:t"] == "2024-05-01 11:00:00"
        more = source.unionByName(spark.sql("select 3 as k, timestamp '2024-05-01 11:00:01Z' as t"))
        assert loads.incremental_load(more, table, "t")["rows_loaded"] == 1
        assert table.read().count() == 3
        # without stored state the target's maximum gives the same point
        assert loads.resume_point(table.read(), "T") == "2024-05-01 11:00:01"
        assert loads.resume_point(more, "t") == "2024-05-01 11:00:01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_incremental_ties(spark):
    old = spark.createDataFrame([(1, 10)], "k int, w int")
    late = spark.createDataFrame([(1, 10), (2, 10)], "k int, w int")
    for inclusive, expected in ((False, 1), (True, 2)):
        table = VersionedTable(spark, new_folder(spark, "test"), keys=["K"], buckets=2)
        loads.incremental_load(old, table, "w")
        loads.incremental_load(late, table, "w", inclusive=inclusive)
        assert table.read().count() == expected
    with pytest.raises(ValueError):
        loads.incremental_load(late, VersionedTable(spark, new_folder(spark, "test")), "w", inclusive=True)


@pytest.mark.parametrize("keys", [["K"], []])
def test_incremental_without_new_rows(spark, keys):
    table = VersionedTable(spark, new_folder(spark, "test"), keys=keys, buckets=2)
    source = spark.createDataFrame([(1, 10), (2, 10)], "k int, w int")
    assert loads.incremental_load(source, table, "w")["rows_loaded"] == 2
    version, files = table.version, data_files(spark, table)
    assert loads.incremental_load(source, table, "w")["rows_loaded"] == 0
    assert table.version == version and data_files(spark, table) == files
    more = source.unionByName(spark.createDataFrame([(3, 11), (1, 12), (1, 13)], source.schema))
    stats = loads.incremental_load(more, table, "w")
    assert stats["rows_loaded"] == 3 and stats["new_watermark"] == "13"
    assert table.read().count() == (3 if keys else 5)


def test_job_records_failures(spark):
    table = VersionedTable(spark, new_folder(spark, "test"))
    df = spark.range(3).toDF("k")
    assert loads.run_job(spark, loads.LoadJob("a", "full_load", df, table, auto_reconcile=True)).first().reconciled
    wrong = loads.run_job(spark, loads.LoadJob("b", "sideways", df, table)).first()
    assert wrong.status == "error" and "sideways" in wrong.error


# -- change data -----------------------------------------------------------------------------


def test_last_change_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = feed(
        spark, (1, "a1", 4, 1, 1), (1, "a2", 4, 1, 2), (2, None, 1, 2, 1), (4, "d", 2, 2, 2), (4, None, 1, 3, 1),
        (3, None, 1, 4, 1), (3, "c2", 2, 5, 1), (1, "before", 3, 9, 9),
    )
    assert rows(cdc.cdc_apply(base, changes, ["k"])) == [(1, "a2"), (3, "c2")]


def test_counts_per_operation(spark):
    changes = feed(spark, *[(1, "x", op, i, 1) for i, op in enumerate([1, 2, 2, 3, 3, 3, 4, 4, 4, 4])])
    assert cdc.cdc_counts(changes).first()[:] == (2, 4, 1)


def test_window_bounds(spark):
    changes = feed(spark, *[(i, "x", 2, i, 1) for i in range(1, 6)])
    assert sorted(r.k for r in cdc.cdc_window(changes, 2, 4).collect()) == [3, 4]
    assert cdc.cdc_window(changes).count() == 5


def test_batches_replays_and_late_changes(spark, target):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = [(1, "a1", 4, 1, 1), (2, None, 1, 2, 1), (5, "e", 2, 3, 1), (1, "a2", 4, 4, 1), (5, None, 1, 5, 1)]
    expected = rows(cdc.cdc_apply(base, feed(spark, *changes), ["k"]))
    # late first, then the rest out of order, then everything again
    for order in ([3, 4], [0, 1], [2], [0, 1, 2, 3, 4]):
        if target.commit() is None:
            target.replace(cdc.with_position(base))
        cdc.cdc_merge(target, feed(spark, *[changes[i] for i in order]))
    assert rows(cdc.current_rows(target)) == expected == [(1, "a2"), (3, "c")]


def test_position_moves_with_the_data(spark, target):
    target.replace(cdc.with_position(spark.createDataFrame([(1, "a")], "k int, v string")))
    changes = [(1, "b", 4, 1, 1), (2, "c", 2, 2, 1)]
    assert loads.cdc_load(feed(spark, *changes), target)["rows_loaded"] == 2
    assert target.state["lsn"] == "2"
    assert loads.cdc_load(feed(spark, *changes, (1, "z", 4, 3, 1)), target)["rows_loaded"] == 1
    assert rows(cdc.current_rows(target)) == [(1, "z"), (2, "c")]


def test_json_log_lines(spark):
    lines = [
        '{"action":"I","columns":[{"name":"k","value":1},{"name":"v","value":"a\\"b"}]}',
        '{"action":"update","columns":[{"name":"k","value":1},{"name":"v","value":null}]}',
        '{"action":"D","identity":[{"name":"k","value":2}]}',
        '{"action":"I","columns":[{"name":"k","value":3},{"name":"v","value":"x"},{"name":"v","value":"y"}]}',
        '{"action":"B"}', "{broken", '{"action":"I","columns":[{"value":3}]}', '{"no":"action"}', None,
    ]
    log = spark.createDataFrame(list(enumerate(lines)), "lsn int, data string")
    parsed = {r.lsn: (r.action, r.op, r.cells) for r in cdc.parse_change_json(log).collect()}
    assert parsed[0] == ("I", 2, {"k": "1", "v": 'a"b'})
    assert parsed[1] == ("update", 4, {"k": "1", "v": None})
    assert parsed[2] == ("D", 1, {"k": "2"})
    assert parsed[3] == ("I", 2, {"k": "3", "v": "y"})
    assert parsed[4] == ("B", None, None)
    assert sorted(r.lsn for r in cdc.broken_changes(log).collect()) == [5, 6, 7, 8]
    base = spark.createDataFrame([(2, "old"), (4, "kept")], "k int, v string")
    assert rows(cdc.cdc_apply_json(base, log, ["k"])) == [(1, None), (3, "y"), (4, "kept")]


def test_log_is_parsed_once_per_line(spark):
    log = spark.createDataFrame([(1, "{}")], "lsn int, data string")
    base = spark.createDataFrame([(2, "old")], "k int, v string")
    plan = cdc.log_as_feed(log, base.schema)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def partial_log(spark, *changes):
    lines = []
    for lsn, (action, given) in changes:
        entries = [{"name": n, "value": v} for n, v in given.items()]
        lines.append((lsn, json.dumps({"action": action, ("identity" if action == "D" else "columns"): entries})))
    return spark.createDataFrame(lines, "lsn int, data string")


PARTIAL = list(enumerate([
    ("U", {"k": 1, "a": "new"}), ("U", {"k": 1, "b": None}), ("D", {"k": 2}), ("U", {"k": 2, "b": "back"}), ("I", {"k": 3, "b": "b3"}),
    ("I", {"k": 4, "a": "a4", "b": "b4"}), ("U", {"k": 4, "a": "a5"}), ("D", {"k": 5}), ("U", {"k": 6, "a": "x"}), ("U", {"k": 6, "a": "y", "b": "z"}),
], 1))
PARTIAL_BASE = [(1, "a1", "b1"), (2, "a2", "b2"), (3, "a3", "b3"), (5, "a5", "b5"), (6, "a6", "b6"), (7, "a7", None)]
PARTIAL_AFTER = [(1, "new", None), (2, None, "back"), (3, None, "b3"), (4, "a5", "b4"), (6, "y", "z"), (7, "a7", None)]


def test_cells_that_a_change_leaves_out_keep_their_value(spark):
    base = spark.createDataFrame(PARTIAL_BASE, "k int, a string, b string")
    assert rows(cdc.cdc_apply_json(base, partial_log(spark, *PARTIAL), ["k"])) == PARTIAL_AFTER
    with pytest.raises(ValueError, match="no value for one of its keys"):
        cells.apply(base, spark.createDataFrame([(None, "a", "b", 4, 1, 1)], "k int, a string, b string, op int, lsn int, seq int"), ["k"])


@pytest.mark.parametrize("seed", range(3))
def test_partial_changes_late_and_repeated(spark, target, seed):
    """Batches in any order, some twice: the same target, cell by cell."""
    order = PARTIAL * 2
    random.Random(seed).shuffle(order)
    base = spark.createDataFrame(PARTIAL_BASE, "k int, a string, b string")
    target.replace(cells.with_places(base, ["k"]))
    for part in (order[:5], order[5:11], order[11:]):
        cells.merge(target, cdc.log_as_cells(partial_log(spark, *part), base.schema, keys=["k"]))
    assert rows(cdc.current_rows(target)) == PARTIAL_AFTER


def test_log_job_moves_its_position(spark, target):
    base = spark.createDataFrame(PARTIAL_BASE, "k int, a string, b string")
    target.replace(cells.with_places(base, ["k"]))
    for part in (PARTIAL[:4], PARTIAL):
        job = loads.LoadJob("log", "cdc_log", partial_log(spark, *part), target)
        assert loads.run_job(spark, job).first().status == "success"
    assert rows(cdc.current_rows(target)) == PARTIAL_AFTER and target.state["lsn"] == "10"


SPELLINGS = {
    "int": ([9, 10, 255, 4096], "int"),
    "hex": (["0x09", "a", "\\xFF", "0X1000"], "string"),
    "halves": (["0/9", "0/A", "0/ff", "0/1000"], "string"),
    "binary": ([b"\x09", b"\x00\x0a", b"\xff", b"\x10\x00"], "binary"),
}


@pytest.mark.parametrize("spelling", SPELLINGS)
def test_positions_in_their_own_spelling(spark, target, spelling):
    places, kind = SPELLINGS[spelling]
    changes = [(1, "a", 4, places[0], 1), (1, "b", 4, places[1], 1), (2, None, 1, places[2], 1), (1, "c", 4, places[3], 1)]
    schema = f"k int, v string, op int, lsn {kind}, seq int"
    target.replace(cdc.with_position(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")))
    feed = spark.createDataFrame(changes, schema)
    assert loads.cdc_load(feed, target, to_lsn=places[1])["rows_loaded"] == 2
    assert rows(cdc.current_rows(target)) == [(1, "b"), (2, "y")]
    assert loads.cdc_load(feed, target)["rows_loaded"] == 2
    assert loads.cdc_load(feed, target)["rows_loaded"] == 0
    cdc.cdc_merge(target, spark.createDataFrame(changes[:2], schema))  # late
    assert rows(cdc.current_rows(target)) == [(1, "c")]


def test_positions_that_cannot_be_read_are_refused(spark):
    for text in ("12/34/5", "0xG1", "", "1" * 33):
        feed = spark.createDataFrame([(1, "a", 4, text, 1)], "k int, v string, op int, lsn string, seq int")
        with pytest.raises(Exception, match="not a change position"):
            cdc.cdc_latest(feed, ["k"]).collect()
    numbers = spark.createDataFrame([(-5,), (3,), (None,)], "n bigint").select(positions.position(F.col("n"), T.LongType()).alias("p"), "n")
    assert [r.n for r in numbers.orderBy("p").collect()] == [None, -5, 3]


# -- reconciliation --------------------------------------------------------------------------


def test_sums_are_exact_and_do_not_overflow(spark):
    big = spark.range(1000).selectExpr("9223372036854775807 as n", "0.1D as d", "cast(1e20 as decimal(28,2)) as p", "-5 as m")
    sums = {r.column_name: r.source_sum for r in reconcile_sums(big, big).collect()}
    assert sums["n"] == "9223372036854775807000" and float(sums["d"]) == 100.0
    assert sums["p"] == "100000000000000000000000.00" and sums["m"] == "-5000"


def test_reconcile_never_passes_falsely(spark):
    def verdict(here, there):
        return reconcile(spark.sql(f"select {here} as v"), spark.sql(f"select {there} as v")).first().overall_passed

    assert not verdict("1e15D", "5e18D") and verdict("5e18D", "5e18D") and verdict("-0.5D", "-0.5D")
    assert not verdict("1e25D", "1e25D")  # not summed, so not proven
    assert not verdict("double('NaN')", "double('NaN')") and not verdict("double('-Infinity')", "double('-Infinity')")
    small = spark.range(100_000).selectExpr("cast(0.00004 as decimal(18,8)) as v")
    assert not reconcile(small, small.selectExpr("cast(0 as decimal(18,8)) as v")).first().sums_passed
    assert reconcile(small, small).first().overall_passed
    # a sum beyond 38 digits is reported
    wide = spark.range(20).selectExpr("cast('99999999999999999999999999999999999999' as decimal(38,0)) as v")
    found = reconcile_sums(wide, wide).first()
    assert not found.sum_match and found.source_lost > 0


def test_reconcile_counts_what_rounding_loses(spark):
    fine = Decimal("0.0001")
    rows, dealt = spark.range(0, 1_000_000, 1, 8), spark.range(0, 1_000_000, 1, 3)
    for value, other in (("4e-10D", "0D"), ("-4e-10D", "0D"), ("7.0000000004D", "7D"), ("cast(4e-10 as float)", "cast(0 as float)")):
        here = rows.selectExpr(f"{value} as v")
        assert not reconcile(here, rows.selectExpr(f"{other} as v"), fine).first().sums_passed
        assert reconcile(here, dealt.selectExpr(f"{value} as v"), fine).first().overall_passed


def test_reconcile_reads_every_column(spark):
    """Texts, times, bytes and nested values count, in any order of rows, and a null is not another place's null."""
    a = spark.sql("""select id as k, cast(id as string) as t, timestamp_ntz '2024-01-01' as w, array(id) as l,
                       if(id % 2 = 0, null, 'x') as p, if(id % 2 = 0, 'x', null) as q from range(100)""")
    same = a.orderBy(F.desc("k")).toDF(*[c.upper() for c in a.columns])
    found = reconcile(a, same).first()
    assert found.overall_passed and found.content_columns == 5
    for change in ({"t": F.expr("if(k = 3, 'x', t)")}, {"w": F.expr("if(k = 7, null, w)")}, {"l": F.expr("array(k + 1)")}, {"p": F.col("q"), "q": F.col("p")}):
        found = reconcile(a, a.withColumns(change)).first()
        assert found.sums_passed and found.row_count_match and not found.content_match and not found.overall_passed
    swapped = a.withColumn("t", F.expr("case k when 3 then '4' when 4 then '3' else t end"))
    assert not reconcile(a, swapped).first().content_match
    twice = a.where("k <> 5").union(a.where("k = 6"))
    assert not reconcile(a, twice).first().content_match
    assert reconcile(a.select("t"), a.select("t")).first().overall_passed is None
    with pytest.raises(ValueError, match="target lacks the columns"):
        reconcile(a, a.drop("t"))


def test_equal_values_without_a_sum_pass(spark):
    odd = spark.sql("select explode(array(double('NaN'), double('Infinity'), -double('Infinity'), 1e300D, 1D)) as v")
    assert reconcile(odd, odd, unsummed=True).first().overall_passed and not reconcile(odd, odd).first().overall_passed
    for other in ("if(v = double('Infinity'), -v, v)", "if(isnan(v), 1e300D, v)", "if(v = 1e300D, 2e300D, v)"):
        assert not reconcile(odd, odd.selectExpr(f"{other} as v"), unsummed=True).first().sums_passed


def test_buckets_with_changes(spark):
    a = spark.range(1000).selectExpr("id as k", "cast(id as string) as t", "id % 3 as n")
    b = a.selectExpr("cast(k as int) as k", "if(k = 17, 'other', t) as t", "n").where("k <> 40").union(spark.sql("select 63, '63', 0"))
    found = {r.bucket: (r.source_rows, r.target_rows) for r in changed_buckets(a, b, ["k"], bucket="k % 23").collect()}
    assert found == {17: (43, 43)}  # 17 changed, 40 was lost and 63 came twice
    assert changed_buckets(a, a, ["k"]).isEmpty()
    assert [r.source_rows for r in changed_buckets(a, a.withColumn("n", F.col("n") + F.when(F.col("k") == 5, 1).otherwise(0)), ["k"], ["n"]).collect()] != []


def test_reconcile_finds_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert reconcile(a, a.toDF("K", "V")).first().overall_passed
    assert not reconcile(a, a.withColumn("v", F.col("v") + 0.01)).first().sums_passed
    assert reconcile(a, a.withColumn("v", F.col("v") + 0.001)).first().sums_passed
    assert not reconcile(a, a.limit(1)).first().row_count_match
    # a value that cannot be summed is a difference, not a zero
    assert not reconcile(a, a.withColumn("v", F.when(F.col("k") == 1, float("inf")).otherwise(F.col("v") + 1))).first().sums_passed
    with pytest.raises(ValueError):
        reconcile(a, a.drop("v"))


def test_nothing_to_sum_is_no_verdict(spark):
    a = spark.createDataFrame([("x",)], "t string")
    verdict = reconcile(a, a).first()
    assert verdict.checked_columns == 0 and verdict.row_count_match and verdict.overall_passed is None


# -- streams ---------------------------------------------------------------------------------


def test_stream_takes_each_file_once_and_replays_change_nothing(spark, target):
    source, checkpoint = new_folder(spark, "in"), new_folder(spark, "cp")
    table = VersionedTable(spark, new_folder(spark, "out"), keys=["K"], buckets=2)
    schema = spark.createDataFrame([], "k int, w int").schema
    seen = []
    for batch in ([(1, 1), (1, 2)], [(1, 3), (2, 1)], []):
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(f"{source}/{len(seen)}")
        incremental_stream(spark, source, schema, table, "w", checkpoint).awaitTermination()
        seen.append(table.version)
    assert seen == [1, 2, 2] and rows(table.read()) == [(1, 3), (2, 1)]
    assert table.state[f"batch:{checkpoint}"] == "1"
    # a batch that is delivered again, as after a crash, is recognised by its number
    replay = new_folder(spark, "cp")
    table.set_state({f"batch:{replay}": "5"})
    incremental_stream(spark, source, schema, table, "w", replay).awaitTermination()
    assert rows(table.read()) == [(1, 3), (2, 1)]


def test_stream_knows_late_rows_from_its_state(spark, target):
    """Also against rows that were loaded before the stream began; no batch reads the target to find out."""
    source, checkpoint = new_folder(spark, "arrivals"), new_folder(spark, "checkpoint")
    schema = "k int, w int, v string"
    table = VersionedTable(spark, target.path, keys=["K"], buckets=4)
    loads.full_load(spark.createDataFrame([(1, 5, "loaded"), (2, 5, "loaded"), (3, None, "loaded")], schema), table)
    arrivals = [
        [(1, 4, "late"), (2, 6, "newer"), (3, 1, "first mark"), (4, 1, "new")],
        [(2, 5, "late"), (4, None, "no mark"), (1, 5, "equal")],
        [(4, 2, "newer"), (1, 5, "equal again")],
    ]
    for i, batch in enumerate(arrivals):
        df = spark.createDataFrame(batch, schema)
        df.write.parquet(f"{source}/{i}")
        incremental_stream(spark, source, df.schema, table, "w", checkpoint).awaitTermination()
    assert rows(table.read()) == [(1, 5, "equal again"), (2, 6, "newer"), (3, 1, "first mark"), (4, 2, "newer")]


def test_stream_without_keys_appends(spark):
    source, checkpoint = new_folder(spark, "in"), new_folder(spark, "cp")
    table = VersionedTable(spark, new_folder(spark, "out"))
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, w int")
    for i in range(2):
        df.write.parquet(f"{source}/{i}")
        incremental_stream(spark, source, df.schema, table, "w", checkpoint).awaitTermination()
    assert table.read().count() == 4


def test_change_stream_in_small_batches(spark, target):
    source, checkpoint = new_folder(spark, "in"), new_folder(spark, "cp")
    changes = [(1, "a", 2, 1, 1), (1, "b", 4, 2, 1), (2, "c", 2, 3, 1), (2, None, 1, 4, 1)]
    df = feed(spark, *changes)
    for i, change in enumerate(reversed(changes)):
        feed(spark, change).coalesce(1).write.parquet(f"{source}/{i}")
    cdc_stream(spark, source, df.schema, target, checkpoint, files_per_batch=1).awaitTermination()
    assert rows(cdc.current_rows(target)) == [(1, "b")]
    assert target.version >= 4
