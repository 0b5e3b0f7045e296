import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrywell.functions.names import sap_names
from ferrywell.functions.types import map_types, spark_type, type_rows
from ferrywell.operators import contracts, metadata, profile
from ferrywell.operators.contracts import Field
from ferrywell.session import new_folder
from ferrywell.sinks.tables import clustered_write, files_met, pick_cluster_keys


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    "dialect,source,length,precision,scale,expected",
    [
        ("sqlserver", "nvarchar", 50, None, None, "VARCHAR(50)"),
        ("sqlserver", "varchar", None, None, None, "VARCHAR"),
        ("sqlserver", "money", None, None, None, "NUMBER(19,4)"),
        ("mssql", "bit", None, None, None, "BOOLEAN"),
        ("postgresql", "numeric", None, 45, 3, "NUMBER(38,3)"),
        ("postgresql", "DECIMAL(10)", None, None, None, "NUMBER(10,0)"),
        ("postgresql", "numeric", None, None, None, "NUMBER"),
        ("postgres", "timestamp with time zone", None, None, None, "TIMESTAMP_TZ"),
        ("redshift", "double precision", None, None, None, "FLOAT"),
        ("mysql", "mediumtext", None, None, None, "VARCHAR(16777215)"),
        ("mysql", "varchar", 20_000_000, None, None, "VARCHAR(16777216)"),
        ("MariaDB", "decimal(12,2)", None, None, None, "NUMBER(12,2)"),
        ("oracle", "DATE", None, None, None, "TIMESTAMP_NTZ"),
        ("oracle", "number", None, 10, -2, "NUMBER(10,0)"),
        ("oracle", "integer", None, None, None, "NUMBER(38,0)"),
        ("sap_hana", "st_point", None, None, None, "VARIANT"),
        ("sap_bw", "seconddate", None, None, None, "TIMESTAMP_NTZ"),
        ("abap", "CURR", 13, None, 0, "NUMBER(13,2)"),
        ("abap", "DEC", None, None, None, "NUMBER(15,0)"),
        ("abap", "DEC", 5, None, 9, "NUMBER(5,5)"),
        ("abap", "CHAR", None, None, None, "VARCHAR(1)"),
        ("abap", "NUMC", 10, None, None, "VARCHAR(10)"),
        ("abap", "ACCP", None, None, None, "VARCHAR(6)"),
        ("abap", "ZZZZ", None, None, None, "VARCHAR(255)"),
        ("mysql", "zzzz", None, None, None, "VARIANT"),
        ("db2", "integer", None, None, None, "VARIANT"),
    ],
)
def test_type_rules(spark, dialect, source, length, precision, scale, expected):
    df = spark.createDataFrame(
        [(dialect, source, length, precision, scale)],
        "dialect string, source_type string, length int, precision int, scale int",
    )
    assert map_types(df).first().target_type == expected


def test_every_target_type_has_a_spark_type():
    for _, _, target in type_rows():
        spark_type(target.replace(" SIZED", "").replace("AMOUNT", "NUMBER"))
    assert len({(d, b) for d, b, _ in type_rows()}) == len(type_rows())


def test_conform_and_its_violations(spark):
    df = spark.createDataFrame(
        [("1", "12.345", "abc", "2024-02-30"), ("1d", "99999", "abcdef", "2024-02-28"), (None, None, None, None)],
        "a string, b string, c string, d string",
    )
    contract = [Field("a", "NUMBER(10,0)"), Field("b", "NUMBER(5,2)"), Field("c", "VARCHAR(4)"), Field("d", "DATE")]
    out = contracts.conform(df, contract)
    assert [t for _, t in out.dtypes] == ["decimal(10,0)", "decimal(5,2)", "string", "date"]
    assert out.where("b is not null").first().b == Decimal("12.35")
    found = {r.column_name: r[2:] for r in contracts.conform_violations(df, contract).collect()}
    assert found == {"a": (1, 0, 0, 0), "b": (0, 1, 0, 1), "c": (0, 0, 1, 0), "d": (1, 0, 0, 0)}


def test_contract_check(spark):
    df = spark.createDataFrame([(1, "abc"), (1, None), (2, "a")], "k int, t string")
    contract = [Field("k", "NUMBER(10,0)", False, True), Field("t", "VARCHAR(2)", False)]
    assert rows(contracts.check_contract(df, contract)) == [
        ("k", "PRIMARY KEY", 2), ("t", "NOT NULL", 1), ("t", "VARCHAR(2)", 1),
    ]
    kept = contracts.contract_table(spark, "x", contract)
    assert contracts.contract_from(kept, "x") == contract
    with pytest.raises(ValueError):
        contracts.contract_pk(df, [Field("k", "NUMBER")])


def test_standard_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`abc` int, `a b` int, `VBAK` int")
    assert contracts.standard_names(df, {"VBAK": "SALES_ORDER_HEADER"}).columns == ["ABC", '"a b"', "SALES_ORDER_HEADER"]
    names = spark.createDataFrame([("T001",), ("x-y",)], "name string")
    out = contracts.business_names(names, "name", sap_names(spark))
    assert dict(map(tuple, out.collect())) == {"T001": "COMPANY_CODES", "x-y": '"x-y"'}
    assert sap_names(spark).count() == 86


@pytest.mark.parametrize(
    "arguments,expected",
    [
        (dict(dialect="postgresql", primary_key=["id"]), ["at", "day"]),
        (dict(dialect="mysql", primary_key=["a", "b", "c", "d"]), ["a", "b", "c"]),
        (dict(dialect="oracle", primary_key=["id"], unique_index=["u"]), ["u"]),
        (dict(dialect="oracle"), ["at", "day"]),
        (dict(dialect="mssql", primary_key=["id"], clustered_index=["c"]), ["c"]),
        (dict(dialect="sqlserver", primary_key=["id"]), ["id"]),
        (dict(dialect="erp", primary_key=["id"]), ["at", "day"]),
        (dict(dialect="other"), []),
    ],
)
def test_cluster_keys(arguments, expected):
    types = {"id": "bigint", "at": "TIMESTAMP_NTZ", "day": "DATE"}
    assert pick_cluster_keys(types=types, **arguments) == expected


def test_clustered_files_have_narrow_ranges_and_split_a_hot_key(spark):
    df = spark.range(30_000, numPartitions=12).selectExpr("case when id % 3 = 0 then 500 else id % 1000 end as k", "id as v")
    path = new_folder(spark, "clustered")
    clustered_write(df, path, ["k"], partitions=10)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("z"), F.count("*").alias("n")).collect()
    assert sum(f.n for f in files) == 30_000 and max(f.n for f in files) < 8_000
    assert sum(f.a <= 500 <= f.z for f in files) > 1
    spans = sorted((f.a, f.z) for f in files)
    assert all(left[1] <= right[0] for left, right in zip(spans, spans[1:]))


def test_watermark_scores(spark):
    df = spark.sql(
        "select current_date() as day, 'x' as last_name, 1 as modified_flag, timestamp_ntz '2024-01-01' as created_updated, "
        "1 as plain, 2 as date_text, 'd' as inserted, 1 as added, 1 as last_one"
    )
    found = [(r.rank, r.column_name, r.score) for r in profile.watermark_candidates(df).collect()]
    assert found == [(1, "created_updated", 17), (2, "day", 10), (3, "last_name", 5), (4, "modified_flag", 5), (5, "last_one", 5)]
    assert profile.watermark_candidates(df.select("plain")).count() == 0


def test_detected_types(spark):
    df = spark.createDataFrame(
        [("2024-01-01T10:00", "01/02/2024", "yes", "1", "0", "a", None)] * 17 + [("x", "x", "x", "x", "1", "1", None)] * 3,
        "dt string, d string, b string, n string, z string, s string, e string",
    )
    found = {r.column_name: r.detected_type for r in profile.profile_columns(df, exact=True).collect()}
    assert found == {"dt": "datetime", "d": "date", "b": "boolean", "n": "number", "z": "number", "s": "string", "e": "string"}
    estimated = profile.profile_columns(df)
    assert {r.column_name: r.distinct_values for r in estimated.collect()}["dt"] == 2


def test_key_candidates(spark):
    df = spark.range(2000).selectExpr("id", "id % 1999 as nearly", "nullif(id, 5) as holey", "id % 40 as a", "id div 40 as b")
    found = {r.key_columns: r.is_key for r in profile.key_candidates(df, [["a", "b"], ["a", "nearly"]]).collect()}
    assert found == {"id": True, "nearly": False, "holey": False, "a": False, "b": False, "a, b": True, "a, nearly": True}


@pytest.mark.parametrize("seed", range(4))
def test_smallest_keys_equal_brute_force(spark, seed):
    pick = random.Random(seed)
    data = [(i, pick.randrange(60), pick.randrange(60), i % 30, i // 30, None if i == 7 else i) for i in range(300)]
    df = spark.createDataFrame(data, "id int, a int, b int, c int, d int, holey int").drop(*([] if seed % 2 else ["id"]))
    names = [c for c in df.columns if c != "holey"]
    place = {c: i for i, c in enumerate(["id", "a", "b", "c", "d"])}
    keys = []
    for size in (1, 2, 3):
        for chosen in itertools.combinations(names, size):
            unique = len({tuple(row[place[c]] for c in chosen) for row in data}) == len(data)
            if unique and not any(set(k) < set(chosen) for k in keys):
                keys.append(chosen)
    found = profile.key_lattice(df).collect()
    assert sorted(r.key_columns for r in found) == sorted(", ".join(k) for k in keys)


def test_one_scan_serves_all_candidates(spark, monkeypatch):
    """A level of the lattice is one plan with one scan and one shuffle by tuples, however many candidates it has."""
    scans = []
    real = profile._repeats
    monkeypatch.setattr(profile, "_repeats", lambda df, candidates, *rest: scans.append(len(candidates)) or real(df, candidates, *rest))
    df = spark.range(500).selectExpr("id % 7 as a", "id % 11 as b", "id % 13 as c", "id % 5 as d", "id % 3 as e")
    assert profile.key_lattice(df).select("key_columns").collect() != []
    assert len(scans) <= 4 and sum(scans) > len(scans)
    assert profile.key_lattice(df.limit(0)).isEmpty()


def test_large_key_search_deals_rows_out_once(spark, monkeypatch):
    """All rows go by a shared column, those of a frequent value by their tuples; few tuples are probed before."""
    full = []
    real = profile._repeats
    monkeypatch.setattr(profile, "_repeats", lambda df, c, *rest: full.append((df.count(), len(c), *rest[:1])) or real(df, c, *rest))
    for name, value in {"TESTED_TUPLES": 500, "FEW": 40, "LARGE_SHARE": 10, "PROBED_FIRST": 16, "PROBED": 4}.items():
        monkeypatch.setattr(profile, name, value)
    # half of the rows share a value of a, the column with the most values
    df = spark.range(4000).selectExpr(
        "if(id < 2000, -1, id) as a", "id % 2000 as b", "id % 1999 as c", "id % 30 as d", "if(id = 3, 5, id % 50) as e")
    data = [tuple(r) for r in df.collect()]
    keys = []
    for size in (1, 2, 3):
        for chosen in itertools.combinations(range(5), size):
            if len({tuple(r[i] for i in chosen) for r in data}) == len(data) and not any(set(k) < set(chosen) for k in keys):
                keys.append(chosen)
    found = profile.key_lattice(df).collect()
    assert sorted(r.key_columns for r in found) == sorted(", ".join("abcde"[i] for i in k) for k in keys) and keys
    # with all rows only the columns of few values and a probe, the frequent value's rows apart
    assert all(n < 4000 or rest == [16] or tested <= 2 for n, tested, *rest in full) and any(n == 2000 for n, *_ in full)
    assert {r.key_columns: r.is_key for r in profile.key_candidates(df, [["a", "b"], ["b", "c"], ["a", "c"]]).collect()} == {
        **dict.fromkeys("abcde", False), "a, b": True, "b, c": True, "a, c": len({(r[0], r[2]) for r in data}) == 4000}


def test_contract_ledger(spark):
    """Masks give the counts of the separate checks; rows are kept or set aside, never both; more rules than one word holds."""
    df = spark.createDataFrame(
        [(1, "a", "10"), (1, "bb", "x"), (2, None, "1000"), (None, "c", None), (None, "d", "5"), (3, "e", "7")], "k int, t string, n string")
    contract = [Field("k", "INT", False, True), Field("t", "VARCHAR(1)", False), Field("n", "NUMBER(3,0)")]
    ledger = contracts.ContractLedger(df, contract)
    assert rows(ledger.kept()) == [(3, "e", "7")]
    found = {(r.k, r.t): (r.broken[0], r.reason) for r in ledger.quarantine().collect()}
    assert found == {
        (1, "a"): (16, "k: PRIMARY KEY"), (1, "bb"): (16 + 8 + 4, "t: VARCHAR(1); n: NUMBER(3,0); k: PRIMARY KEY"),
        (2, None): (2 + 8, "t: NOT NULL; n: NUMBER(3,0)"), (None, "c"): (1 + 16, "k: NOT NULL; k: PRIMARY KEY"),
        (None, "d"): (1 + 16, "k: NOT NULL; k: PRIMARY KEY")}
    assert rows(ledger.counts().where("violations > 0")) == rows(contracts.check_contract(df, contract))
    wide = spark.range(4).selectExpr(*[f"if(id = {i % 4}, null, id) as c{i}" for i in range(130)])
    counts = contracts.ContractLedger(wide, [Field(c, "INT", False) for c in wide.columns]).counts().collect()
    assert len(counts) == 130 and all(r.violations == 1 for r in counts)
    nothing = contracts.ContractLedger(df, [Field("t", "TEXT")])
    assert nothing.kept().count() == 6 and nothing.quarantine().isEmpty() and nothing.counts().isEmpty()


def test_the_curve_skips_files_by_every_key(spark):
    df = spark.range(40_000).selectExpr(
        "id", "(id * 7919) % 40009 as a", "cast((id * 104729) % 40009 as string) as b", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 31 % 997) as t",
        "cast(null as int) as nothing")
    met = {}
    for curve in (False, True):
        path = new_folder(spark, "curve")
        clustered_write(df, path, ["a", "b", "t", "nothing"], 64, curve)
        laid = spark.read.parquet(path)
        assert laid.exceptAll(df).isEmpty() and laid.count() == 40_000 and laid.columns == df.columns
        files = laid.groupBy("_metadata.file_path").agg(*[F.expr(f"{m}({c}) as {m}_{c}") for c in "abt" for m in ("min", "max")]).collect()
        for c in "abt":
            probes = [r[c] for r in df.orderBy(c).select(c).collect()[2_000::4_000]]
            met[curve, c] = sum(f[f"min_{c}"] <= v <= f[f"max_{c}"] for v in probes for f in files) / len(probes) / len(files)
        assert files_met(laid, "b", "25", "25").first().met == sum(f["min_b"] <= "25" <= f["max_b"] for f in files)
    assert met[False, "a"] < 0.1 and met[False, "b"] > 0.9 and met[False, "t"] > 0.9
    assert all(met[True, c] < 0.6 for c in "abt"), met


def test_quality(spark):
    df = spark.createDataFrame([("a", 1), ("a ", 1), ("NULL", 2), ("", None)], "t string, n int")
    score = profile.quality_score(df).first()
    assert (score.rows, score.cells, score.null_cells, score.duplicate_rows) == (4, 8, 3, 1)
    assert float(score.score) == round(100 * (1 - 3 / 8) * (1 - 1 / 4), 2)
    issues = {(r.issue, r.column_name): (r.affected_rows, r.severity) for r in profile.quality_issues(df).collect()}
    assert issues == {("missing values", "t"): (2, "high"), ("missing values", "n"): (1, "high"), ("duplicate rows", None): (1, "high")}


def test_drift(spark):
    old = metadata.schema_snapshot(spark.range(3).selectExpr("id", "1 as gone", "'x' as kept"), "t", "2024-01-01 00:00:00")
    new = metadata.schema_snapshot(spark.range(5).selectExpr("cast(id as string) as id", "'x' as kept", "2 as added"), "t", "2024-01-02 00:00:00")
    assert rows(metadata.schema_drift(old, new)) == sorted(
        [("id", "retyped", "bigint", "string", None), ("gone", "removed", "int", None, None),
         ("added", "added", None, "int", None), (None, "row count", None, None, 2)], key=repr)
    assert metadata.schema_drift(old, old).count() == 0


def test_lineage_of_chain_diamond_and_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("p", "r"), ("q", "s"), ("r", "s"), ("x", "y"), ("y", "x")]
    found = rows(metadata.lineage_closure(spark.createDataFrame(edges, "source string, target string")))
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    assert found == sorted([(t, s) for s, t in reach], key=repr)


def test_lineage_through_hubs_and_layers(spark, monkeypatch):
    """A hub's pairs are split over tasks; layers of tables that feed nothing come back with all that is upstream."""
    for name, value in {"TASK_PAIRS": 100, "HUB_PAIRS": 20}.items():
        monkeypatch.setattr(metadata, name, value)
    edges = [("r", "hub"), ("hub", "v"), ("v", "hub"), ("w", "w")] + [("hub", f"c{i}") for i in range(90)]
    edges += [(f"c{i % 90}", f"o{i}") for i in range(400)] + [("r", "o1"), ("o1", "z"), ("c3", "o3")]
    up = {}
    for s, t in edges:
        up.setdefault(t, set()).add(s)

    def reach(t):
        seen, todo = set(), list(up[t])
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += up.get(s, ())
        return seen

    df = spark.createDataFrame(edges, "source string, target string")
    assert rows(metadata.lineage_closure(df)) == sorted([(t, s) for t in up for s in reach(t)], key=repr)
    star = df.where("source = 'hub'").selectExpr("target", "source as upstream")
    met = metadata._through(star, df.selectExpr("target", "source as upstream"), 500)
    assert max(r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()) < 2 * 91
    assert met.count() == 2 * 91 and metadata.lineage_closure(df.limit(0)).isEmpty()


def test_run_summary_and_short_runs(spark):
    df = spark.sql(
        """select 1 as pipeline_id, 1 as run_id, timestamp_ntz '2024-01-01' as started_at, 'success' as status, 50L as rows_loaded, 0L as elapsed_seconds
           union all select 2, 2, timestamp_ntz '2024-01-01', 'error', 10, 4 union all select 2, 3, timestamp_ntz '2024-01-02', 'success', 10, 4"""
    )
    found = {r.pipeline_id: (r.runs, r.errors, r.rows_per_second, r.last_run_id) for r in metadata.run_summary(df).collect()}
    assert found == {1: (1, 0, 500, 1), 2: (2, 1, 3, 3)}


def test_percentiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [("hot", int(v)) for v in rng.integers(-5000, 50_000, 4000)] + [("flat", 7)] * 500 + [("one", 123456)]
    df = spark.createDataFrame(data, "g string, v bigint")
    points = {"p50": 0.5, "p95": 0.95, "p999": 0.999}
    found = {r.g: (r.p50, r.p95, r.p999) for r in metadata.exact_percentiles(df, "g", "v", points).collect()}
    for group in ("hot", "flat", "one"):
        values = np.sort([v for g, v in data if g == group])
        assert found[group] == tuple(values[int(np.ceil(len(values) * round(p * 1000) / 1000)) - 1] for p in points.values())


def test_percentiles_of_one_group_with_all_rows(spark):
    """The group lies in several partitions, and no window or sort covers more than one of them."""
    df = spark.range(20_000).selectExpr("'all' as g", "(id * 7919) % 15013 as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        plan = metadata.exact_percentiles(df, "g", "v", {"p50": 0.5, "p99": 0.99})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = np.sort((np.arange(20_000) * 7919) % 15013)
    assert plan.first()[1:] == (values[9_999], values[19_799])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window" in line]
    assert windows and all("part#" in line for line in windows)
    folder = [line for line in plan.inputFiles() if "ranks-" in line]
    assert len(folder) > 1
