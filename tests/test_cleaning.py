import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrywell.functions import errors, text
from ferrywell.operators import cleaning


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_trim_removes_every_kind_of_whitespace(spark):
    samples = [" a b　", "\t x\r\n", "\x1cy\x85", "plain", "  ", "z​"]
    df = spark.createDataFrame([(s,) for s in samples], "c string")
    assert rows(cleaning.trim_cells(df)) == sorted([(s.strip(),) for s in samples], key=repr)


@pytest.mark.parametrize(
    "value,number",
    [("1", 1.0), ("-1.5", -1.5), ("+.5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("2E-2", 0.02)]
    + [(v, None) for v in ("1d", "1_000", "inf", "nan", "0x10", "1,5", "", "-", ".", "1e", "12\n", "a1", "1 ")],
)
def test_numbers_are_plainly_written(spark, value, number):
    df = spark.createDataFrame([(value,)], "c string")
    row = df.select(text.parsed_number(F.col("c")), F.expr(text.looks_numeric_sql("c")), text.looks_numeric(F.col("c"))).first()
    assert row[0] == number
    assert bool(row[1]) == bool(row[2]) == (number is not None)


def test_tokens_of_both_profiles(spark):
    values = ["NA", "na", "nUlL", " none ", "#N/A", "NaN", "nan", "-", "", "undefined", "Nil", "kept", "n/a"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    left = lambda profile: {r.c for r in cleaning.null_tokens(df, profile).collect() if r.c is not None}
    assert left("strict") == {"#N/A", "kept"}
    assert left("basic") == {"na", "nUlL", " none ", "nan", "Nil", "kept", "n/a"}
    with pytest.raises(ValueError):
        cleaning.null_tokens(df, "other")


def test_headers_and_odd_column_names(spark):
    df = spark.createDataFrame([(" a ", "b")], "` x.y ` string, `p``q` string")
    assert cleaning.trim_headers(df).columns == ["x.y", "p`q"]
    result = cleaning.clean_strict(df)
    assert result.cleaned.columns == ["x.y", "p`q"] and result.cleaned.first()[:] == ("a", "b")


def test_ratio_is_taken_of_the_present_values(spark):
    values = [("1",)] * 17 + [("x",)] * 3 + [(None,)] * 50
    df = spark.createDataFrame(values, "c string")
    assert dict(cleaning.coerce_numeric(df).dtypes) == {"c": "double"}
    assert cleaning.coerce_numeric(df).where("c is not null").count() == 17
    assert dict(cleaning.coerce_numeric(df, 0.86).dtypes) == {"c": "string"}


def test_copies_of_a_hot_group_are_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "EXPAND_CHUNK", 7)
    df = spark.range(1000).selectExpr("case when id < 400 then 1 else id end as k", "cast(null as string) as t")
    surplus = cleaning.duplicates_removed(df)
    assert surplus.count() == 399 and surplus.distinct().collect()[0][:] == (1, None)
    plan = surplus._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_expansion_never_builds_an_array_of_the_group(spark):
    # one row stands for more copies than an array can hold; only the chunks are counted
    grouped = spark.range(1).selectExpr("1 as k", "300000000000 as __copies")
    plan = cleaning.expand_copies(grouped, F.col("__copies"))
    chunks = spark.range(1).select(F.floor((F.lit(300_000_000_000) - 1) / cleaning.EXPAND_CHUNK)).first()[0]
    assert plan.columns == ["k"] and chunks < 2**31 - 16


def test_cleaning_equals_brute_force(spark):
    data = pd.DataFrame(
        {
            "a": [" 1", "2", "2 ", "NULL", "", "7", "8", "9", "10", "11", "12", "13", "14", "x"],
            "b": ["u", "v", "v", " - ", "na", "w", "w", "w", "w", "w", "w", "w", "w", "w"],
            "n": [1.0, 2.0, 2.0, None, None, 3, 3, 3, 3, 3, 3, 3, 3, 1e6],
        }
    )
    # 30 more plain rows, so that one value can be far from the rest
    more = pd.DataFrame({"a": [str(100 + i) for i in range(30)], "b": ["w"] * 30, "n": [3.0] * 30})
    data = pd.concat([data, more], ignore_index=True)
    frame = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a string, b string, n double")
    result = cleaning.clean_strict(frame)

    expected = data.copy()
    for c in "ab":
        expected[c] = expected[c].str.strip()
        expected.loc[expected[c].str.lower().isin(text.STRICT_NULLS), c] = None
    empty = expected.isna().all(axis=1)
    filled = expected[~empty]
    unique = filled.drop_duplicates()
    numbers = pd.to_numeric(unique.a, errors="coerce")
    assert numbers.notna().sum() / unique.a.notna().sum() >= 0.85
    matrix = pd.DataFrame({"a": numbers, "n": unique.n})
    far = ((matrix - matrix.mean()) / (matrix.std(ddof=0) + 1e-9)).abs().gt(5).any(axis=1)
    kept = pd.DataFrame({"a": numbers, "b": unique.b, "n": unique.n})[~far]
    assert far.sum() == 1
    plain = lambda v: None if pd.isna(v) else v
    assert rows(result.cleaned) == sorted([tuple(plain(v) for v in r) for r in kept.itertuples(index=False)], key=repr)
    reasons = {r.reason: r["count"] for r in result.quarantine.groupBy("reason").count().collect()}
    assert reasons == {cleaning.EMPTY: empty.sum(), cleaning.DUPLICATE: len(filled) - len(unique), cleaning.OUTLIER: 1}
    report = {(r.step, r.column): r.rows for r in result.report.collect()}
    assert report["rows in", None] == 44 and report["rows out", None] == len(kept)
    assert report["trimmed", "a"] == 2 and report["null tokens", "b"] == 2
    assert report["values lost in coercion", "a"] == 1


def test_second_run_changes_nothing_but_statistics(spark):
    df = spark.createDataFrame([(" a", "1"), ("a", "1"), ("b", "2"), ("-", "")], "t string, n string")
    once = cleaning.clean_strict(df).cleaned
    again = cleaning.clean_strict(once).cleaned
    assert once.dtypes == again.dtypes and rows(once) == rows(again)


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, None), (float("nan"), "x")], "v double, t string")
    assert cleaning.drop_empty_rows(df).count() == 2
    assert cleaning.zscore_outliers(df).count() == 3


def test_each_error_rule_is_reached_and_the_first_wins(spark):
    samples = {
        "No module named x": 1, "could not connect; timed out": 2, "getaddrinfo failed": 3, "Read TIMEOUT": 4,
        "password authentication failed": 5, "permission denied for table": 6, "bad certificate": 7,
        "database x does not exist": 8, "role x does not exist": 9, "ODBC Driver 17 not found": 10,
        "TNS:no listener": 11, "NoSuchBucket": 12, "SignatureVersion wrong": 13, "something else": None, None: None,
        "no such file": 8, "database is fine": None,
    }
    df = spark.createDataFrame(list(samples.items()), "message string, expected int")
    found = df.select("message", "expected", errors.rule_number(F.col("message")).alias("rule"))
    assert [r for r in found.collect() if r.rule != r.expected] == []
    causes = found.select("rule", errors.cause_of(F.col("rule")).alias("cause")).where("rule is null and cause is not null")
    assert causes.count() == 0


@pytest.mark.parametrize(
    "filename,expected",
    [("My-File v1.2.csv", "my_file_v1_2"), ("2024.csv", "t_2024"), ("###.csv", "t_"), ("noext", "noext"), ("Ä b.json", "_b")],
)
def test_table_names(spark, filename, expected):
    assert text.table_name_of(filename) == expected
    df = spark.createDataFrame([(filename,)], "f string")
    assert df.select(text.table_name(F.col("f"))).first()[0] == expected
