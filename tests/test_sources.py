import json
from pathlib import Path

import pytest

from ferrywell.functions import text
from ferrywell.session import new_folder
from ferrywell.sinks import tables
from ferrywell.sinks.tables import export, write_quarantine
from ferrywell.sources import files, jdbc


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(values):
    return sorted(values, key=repr)


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_each_file_is_read_once_whatever_its_name(spark, tmp_path):
    for i, (name, sep) in enumerate([("a[1].csv", ","), ("b{x,y} z.csv", ";"), ("c*?.csv", "|"), ("d%20.csv", ";"), ("sub/e.csv", ",")]):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"id{sep}v\n{i}{sep}x\n{i}{sep}y\n")
    found = files.read_delimited(spark, str(tmp_path))
    assert rows(found) == sorted((str(i), v) for i in range(5) for v in "xy")
    assert len(found.inputFiles()) == 5  # a file appears in no other kind's scan


def test_delimiter_of_each_file(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.csv", ";"), ("c.csv", "\t"), ("d.csv", "|")):
        write(tmp_path, name, "".join(sep.join(r) + "\n" for r in (["id", "name"], [name, "x y"], [name, "z"])))
    write(tmp_path, "e.csv", "id\nlonely\n")
    found = files.read_delimited(spark, str(tmp_path))
    assert rows(found.select("id", "name")) == sorted(
        [(n, v) for n in ("a.csv", "b.csv", "c.csv", "d.csv") for v in ("x y", "z")] + [("lonely", None)], key=repr
    )


def test_cells_as_people_write_them(spark, tmp_path):
    write(tmp_path, "My File (1).csv", 'id,name,extra\r\n1,"he said ""hi"", ok",\r\n2,"two\nlines", x \r\n')
    write(tmp_path, "b.csv", "name,id\nann,3\n")
    write(tmp_path, "ünï+100%.csv", 'id,name,extra\n4,"",z\n')
    found = files.read_delimited(spark, str(tmp_path)).select("id", "name", "extra")
    assert rows(found) == rows_of([("1", 'he said "hi", ok', None), ("2", "two\nlines", " x "), ("3", "ann", None), ("4", "", "z")])
    typed = files.read_delimited(spark, str(tmp_path), schema="name string, id int, more date")
    assert typed.dtypes == [("name", "string"), ("id", "int"), ("more", "date")] and rows(typed.select("id")) == rows_of([(1,), (2,), (3,), (4,)])
    assert files.read_delimited(spark, str(tmp_path), infer=True).dtypes[0] == ("id", "bigint")


def test_bad_bytes_are_replaced(spark, tmp_path):
    write(tmp_path, "a.csv", b"id;t\n1;caf\xe9\n2;ok\n")
    assert rows(files.read_delimited(spark, str(tmp_path))) == [("1", "caf�"), ("2", "ok")]


@pytest.mark.parametrize(
    "document,expected",
    [
        ([{"a": 1, "b": {"c": 2, "d": {"e": 3}}}, {"a": 4}], [{"a": 1, "b_c": 2, "b_d_e": 3}, {"a": 4, "b_c": None, "b_d_e": None}]),
        ({"a": 1, "b": {"c": "x"}}, [{"a": 1, "b_c": "x"}]),
        ({"meta": {"n": 2}, "zeta": [{"v": 1}, {"v": 2}], "alpha": [{"w": 9}]}, [{"v": 1}, {"v": 2}]),
        ({"zeta": [], "alpha": [{"w": 9}]}, []),
        ([{"a": 1, "l": [1, 2]}], [{"a": 1, "l": [1, 2]}]),
    ],
)
def test_json_shapes(spark, tmp_path, document, expected):
    path = write(tmp_path, "d.json", json.dumps(document, indent=1))
    found = files.read_json_records(spark, path)
    assert sorted((r.asDict() for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_json_member_is_chosen_per_document(spark, tmp_path):
    write(tmp_path, "a.json", '{"zeta": [{"v": 1}], "alpha": [{"v": 2}]}')
    write(tmp_path, "b.json", '{"alpha": [{"v": 3}], "zeta": [{"v": 4}]}')
    assert rows(files.read_json_records(spark, str(tmp_path))) == [(1,), (3,)]


def test_xml_rows(spark, tmp_path):
    path = write(tmp_path, "d.xml", "<all><row><id>1</id><t>a</t></row><row><id>2</id></row></all>")
    assert rows(files.read_xml(spark, path, "row")) == [(1, "a"), (2, None)]


def test_xml_of_one_task_is_read_by_several(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "XML_ROWS", 100)
    df = spark.range(950).selectExpr("id", "concat('<', id, '> & ') as t").coalesce(1)
    tables.export_xml(df, str(tmp_path / "x"), "row", "rows")
    read = files.read_xml(spark, str(tmp_path / "x"), "row", df.schema)
    assert read.groupBy("_metadata.file_path").count().where("count <= 100").count() == 10
    assert rows(read.select("id")) == rows(df.select("id"))


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    write(tmp_path, "a.bin", "12345")
    write(tmp_path, "deep/b.bin", "1")
    found = files.list_objects(spark, str(tmp_path))
    assert sorted(r.length for r in found.collect()) == [1, 5]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert files.list_objects(spark, str(tmp_path), limit=1).count() == 1


def test_export_keeps_nulls_and_refuses_other_formats(spark):
    df = spark.createDataFrame([(1, None), (2, "x,\"y\"")], "id int, t string")
    for fmt in ("csv", "json", "parquet"):
        path = new_folder(spark, fmt)
        export(df, path, fmt)
        reader = spark.read.schema(df.schema).options(**text.CSV_READ)
        assert rows(reader.format(fmt).load(path)) == rows(df)
    path = new_folder(spark, "json")
    export(df, path, "json")
    assert '{"id":1,"t":null}' in {r.value for r in spark.read.text(path).collect()}
    with pytest.raises(ValueError):
        export(df, new_folder(spark, "x"), "excel")


def test_quarantine_is_filed_by_reason(spark):
    path = new_folder(spark, "quarantine")
    write_quarantine(spark.createDataFrame([(1, "a"), (2, "b")], "id int, reason string"), path)
    assert sorted(p.name for p in Path(path.removeprefix("file:")).iterdir() if p.is_dir()) == ["reason=a", "reason=b"]


def test_views_outlive_the_reader(spark):
    name = files.register_view(spark.range(3), "Sales 2024-Q1.parquet")
    assert name == "sales_2024_q1" and spark.sql("select count(*) from sales_2024_q1").first()[0] == 3


def test_jdbc_options():
    # no database is started here; the reader itself is Spark's
    plain = jdbc.read_options("jdbc:x", "t")
    assert plain == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    ranged = jdbc.read_options("jdbc:x", "t", "id", 8, 1, 800, extra={"user": "u"})
    assert ranged["partitionColumn"] == "id" and ranged["numPartitions"] == "8"
    assert (ranged["lowerBound"], ranged["upperBound"], ranged["user"]) == ("1", "800", "u")
    assert "partitionColumn" not in jdbc.read_options("jdbc:x", "empty", "id", 8, None, None)


def test_key_ranges_follow_the_rows():
    # 300 keys in the first bin, a third of all rows in one bin, the rest spread thinly
    counts = [(0, 300), (40, 5000)] + [(b, 10) for b in range(41, 1000)]
    predicates = jdbc.balanced_predicates(counts, "id", 100, 7, 8)
    assert 1 < len(predicates) <= 8

    def holds(predicate, key):
        if key is None:
            return "is null" in predicate
        return eval(predicate.replace("id is null", "False"), {"id": key})

    for key in [None, -5, 99, *range(100, 100 + 7 * 1000), 10**9]:
        assert sum(holds(p, key) for p in predicates) == 1
    loads = [sum(n for b, n in counts if holds(p, 100 + 7 * b)) for p in predicates]
    total = sum(n for _, n in counts)
    assert sum(loads) == total and max(loads) <= 5000 + total / 8
    assert sorted(loads)[-2] <= 2 * total / 8
    assert jdbc.balanced_predicates([(0, 5)], "id", 0, 1, 8) == ["1 = 1"]
