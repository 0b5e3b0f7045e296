"""File readers: delimited text, JSON records, Parquet, XML, object listings, views."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.functions import text
from ferrywell.operators.cleaning import column
from ferrywell.session import Staged

SNIFF_BYTES = 4096
#: Signs that a reader would take for a pattern of names.
GLOB = re.compile(r"([\\\[\]{}*?,])")


def list_objects(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Inventory of the objects below a path; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return found.orderBy("path").limit(limit) if limit else found


def detect_delimiters(files: DataFrame, candidates: str = ",;\t|", sniff_bytes: int = SNIFF_BYTES) -> DataFrame:
    """(path, delimiter, header) per file, from its first bytes and its first record. Tasks open the files, not the driver.

    They do so with Arrow, which knows local, HDFS, S3 and GCS paths.
    """

    # refers to nothing outside itself, so executors need not have this package
    def sniff(batches):
        import csv
        import io
        from urllib.parse import quote

        import pandas as pd
        from pyarrow import fs

        def record(head, stream, delimiter):
            # the first record may be longer than the part that was looked at
            while True:
                row = next(csv.reader(io.StringIO(head.decode("utf-8", errors="replace"), newline=""), delimiter=delimiter), [])
                more = stream.read(len(head) or 1)
                if not more or head.count(b"\n") > sum(cell.count("\n") for cell in row):
                    return [name.removeprefix("\ufeff") if i == 0 else name for i, name in enumerate(row)]
                head += more

        for batch in batches:
            found, headers = [], []
            for path in batch["path"]:
                # Spark says s3a, Arrow says s3; Spark's path is not encoded, Arrow's is
                system, plain = fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@"))
                with system.open_input_stream(plain) as stream:
                    head = stream.read(sniff_bytes)
                    try:
                        found.append(csv.Sniffer().sniff(head.decode("utf-8", errors="replace"), delimiters=candidates).delimiter)
                    except csv.Error:
                        found.append(",")
                    headers.append(record(head, stream, found[-1]))
            yield pd.DataFrame({"path": batch["path"], "delimiter": found, "header": headers})

    return files.select("path").mapInPandas(sniff, "path string, delimiter string, header array<string>")


def read_delimited(
    spark: SparkSession,
    path: str,
    candidates: str = ",;\t|",
    schema: T.StructType | str | None = None,
    infer: bool = False,
    line_breaks: bool = True,
) -> DataFrame:
    """Delimited files with a header, each with the delimiter its beginning suggests.

    Files with the same delimiter and header are read together, each file once, and all are put together by
    column name. Without a schema all columns are text; ``infer`` costs another pass over the files. A
    cell may hold line breaks, so a file is read by one task; say ``line_breaks=False`` where none
    does, and large files are split.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    files = Staged(detect_delimiters(listed, candidates), "delimited").df
    # as many as there are kinds of files; where there are several, with their paths, which Spark's list of files holds anyway
    kinds = [(*kind, ()) for kind in files.select("delimiter", "header").distinct().orderBy("delimiter", "header").collect()]
    if not kinds:
        raise FileNotFoundError(path)
    if len(kinds) > 1:
        kinds = files.groupBy("delimiter", "header").agg(F.sort_array(F.collect_list("path"))).orderBy("delimiter", "header").collect()
    wanted = None if schema is None else T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    known = {f.name: f for f in wanted} if wanted else {}
    parts = []
    for delimiter, header, paths in kinds:
        names = _unique(header)
        fields = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
        reader = spark.read.options(**text.CSV_READ, multiLine=line_breaks, recursiveFileLookup=True).option("sep", delimiter)
        if len(kinds) == 1:
            part = (reader.option("inferSchema", True) if infer and wanted is None else reader.schema(fields)).csv(path)
        else:
            part = reader.schema(fields).csv([GLOB.sub(r"\\\1", one) for one in paths])
            if infer and wanted is None:
                part = _inferred(part)
        parts.append(part if wanted is None else part.select(*[column(f.name) for f in wanted if f.name in part.columns]))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if wanted is not None:
        missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in found.columns}
        found = found.withColumns(missing).select(*[column(f.name) for f in wanted])
    return found


def _unique(header: list[str]) -> list[str]:
    """Column names of a header; a name that is empty or repeated gets its place, as Spark's reader does."""
    low = [name.lower() for name in header]
    return [f"_c{i}" if not name else f"{name}{i}" if low.count(name.lower()) > 1 else name for i, name in enumerate(header)]


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers or numbers where all their values are such."""
    names = df.columns
    tests = [F.every(F.coalesce(column(c).try_cast(kind).isNotNull() | column(c).isNull(), F.lit(True))).alias(f"{kind}{i}")
             for i, c in enumerate(names) for kind in ("bigint", "double")]
    row = df.agg(*tests).first()
    return df.withColumns({c: column(c).cast(kind) for i, c in enumerate(names)
                           for kind in [next((k for k in ("bigint", "double") if row[f"{k}{i}"]), "string")]})


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested objects become columns named parent, separator, child."""

    def leaves(fields, ref, names):
        for f in fields:
            here, parts = ref[f.name] if ref is not None else column(f.name), [*names, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, here, parts)
            else:
                yield here.alias(sep.join(parts))

    return df.select(*leaves(df.schema.fields, None, []))


def read_json_records(spark: SparkSession, path: str, sep: str = "_", lines: bool = False) -> DataFrame:
    """JSON documents as rows, nested objects flattened.

    A top-level list gives one row per element. An object gives the elements of its first
    list-valued member, or else one row. A document is a file, or a line with ``lines=True``;
    it is parsed by one task, so large data should come as lines, which split.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    schema = reader.option("multiLine", not lines).json(path).schema
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return flatten(reader.schema(schema).option("multiLine", not lines).json(path), sep)

    # Which member holds the rows depends on the order in the document, which the schema loses.
    text_rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines)
    documents = text_rows.select(text.stripped(F.col("value")).alias("document")).where("document <> ''")
    is_list = F.col("document").startswith("[")
    strict = {"mode": "FAILFAST"}
    items = documents.select(
        F.when(~is_list, F.json_object_keys("document")).alias("keys"),
        F.explode(
            F.when(is_list, F.from_json("document", T.ArrayType(schema), strict)).otherwise(
                F.array(F.from_json("document", schema, strict))
            )
        ).alias("item"),
    )
    present = F.array_compact(F.array(*[F.when(F.col("item")[c].isNotNull(), F.lit(c)) for c in lists]))
    first = F.get(F.filter("keys", lambda k: F.array_contains(present, k)), F.lit(0))
    # parsed once and written; the members' rows below are then read column by column
    items = Staged(items.select("item", first.alias("member")), "json-items").df
    parts = []
    for (member,) in items.select("member").distinct().orderBy("member").collect():
        if member is None:
            parts.append(flatten(items.where("member is null").select("item.*"), sep))
            continue
        rows = items.where(F.col("member") == member).select(F.explode(F.col("item")[member]).alias("value"))
        is_object = isinstance(schema[member].dataType.elementType, T.StructType)
        parts.append(flatten(rows.select("value.*") if is_object else rows, sep))
    if not parts:
        return spark.createDataFrame([], flatten(spark.createDataFrame([], schema), sep).schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Each element named ``row_tag`` is a row. A file is read by one task; ``export_xml`` writes files of a bounded size."""
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).xml(path)


def register_view(df: DataFrame, filename: str) -> str:
    """Make a file's rows queryable under its normalised name, for the whole session."""
    name = text.table_name_of(filename)
    df.createOrReplaceTempView(name)
    return name
