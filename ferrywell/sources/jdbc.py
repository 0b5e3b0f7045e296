"""Reading a relational table over JDBC in parallel key ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_SIZE = 10_000


def read_options(
    url: str, table: str, key: str | None = None, partitions: int = 1, lower=None, upper=None,
    fetch_size: int = FETCH_SIZE, extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options; with a key and its bounds, one task per key range reads its own rows."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(extra or {})}
    if key is not None and partitions > 1 and lower is not None:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 1,
    lower=None, upper=None, fetch_size: int = FETCH_SIZE, extra: dict[str, str] | None = None,
) -> DataFrame:
    """The whole table; unlike paging by offset, no row is read twice or missed.

    Bounds that are not given are asked from the database, which answers with one row. Filters
    and column choices made on the result are pushed into the queries that run there.
    """
    if key is not None and partitions > 1 and lower is None:
        whole = spark.read.format("jdbc").options(**read_options(url, table, extra=extra)).load()
        lower, upper = whole.agg(F.min(key), F.max(key)).first()
    options = read_options(url, table, key, partitions, lower, upper, fetch_size, extra)
    return spark.read.format("jdbc").options(**options).load()


BINS = 1_000


def balanced_predicates(
    counts: list[tuple[int, int]], key: str, lower: int, width: int, partitions: int
) -> list[str]:
    """Key ranges with about equal row counts, from (bin, rows) pairs of bins of equal width.

    The ranges are disjoint and cover everything: null keys, and keys outside the bins.
    """
    total, edges, seen = sum(n for _, n in counts), [], 0
    for number, n in sorted(counts):
        # a range ends before the bin that would take it past its share
        if seen and seen + n / 2 > total * (len(edges) + 1) / partitions and len(edges) < partitions - 1:
            edges.append(lower + number * width)
        seen += n
    if not edges:
        return ["1 = 1"]
    inner = [f"{key} >= {a} and {key} < {b}" for a, b in zip(edges, edges[1:])]
    return [f"{key} < {edges[0]} or {key} is null", *inner, f"{key} >= {edges[-1]}"]


def read_jdbc_balanced(
    spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict[str, str] | None = None
) -> DataFrame:
    """Like ``read_jdbc_table`` for a whole-number key whose values cluster.

    The database counts the rows per key range first and answers with at most a thousand rows;
    crowded ranges then become narrower, so that the tasks read about equally much.
    """
    whole = spark.read.format("jdbc").options(**read_options(url, table, extra=properties)).load()
    lower, upper = whole.agg(F.min(key), F.max(key)).first()
    if lower is None:
        return whole
    width = (int(upper) - int(lower)) // BINS + 1
    number = f"floor(({key} - {lower}) / {width})"
    bins = f"(select {number} as bin, count(*) as n from {table} where {key} is not null group by {number}) counted"
    rows = spark.read.format("jdbc").options(**read_options(url, bins, extra=properties)).load().collect()
    counts = [(int(r[0]), int(r[1])) for r in rows]
    predicates = balanced_predicates(counts, key, int(lower), width, partitions)
    return spark.read.jdbc(
        url, table, predicates=predicates, properties={"fetchsize": str(FETCH_SIZE), **(properties or {})}
    )
