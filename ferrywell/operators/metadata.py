"""Tables about tables: snapshots, drift, lineage, run and query history."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrywell.session import Staged


def schema_snapshot(df: DataFrame, name: str, captured_at: str | None = None) -> DataFrame:
    """One row per column with the row count of the table and, if given, the time of the snapshot."""
    fields = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
        )
        for i, f in enumerate(df.schema)
    ]
    snapshot = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), F.inline(F.array(*fields)), "row_count"
    )
    if captured_at is None:
        return snapshot
    return snapshot.withColumn("captured_at", F.lit(captured_at).cast("timestamp_ntz"))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that were added, removed or retyped, and a change of the row count."""
    a = old.select("column_name", F.col("column_type").alias("old_type"))
    b = new.select("column_name", F.col("column_type").alias("new_type"))
    columns = (
        a.join(b, "column_name", "full_outer")
        .withColumn(
            "change",
            F.when(F.col("old_type").isNull(), "added")
            .when(F.col("new_type").isNull(), "removed")
            .when(F.col("old_type") != F.col("new_type"), "retyped"),
        )
        .where(F.col("change").isNotNull())
        .select("column_name", "change", "old_type", "new_type", F.lit(None).cast("bigint").alias("row_difference"))
    )
    both = old.select(F.lit("old").alias("side"), "row_count").unionByName(
        new.select(F.lit("new").alias("side"), "row_count")
    )
    rows = (
        both.agg(
            F.max(F.when(F.col("side") == "new", F.col("row_count"))).alias("n"),
            F.max(F.when(F.col("side") == "old", F.col("row_count"))).alias("o"),
        )
        .select((F.col("n") - F.col("o")).alias("row_difference"))
        .where(F.col("row_difference") != 0)
        .select(
            F.lit(None).cast("string").alias("column_name"),
            F.lit("row count").alias("change"),
            F.lit(None).cast("string").alias("old_type"),
            F.lit(None).cast("string").alias("new_type"),
            "row_difference",
        )
    )
    return columns.unionByName(rows)


#: Pairs that one task of the closure has, and pairs through one table from which on they are split over tasks.
TASK_PAIRS, HUB_PAIRS = 200_000, 50_000


def _through(pairs: DataFrame, further: DataFrame, n: int) -> DataFrame:
    """(target, upstream) by way of each pair's upstream; tasks have a bounded number of the ``n`` pairs, whatever a table feeds.

    What is upstream of a hub is repeated for each share of the hub's pairs.
    """
    hubs = pairs.groupBy("upstream").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB_PAIRS).select(
        "upstream", F.ceil(F.col("n") / HUB_PAIRS).cast("int").alias("shares"))
    hubs = F.broadcast(Staged(hubs, "hubs").df)
    shares = F.coalesce("shares", F.lit(1))
    left = pairs.join(hubs, "upstream", "left").select("upstream", "target", F.pmod(F.xxhash64("target"), shares).cast("int").alias("share"))
    right = further.select(F.col("target").alias("upstream"), F.col("upstream").alias("further")).join(hubs, "upstream", "left").select(
        "upstream", "further", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    parts = -(-n // TASK_PAIRS) or 1
    met = left.repartition(parts, "upstream", "share").join(right.repartition(parts, "upstream", "share"), ["upstream", "share"])
    return met.select("target", F.col("further").alias("upstream"))


def lineage_closure(edges: DataFrame) -> DataFrame:
    """(target, upstream): every table that feeds a table, directly or through others.

    Tables that feed nothing lie on no path between others. While they have most edges they are set aside,
    and at the end they get what is upstream of their sources, in one join each time.

    Among the others each round joins only the pairs that the last one found with all that are known. The
    shortest path of a new pair begins with one of those, so the longest known path doubles with each round, and
    cycles end the search like anything else: they bring no new pair. What a round finds is written to
    the shared folder once and never again, so a lost executor repeats one round at most.
    """
    def found(pairs: DataFrame, n: int) -> DataFrame:
        return Staged(pairs.repartition(-(-n // TASK_PAIRS) or 1, "target", "upstream").distinct(), "lineage").df

    newest = found(edges.select("target", F.col("source").alias("upstream")), edges.count())
    n, leaves = newest.count(), []
    while n:
        feeding = newest.select(F.col("upstream").alias("target")).distinct()
        inner = Staged(newest.join(feeding, "target", "left_semi"), "lineage").df
        left = inner.count()
        if left * 2 > n:
            break
        leaves.append((newest.join(feeding, "target", "left_anti"), n - left))
        newest, n = inner, left
    known, counts = [newest], [n]
    while n:
        pairs = reduce(DataFrame.unionByName, known)
        all_known = sum(counts)
        longer = Staged(_through(newest, pairs, all_known), "lineage").df
        size = longer.count()
        parts = -(-(size + all_known) // TASK_PAIRS) or 1
        fresh = longer.repartition(parts, "target", "upstream").distinct()
        newest = Staged(fresh.join(pairs.repartition(parts, "target", "upstream"), ["target", "upstream"], "left_anti"), "lineage").df
        n = newest.count()
        known.append(newest)
        counts.append(n)
    pairs, total = reduce(DataFrame.unionByName, known), sum(counts)
    for leaf, size in reversed(leaves):
        leaf = Staged(leaf, "leaves").df
        longer = Staged(_through(leaf, pairs, size + total), "lineage").df
        size += longer.count()
        layer = found(leaf.unionByName(longer), size)
        pairs, total = pairs.unionByName(layer), total + size
    return pairs


def run_summary(runs: DataFrame) -> DataFrame:
    """Last run, run count, errors, rows and rows per second of each pipeline.

    The last run is a max over structs, which combines on the map side; a window would sort
    all runs of a busy pipeline in one task.
    """
    last = F.max(F.struct("started_at", "run_id", "status"))
    # a total shorter than a tenth of a second counts as one tenth
    seconds = F.greatest(F.col("total_seconds").cast("decimal(20,1)"), F.lit("0.1").cast("decimal(20,1)"))
    return (
        runs.groupBy("pipeline_id")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum("rows_loaded").alias("total_rows"),
            F.sum("elapsed_seconds").alias("total_seconds"),
            last.alias("__last"),
        )
        .select(
            "pipeline_id", "runs", "errors", "total_rows",
            F.round(F.col("total_rows").cast("decimal(28,0)") / seconds, 0).cast("bigint").alias("rows_per_second"),
            F.col("__last.started_at").alias("last_started_at"),
            F.col("__last.run_id").alias("last_run_id"),
            F.col("__last.status").alias("last_status"),
        )
    )


def exact_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Per group the smallest whole-number value that at least the given share does not exceed.

    Equal values are counted first. The counts are then dealt out by ranges of group and value, so that a
    busy group lies in many partitions, in order, and written once. Which partition holds a rank follows
    from what each holds of the group, a short list of numbers; only in that one the rank is looked up. No
    step sorts a whole group.
    """
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(group), F.col(value).cast("bigint").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranged = Staged(values.repartitionByRange(F.col(group), F.col("v")).withColumn("part", F.spark_partition_id()), "ranks").df
    held = ranged.groupBy(group, "part").agg(F.sum("n").alias("held"))
    parts = held.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("part", "held"))).alias("parts"), F.sum("held").alias("total"))
    wanted = [F.struct(F.lit(name).alias("point"), _rank("total", share).alias("rank")) for name, share in points.items()]
    hits = parts.select(group, "parts", F.inline(F.array(*wanted))).select(
        group, "point", "rank", _part_of_rank("parts", "rank").alias("__hit")).select(
        group, "point", "rank", "__hit.part", "__hit.below")
    within = Window.partitionBy(group, "part", "point").orderBy("v")
    reached = ranged.join(hits, [group, "part"]).withColumn("upto", F.sum("n").over(within))
    found = reached.where(F.col("below") + F.col("upto") >= F.col("rank"))
    return found.groupBy(group).agg(
        *[F.min(F.when(F.col("point") == name, F.col("v"))).alias(name) for name in points]
    )


def _part_of_rank(parts: str, rank: str) -> Column:
    """The partition in which a rank falls, and how many values lie in those before."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("below"))

    def step(seen: Column, part: Column) -> Column:
        upto = seen["upto"] + part["held"]
        here = seen["part"].isNull() & (F.col(rank) <= upto)
        return F.struct(
            upto.alias("upto"), F.when(here, part["part"]).otherwise(seen["part"]).alias("part"),
            F.when(here, seen["upto"]).otherwise(seen["below"]).alias("below"))

    return F.aggregate(parts, start, step)


def _rank(total: str, share: float):
    """The rank as an exact fraction of the share as it is written."""
    exact = Fraction(str(share))
    ranked = f"{total} * {exact.numerator}BD / {exact.denominator}BD"
    # the quotient is a decimal with digits to spare, and whole where the division goes out evenly
    return F.expr(f"greatest(1L, cast(ceil({ranked}) as bigint))")


def query_history_stats(history: DataFrame) -> DataFrame:
    """Per connection: queries, rows, execution time in total, at most, at the median and at 95 %."""
    totals = history.groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("row_count").alias("total_rows"),
        F.sum("execution_time_ms").alias("total_ms"),
        F.max("execution_time_ms").alias("max_ms"),
    )
    points = exact_percentiles(history, "connection_id", "execution_time_ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return totals.join(points, "connection_id", "left")
