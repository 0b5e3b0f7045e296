"""Scheduled loads as streams: each run takes the files that arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter, StreamingQuery

from ferrywell.operators import cdc, cells
from ferrywell.operators.cleaning import column
from ferrywell.plans.loads import prepared
from ferrywell.session import Folder, Staged
from ferrywell.sinks.tables import append_table, upsert_table
from ferrywell.sinks.versioned import VersionedTable


def _reader(spark: SparkSession, schema: T.StructType, files_per_batch: int | None) -> DataStreamReader:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def _start(writer: DataStreamWriter, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _run(
    spark: SparkSession, source: str, schema: T.StructType, checkpoint: str, files_per_batch: int | None,
    apply: Callable[[DataFrame, int], None], trigger: dict,
) -> StreamingQuery:
    return _start(_reader(spark, schema, files_per_batch).parquet(source).writeStream, apply, checkpoint, trigger)


def _is_applied(target: VersionedTable, stream: str, batch: int) -> bool:
    """A batch can be delivered again after a failure; its number was committed with its rows."""
    return int(target.state.get(f"batch:{stream}", -1)) >= batch


#: Where a row of the keyed stream comes from: when its file was written, or the target as the stream found it.
ARRIVED, STORED = "__arrived", "__stored"


def incremental_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: VersionedTable, watermark: str,
    checkpoint: str, files_per_batch: int | None = None, **trigger,
) -> StreamingQuery:
    """Upsert arriving files, or append them if the target has no keys.

    The row with the highest watermark counts for its key, a null being below all; of equal ones the row
    whose file is newest. The newest row of each key is the stream's state, so a late row is known from
    that, and no batch reads the target to find out. A target that was loaded by other means before the
    stream's first run is taken into the state once.
    """
    files = _reader(spark, schema, files_per_batch)
    if not target.keys:
        def add(batch: DataFrame, number: int) -> None:
            if not _is_applied(target, checkpoint, number):
                append_table(target, prepared(batch), {f"batch:{checkpoint}": str(number)})

        return _start(files.parquet(source).writeStream, add, checkpoint, trigger)

    arriving = files.parquet(source)
    arrived = prepared(arriving.select("*")).columns
    rows = prepared(arriving.select("*", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias(ARRIVED)))
    rows = rows.toDF(*arrived, ARRIVED).withColumn(STORED, F.lit(False))
    before = _taken_over(spark, target, checkpoint)
    if before is not None:
        rows = rows.unionByName(before.select(*map(column, arrived), F.lit(None).cast("timestamp_ntz").alias(ARRIVED), F.lit(True).alias(STORED)))
    rest = [c for c in arrived if c not in target.keys]
    order = F.struct(column(watermark.upper()), F.col(ARRIVED), *map(column, rest))
    newest = rows.groupBy(*map(column, target.keys)).agg(F.max_by(F.struct(*map(column, rest), STORED), order).alias("__row"))

    def put(batch: DataFrame, number: int) -> None:
        if _is_applied(target, checkpoint, number):
            batch.write.format("noop").mode("overwrite").save()  # the state moves on all the same
            return
        changed = batch.where(~F.col("__row")[STORED]).select(
            *map(column, target.keys), *[F.col("__row")[c].alias(c) for c in rest]).select(*map(column, arrived))
        upsert_table(target, changed, [watermark.upper()], {f"batch:{checkpoint}": str(number)})

    return _start(newest.writeStream.outputMode("update"), put, checkpoint, trigger)


def _taken_over(spark: SparkSession, target: VersionedTable, checkpoint: str) -> DataFrame | None:
    """The target as the stream first found it, as a stream of its own that the checkpoint reads once."""
    folder = Folder(spark, f"{checkpoint}/taken-over")
    if "rows" not in folder.names():
        if target.commit() is None or "offsets" in Folder(spark, checkpoint).names():
            return None
        target.read().write.mode("overwrite").parquet(f"{checkpoint}/taken-over/rows")
    return spark.readStream.schema(target.read().schema).parquet(f"{checkpoint}/taken-over/rows")


def cdc_stream(
    spark: SparkSession, source: str, schema: T.StructType, target: VersionedTable,
    checkpoint: str, files_per_batch: int | None = None, **trigger,
) -> StreamingQuery:
    """Apply arriving change files; a change older than the one already applied is ignored."""

    def apply(batch: DataFrame, number: int) -> None:
        if not _is_applied(target, checkpoint, number):
            cdc.cdc_merge(target, batch, {f"batch:{checkpoint}": str(number)})

    return _run(spark, source, schema, checkpoint, files_per_batch, apply, trigger)


def cdc_log_stream(
    spark: SparkSession, source: str, schema: T.StructType, rows: T.StructType, target: VersionedTable,
    quarantine: str, checkpoint: str, files_per_batch: int | None = None, **trigger,
) -> StreamingQuery:
    """Apply arriving files of a JSON change log; ``rows`` is the schema of the target's own columns.

    A column that a change leaves out keeps its value. Each batch is parsed once and staged; lines that
    cannot be read, and changes with a cell or key that does not fit, are filed below ``quarantine`` by
    batch, so a batch that is delivered again files them once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if _is_applied(target, checkpoint, number):
            return
        lines = Staged(cdc.judged_changes(batch, rows, target.keys), "log-batch")
        try:
            aside = lines.df.where("reason is not null").drop("action", "op", "cells")
            aside.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
            changes = cdc.parsed_as_cells(lines.df.where("reason is null and op is not null"), rows)
            cells.merge(target, changes, {f"batch:{checkpoint}": str(number)})
        finally:
            lines.release()

    return _run(spark, source, schema, checkpoint, files_per_batch, apply, trigger)
