"""Exact duplicates by a stream that keeps every digest it has seen.

The state lives on disk in the state store, has no watermark and so never expires. For each
digest it keeps the identifier of the row that stays, the place its content can be read from
(file and row in it), and the number of rows. Equal digests are only a claim: before rows are
called copies, their whole texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywell.session import Folder

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # one budget for all stores of an executor, so that memory does not grow with their number
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # a store takes the space it uses, not megabytes ahead for each partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
GROUP = "digest binary, keep struct<doc_id: bigint, file: string, row: bigint>, n bigint"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDedup:
    """Duplicate state below ``folder``; call ``ingest`` whenever the input folder has new files.

    Of rows with equal text (null counts as empty) the one with the largest doc_id stays; among
    repeated rows with that doc_id it is the last by file and place, so exactly one row stays in
    each group. Rows without a doc_id come before all others, and if a whole group has none,
    its keep_id is null. An empty input gives an empty result.
    """

    def __init__(self, spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder, digest

    def _rows(self, files: DataFrame) -> DataFrame:
        return files.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).withColumn("digest", self.digest(F.col("text")))

    def ingest(self, path: str, files_per_batch: int | None = None) -> None:
        """Take in the Parquet files below ``path`` that earlier calls have not seen, then return."""
        session = self.spark.newSession()
        partitions = "spark.sql.shuffle.partitions"
        for name, value in (STATE_STORE | {partitions: self.spark.conf.get(partitions)}).items():
            session.conf.set(name, value)
        reader = session.readStream.schema(self.spark.read.parquet(path).schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        # a pattern also matches a single file, which a plain path of a stream must not be
        files = reader.parquet(f"{path[:-1]}[{path[-1]}]")
        groups = self._rows(files).groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))

        def publish(changed: DataFrame, batch: int) -> None:
            # a repeated batch writes the same folder again
            changed.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        (groups.writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination())

    def groups(self) -> DataFrame:
        """One row per digest: the row that stays, where its content lies, and the number of rows."""
        if not any(name.startswith("batch=") for name in Folder(self.spark, f"{self.folder}/changes").names()):
            return self.spark.createDataFrame([], GROUP)
        changes = self.spark.read.schema(GROUP).parquet(f"{self.folder}/changes")
        # both only grow from one batch to the next
        return changes.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))

    def unequal(self, path: str) -> DataFrame:
        """Digests that stand for different texts, found by comparing the bytes of all their rows.

        Each task first reduces its copies of a digest to their least and greatest text, so a hot
        group moves two texts per task.
        """
        rows = self._rows(self.spark.read.parquet(path))
        extremes = rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        return extremes.where("least != greatest").select("digest")

    def decisions(self, path: str) -> DataFrame:
        """One row per row below ``path``: keep_id, group_size, kept, text_sha256, file and row."""
        rows = self._rows(self.spark.read.parquet(path))
        unequal = self.unequal(path)
        plain = self._decided(rows, self.groups(), ["digest"])
        if unequal.isEmpty():
            return plain
        # different texts under one digest: these few groups are formed by the texts themselves
        torn = rows.join(unequal, "digest", "left_semi")
        exact = torn.groupBy("digest", "text").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
        sound = self._decided(rows.join(unequal, "digest", "left_anti"), self.groups(), ["digest"])
        return sound.unionByName(self._decided(torn, exact, ["digest", "text"]))

    @staticmethod
    def _decided(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
        slim = rows.select("doc_id", "file", "row", F.sha2("text", 256).alias("text_sha256"), *by)
        return slim.join(groups, by).select(
            "doc_id",
            F.col("keep.doc_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep")).alias("kept"),
            "text_sha256", "file", "row",
        )
