"""Token totals by source, language and tokenizer version, kept by signed changes.

Each batch of inserts, deletes and revisions is summed per key before it is stored; a total is the
sum of the committed batches. Batches are additive, so their order does not matter, and each has an
identifier: a batch that is committed already changes nothing when it is sent again.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywell.llm import byte_bpe
from ferrywell.session import Folder

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer (its version) and n_tokens of each whole text (null: 0)."""
    path = path or byte_bpe.default_path()

    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        count = byte_bpe.load(path).count
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(tokenizer).alias("tokenizer"), tokens(F.col("text").cast("string")).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that turn what ``old`` added into what ``new`` adds; rows in both cancel out."""
    keys = ["doc_id", *KEYS, "n_tokens"]
    signed = deletes(old).unionByName(inserts(new))
    net = signed.groupBy(*keys).agg(F.sum("sign").alias("sign"))
    return net.where("sign != 0")


class TokenRollup:
    """Totals below ``folder``. Null sources and languages are keys of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self.folder = spark, folder, Folder(spark, folder)

    def _commits(self) -> dict[str, str]:
        """Data folder of each committed batch."""
        names = [n for n in self.folder.names() if n.startswith("commit=")]
        merged = [n for n in self.folder.names() if n.startswith("merged=")]
        found = {n.removeprefix("commit="): self.folder.read_text(n) for n in names}
        for name in sorted(merged, key=lambda n: int(n.removeprefix("merged="))):
            data, *covered = self.folder.read_text(name).split("\n")
            found.update(dict.fromkeys(covered, data))
        return found

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of rows with KEYS, ``n_tokens`` and ``sign``; false if it was there before.

        The rows go to a new folder; the commit file is created last and by one writer only, so a
        batch that failed halfway, or runs twice at the same time, counts once.
        """
        if "\n" in batch or "/" in batch:
            raise ValueError("a batch identifier holds no line break and no slash")
        if batch in self._commits():
            return False
        data = f"data-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("n_docs"),
            F.sum(F.col("sign") * F.coalesce(F.col("n_tokens"), F.lit(0))).cast("bigint").alias("n_tokens"),
        ).write.parquet(f"{self.path}/{data}")
        self.folder.create_text(f"commit={batch}", data)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens per key; a key whose documents are all gone has no row."""
        paths = [f"{self.path}/{data}" for data in sorted(set(self._commits().values()))]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*paths)
        return (deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs != 0 or n_tokens != 0"))

    def merge(self) -> None:
        """Put all committed batches into one folder, so that totals stay cheap after many batches."""
        commits = self._commits()
        if not commits:
            return
        data = f"data-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{data}")
        number = sum(n.startswith("merged=") for n in self.folder.names())
        self.folder.create_text(f"merged={number}", "\n".join([data, *sorted(commits)]))
