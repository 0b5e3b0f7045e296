"""Steps of an operator, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ferrywell.session import Folder, new_folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once and well compressed; the shuffle files that made them may then go.

    Spark drops them when the driver's JVM collects garbage, which a driver with little to do puts off
    for up to half an hour, so it is told to.
    """
    return Step(df, label).df


class Step:
    """A step that its operator drops again once nothing reads it any more."""

    def __init__(self, df: DataFrame, label: str):
        spark, self._path = df.sparkSession, new_folder(df.sparkSession, label)
        df.write.option("compression", "zstd").parquet(self._path)
        spark.sparkContext._jvm.System.gc()
        self.df = spark.read.schema(df.schema).parquet(self._path)

    def release(self) -> None:
        Folder(self.df.sparkSession, self._path).delete()
