"""Session settings and the shared folder that jobs stage their data in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ferrywell", cores: str | int = "*") -> SparkSession:
    """A local session. Where a master has been submitted, only the application's name is set here."""
    if SparkSession.getActiveSession() is None and "spark.master" in _submitted():
        return SparkSession.builder.appName(app).getOrCreate()
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )


def _submitted() -> dict[str, str]:
    """Settings that spark-submit or the environment's defaults brought."""
    from pyspark import SparkConf, SparkContext

    if SparkContext._jvm is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        return {}  # not started by spark-submit
    return dict(SparkConf().getAll())


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own, because there driver and executors share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local")  # also local-cluster, whose executors share the disk
    if named:
        if named.startswith("file:") and not local:
            raise RuntimeError("spark.checkpoint.dir names a folder of one machine")
        return named.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ferrywell-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/ferrywell/{label}-{uuid.uuid4().hex}"


class Staged:
    """A DataFrame written once to the shared folder, for inputs that are read several times.

    Unlike cached blocks the copy outlives any executor, and being Parquet it lets each
    later pass read only the columns it needs.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def release(self) -> None:
        Folder(self.spark, self.path).delete()


class Folder:
    """The few file-system calls that DataFrame readers and writers do not offer."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _child(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return [status.getPath().getName() for status in self._fs.listStatus(self._path)]

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._child(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_text(self, name: str, text: str) -> None:
        """Write a new file; fails if the name is taken, which is the guard between two writers."""
        stream = self._fs.create(self._child(name), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def delete(self, name: str | None = None) -> None:
        self._fs.delete(self._child(name) if name else self._path, True)
