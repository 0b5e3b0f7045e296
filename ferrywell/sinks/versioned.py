"""Target tables that can be replaced, appended to and upserted while they are being read.

Parquet offers no ``MERGE INTO`` and cannot overwrite a table that is being read, so each write
goes to a directory of its own below ``data/``, and a small file in ``commits/`` is created last. A
reader takes the newest commit: a write that dies halfway is never seen. Keyed tables are
partitioned into hash buckets, so an upsert rewrites only the buckets its keys fall into.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywell.operators.cleaning import column, quoted
from ferrywell.session import Folder

BUCKET = "__bucket"

# Values to publish with the rows, or a function that finds them in the rows as written.
State = dict[str, str] | Callable[[DataFrame], dict[str, str] | None] | None


class VersionedTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: list[str] | None = None,
        buckets: int = 16,
        max_versions: int = 32,
    ):
        """``buckets`` should keep a bucket near one to a few gigabytes; it is fixed with the first write."""
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys or [])
        self.buckets = buckets
        self.max_versions = max_versions

    # -- state -------------------------------------------------------------------------------

    @property
    def _commits(self) -> Folder:
        return Folder(self.spark, f"{self.path}/commits")

    def commit(self) -> dict | None:
        """The newest complete commit, or None while the table does not exist."""
        folder = self._commits
        for name in sorted((n for n in folder.names() if n.endswith(".json")), reverse=True):
            try:
                return json.loads(folder.read_text(name))
            except ValueError:  # a writer died, or is still writing, this one
                continue
        return None

    @property
    def version(self) -> int:
        commit = self.commit()
        return commit["version"] if commit else 0

    @property
    def state(self) -> dict[str, str]:
        """Values published together with the data: watermark, last position, batch number."""
        commit = self.commit()
        return commit["state"] if commit else {}

    # -- reading -----------------------------------------------------------------------------

    def read(self, only_buckets: list[int] | None = None, commit: dict | None = None) -> DataFrame:
        """The rows of a commit, by default the newest."""
        commit = commit or self.commit()
        if commit is None:
            raise FileNotFoundError(f"no complete version in {self.path}")
        schema = T.StructType.fromJson(commit["schema"])
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        whole = [f"{self.path}/data/{part['folder']}" for part in commit["parts"] if part["buckets"] is None]
        parts = [self.spark.read.schema(schema).parquet(*whole)] if whole else []
        for part in commit["parts"]:
            if part["buckets"] is None:
                continue
            folder = f"{self.path}/data/{part['folder']}"
            wanted = part["buckets"] if only_buckets is None else sorted(set(part["buckets"]) & set(only_buckets))
            if wanted:
                rows = self.spark.read.schema(stored).parquet(folder)
                if wanted != part["written"]:
                    # on the partition column: files of other buckets are not opened
                    rows = rows.where(F.col(BUCKET).isin(wanted))
                parts.append(rows.drop(BUCKET))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def with_bucket(self, df: DataFrame) -> DataFrame:
        commit = self.commit()
        buckets = commit["buckets"] if commit else self.buckets
        return df.withColumn(
            BUCKET, F.pmod(F.xxhash64(*[column(k) for k in self.keys]), F.lit(buckets)).cast("int")
        )

    def summary(self, batch: DataFrame, measures: list[str] = ()) -> Row:
        """One row about a batch: the ``touched`` buckets, and the given measures. A null key is an error."""
        some_null = " or ".join(f"{quoted(k)} is null" for k in self.keys)
        row = (
            self.with_bucket(batch)
            .agg(*[F.expr(m) for m in (f"sort_array(collect_set({BUCKET})) as touched", f"bool_or({some_null}) as lacks_key", *measures)])
            .first()
        )
        if row.lacks_key:
            raise ValueError(f"null key in {self.keys}")
        return row

    # -- writing -----------------------------------------------------------------------------

    def replace(self, df: DataFrame, state: State = None) -> int:
        """All rows of the table are now ``df``."""
        return self._publish(df, self.commit(), [], range(self._bucket_count()), state)

    def append(self, df: DataFrame, state: State = None) -> int:
        """Add rows; nothing that is already there is read or rewritten.

        ``state`` can be a function of the rows as written. If it returns None, nothing is published.
        """
        commit = self.commit()
        return self._publish(df, commit, commit["parts"] if commit else [], range(self._bucket_count()), state)

    def replace_buckets(self, df: DataFrame, buckets: list[int], base: dict, state: State = None) -> int:
        """The rows of the given buckets are now ``df``; other buckets keep their files.

        ``base`` is the commit that ``df`` was made from. If another writer has published since,
        this write fails instead of undoing the other one.
        """
        commit = base
        if any(part["buckets"] is None for part in commit["parts"]):
            raise ValueError("the table was written without keys, so it has no buckets to replace")
        if len(commit["parts"]) >= self.max_versions:
            # the parts with the fewest buckets are written again together with this one, so that
            # a reader meets few parts; the large ones stay as they are
            small = sorted(commit["parts"], key=lambda part: len(part["buckets"]))[: self.max_versions // 2]
            more = sorted({b for part in small for b in part["buckets"]} - set(buckets))
            df, buckets = df.unionByName(self.read(more, commit)), sorted([*buckets, *more])
        dropped = set(buckets)
        parts = [{**p, "buckets": sorted(set(p["buckets"]) - dropped)} for p in commit["parts"]]
        return self._publish(df, commit, [p for p in parts if p["buckets"]], buckets, state)

    def set_state(self, state: dict[str, str]) -> int:
        """Publish new state values without touching the data."""
        commit = self.commit()
        if commit is None:
            raise FileNotFoundError(f"no complete version in {self.path}")
        commit.update(version=commit["version"] + 1, state={**commit["state"], **state})
        self._write_commit(commit)
        return commit["version"]

    def drop_old_versions(self) -> None:
        """Delete the older commits, and the data that the newest commit no longer refers to."""
        commit = self.commit()
        for name in self._commits.names():
            if name < f"{commit['version']:012d}.json":
                self._commits.delete(name)
        used = {part["folder"] for part in commit["parts"]}
        data = Folder(self.spark, f"{self.path}/data")
        for name in data.names():
            if name not in used and int(name.partition("-")[0]) <= commit["version"]:
                data.delete(name)

    def drop_damaged_commits(self) -> None:
        """Remove commits newer than the newest complete one, left by writers that died while committing.

        Such a commit blocks further writes. Only call this while nothing else writes.
        """
        last = self.version
        for name in self._commits.names():
            if name > f"{last:012d}.json":
                self._commits.delete(name)

    def _bucket_count(self) -> int:
        commit = self.commit()
        return commit["buckets"] if commit else self.buckets

    def _publish(self, df: DataFrame, commit: dict | None, kept: list[dict], buckets, state: State) -> int:
        version = commit["version"] + 1 if commit else 1
        if kept:
            if commit["keys"] != self.keys:
                raise ValueError(f"the table is keyed by {commit['keys']}, not by {self.keys}")
            before = {f.name: f.dataType for f in T.StructType.fromJson(commit["schema"])}
            if before != {f.name: f.dataType for f in df.schema}:
                raise ValueError(f"columns differ from those of the table: {df.schema.simpleString()}")
        # two writers never share a directory; the second one fails when it commits
        name = f"{version:012d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/{name}"
        if self.keys:
            # rebalancing gives each bucket few files and splits a bucket that is far too large
            self.with_bucket(df).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        else:
            df.write.parquet(folder)
        if callable(state):
            state = state(self.spark.read.schema(df.schema).parquet(folder))
            if state is None:
                Folder(self.spark, folder).delete()
                return commit["version"] if commit else 0
        held = list(buckets) if self.keys else None
        # "written" is what the folder holds, "buckets" what later versions have left valid of it
        part = {"folder": name, "written": held, "buckets": held}
        self._write_commit(
            {
                "version": version,
                "schema": df.schema.jsonValue(),
                "keys": self.keys,
                "buckets": commit["buckets"] if commit else self.buckets,
                "parts": [*kept, part],
                "state": {**(commit["state"] if commit else {}), **(state or {})},
            }
        )
        return version

    def _write_commit(self, commit: dict) -> None:
        self._commits.create_text(f"{commit['version']:012d}.json", json.dumps(commit))
