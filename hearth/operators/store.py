"""Keyed tables of Parquet folders: append where the stored row wins, delete, merge.

Rows lie below ``files/version=…/bucket=…``; a bucket is a hash of one column. A
list of versions, written after the files and renamed into place, says what is
read, so a run that breaks off leaves the table as it was and can be repeated:
files that no list names are never read, and are overwritten by the next run or
removed by :func:`vacuum`. A writer that another one has overtaken fails instead
of losing rows.

Existing rows are looked for in the touched buckets only (dynamic partition
pruning). Counts of what was saved come from the write itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
MOST_VERSIONS = 16


@dataclass
class Listing:
    """What a table consists of. ``since`` holds the first version that counts in a bucket, ``done`` the last
    transaction of every name with its version."""

    number: int = 0
    live: list[int] = field(default_factory=list)
    since: dict[str, int] = field(default_factory=dict)
    done: dict[str, list[int]] = field(default_factory=dict)
    schema: dict | None = None


@dataclass
class Saved:
    """Counts of one append: rows offered, stored, left out because their key was there, and what the caller asked for."""

    version: int
    offered: int
    saved: int
    skipped: int
    counts: dict[str, int]


@contextmanager
def metrics_kept(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution replaces a plan that turns out empty, and what is observed in it is lost; not in here."""
    key = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    rule = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    spark.conf.set(key, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def observed(metrics: Observation) -> dict[str, int]:
    """The metrics of a finished write; none where the input was known to be empty before anything ran."""
    try:
        return dict(metrics.get)
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return {}


class KeyedStore:
    """A table below ``path`` with one row per ``key``, in buckets of ``bucket_by``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", bucket_by: str = "id", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.bucket_by, self.buckets = key, bucket_by, buckets

    # ---- the list of versions ----

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listing(self) -> Listing:
        folder, files = self._hadoop("versions")
        if not files.exists(folder):
            return Listing()
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json") and not n.startswith("_")), default=None)
        if last is None:
            return Listing()
        # one small line of text
        return Listing(**json.loads(self.spark.read.text(f"{self.path}/versions/{last}", wholetext=True).first()[0]))

    def _commit(self, state: Listing) -> None:
        """Make ``state`` what is read; fails if its number is taken."""
        new, files = self._hadoop(f"versions/_{uuid.uuid4().hex}")
        out = files.create(new, True)
        out.write(json.dumps(asdict(state)).encode())
        out.close()
        target, _ = self._hadoop(f"versions/{state.number:012d}.json")
        fs = self.spark._jvm.org.apache.hadoop.fs
        no_overwrite = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, target, no_overwrite)

    # ---- reading ----

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value.cast("string")), F.lit(self.buckets)).cast("int")

    def _files(self, versions: list[int], state: Listing) -> DataFrame:
        """Rows of some versions with their ``version`` and ``bucket``."""
        schema = T.StructType.fromJson(state.schema)
        schema = schema.add("version", T.LongType()).add("bucket", T.IntegerType())
        if not versions:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/files/version={v}" for v in sorted(versions)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/files").parquet(*paths)

    def read(self, versions: list[int] | None = None) -> DataFrame:
        """The rows that count, with their ``bucket``."""
        state = self.listing()
        if state.schema is None:
            raise ValueError(f"nothing was stored at {self.path}")
        found = self._files(state.live if versions is None else versions, state)
        if state.since and versions is None:
            # on partition columns alone: pruned when files are listed
            first = F.create_map(*[F.lit(x) for b, v in state.since.items() for x in (int(b), v)])
            found = found.where(F.col("version") >= F.coalesce(first[F.col("bucket")], F.lit(0)))
        return found.drop("version")

    def touched(self, values: DataFrame) -> DataFrame:
        """Buckets of the values of ``bucket_by`` in a table: at most as many rows as there are buckets."""
        return values.select(self.bucket(F.col(self.bucket_by)).alias("bucket")).where("bucket >= 0").distinct()

    def of(self, values: DataFrame) -> DataFrame:
        """Rows of the given values of ``bucket_by``; only their buckets are scanned."""
        near = self.read().join(F.broadcast(self.touched(values)), "bucket", "left_semi")
        return near.join(values.select(self.bucket_by).distinct(), self.bucket_by, "left_semi")

    def of_one(self, value: str) -> DataFrame:
        return self.read().where((F.col("bucket") == self.bucket(F.lit(value))) & (F.col(self.bucket_by) == value))

    # ---- writing ----

    def _write(self, rows: DataFrame, version: int) -> None:
        # few files per bucket, and a busy bucket in several tasks
        spread = rows.hint("rebalance", "bucket")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/files/version={version}")

    def append(self, records: DataFrame, txn: tuple[str, int] | None = None, **counts: Column) -> Saved:
        """Store the records whose key is not stored yet; of several with one key the least.

        With ``txn``, a name and a growing number, a transaction that was
        committed before is not repeated. ``counts`` are aggregates of the stored rows.
        """
        state = self.listing()
        if txn and state.done.get(txn[0], [-1])[0] >= txn[1]:
            return Saved(state.done[txn[0]][1], 0, 0, 0, {})
        columns = [c for c in records.columns]
        offered, stored = Observation(), Observation()
        order = [F.array_sort(F.map_entries(c)) if isinstance(records.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
        seen = records.observe(offered, F.count("*").alias("rows"))
        first = seen.groupBy(self.key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
        fresh = first.select("row.*").withColumn("bucket", self.bucket(F.col(self.bucket_by)))
        if state.schema is not None:
            if [f.name for f in T.StructType.fromJson(state.schema).fields] != columns:
                raise ValueError(f"columns differ from those stored: {columns}")
            known = self.read().join(F.broadcast(self.touched(records)), "bucket", "left_semi")
            fresh = fresh.join(known.select("bucket", self.key), ["bucket", self.key], "left_anti").select(*columns, "bucket")
        fresh = fresh.observe(stored, F.count("*").alias("rows"), *[c.alias(n) for n, c in counts.items()])
        version = state.number + 1
        with metrics_kept(self.spark):
            self._write(fresh, version)
        found, asked = observed(stored), observed(offered).get("rows", 0)
        saved = found.pop("rows", 0)
        state.number, state.schema = version, state.schema or records.schema.jsonValue()
        state.live += [version] if saved else []
        if txn:
            state.done[txn[0]] = [txn[1], version]
        self._commit(state)
        return Saved(version, asked, saved, asked - saved, {n: found.get(n) or 0 for n in counts})

    def saved_in(self, version: int) -> DataFrame:
        """The rows one append has stored, for as long as its files are kept."""
        state = self.listing()
        kept = version in state.live or self._hadoop(f"files/version={version}")[1].exists(self._hadoop(f"files/version={version}")[0])
        return self.read([version] if kept else [])

    def delete(self, values: DataFrame) -> None:
        """Remove all rows of the given values of ``bucket_by``; only their buckets are written anew."""
        state = self.listing()
        if state.schema is None:
            return
        buckets = [r[0] for r in self.touched(values).collect()]
        gone = values.select(self.bucket_by).distinct()
        left = self.read().where(F.col("bucket").isin(buckets)).join(gone, self.bucket_by, "left_anti")
        version = state.number + 1
        columns = [f.name for f in T.StructType.fromJson(state.schema).fields]
        self._write(left.select(*columns, "bucket"), version)
        state.number = version
        state.live += [version]
        state.since |= {str(b): version for b in buckets}
        self._commit(state)

    def merge(self, most: int = MOST_VERSIONS) -> bool:
        """Once there are more than ``most`` versions, write the smallest as one, so that half as many remain."""
        state = self.listing()
        if len(state.live) <= most:
            return False
        _, files = self._hadoop("files")

        def size(version: int) -> int:
            return files.getContentSummary(self._hadoop(f"files/version={version}")[0]).getLength()

        small = sorted(state.live, key=size)[: len(state.live) - max(1, most // 2) + 1]
        version = state.number + 1
        rows = self._files(small, state)
        if state.since:
            first = F.create_map(*[F.lit(x) for b, v in state.since.items() for x in (int(b), v)])
            rows = rows.where(F.col("version") >= F.coalesce(first[F.col("bucket")], F.lit(0)))
        self._write(rows.drop("version"), version)
        state.number = version
        state.live = [v for v in state.live if v not in small] + [version]
        # a limit no remaining version lies below says nothing any more
        state.since = {b: v for b, v in state.since.items() if any(x < v for x in state.live)}
        self._commit(state)
        return True


def vacuum(store: KeyedStore) -> list[int]:
    """Remove files that the table does not consist of; not while others read or write. Returns their versions."""
    live = set(store.listing().live)
    folder, files = store._hadoop("files")
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    gone = sorted(v for v in (int(n.partition("=")[2]) for n in names if n.startswith("version=")) if v not in live)
    for version in gone:
        files.delete(store._hadoop(f"files/version={version}")[0], True)
    return gone
