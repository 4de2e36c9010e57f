"""Helpers the training-data operators share.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, which is exactly how
``bytes.split()`` cuts; ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.session import materialised

BUNDLES_PER_SPLIT = 8
BATCH_BYTES = 4 << 20


class Places(dict):
    """Things numbered in the order they are first seen."""

    def __missing__(self, thing: bytes) -> int:
        self[thing] = place = len(self)
        return place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: str) -> Column:
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b""))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a number written as text, modulo ``divisor``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def bound_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; the shuffles that made it are removed at once."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialised(df, label)
    finally:
        conf.set(key, before)


def drop_written(*frames: DataFrame) -> None:
    """Remove tables made by ``written`` that no later job reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte plane by byte plane, compressed."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def bundle_count(df: DataFrame) -> int:
    """Bundles of rows that one task works on at once; grows with the number of input splits."""
    return BUNDLES_PER_SPLIT * max(1, df.rdd.getNumPartitions())


def row_hash(df: DataFrame) -> Column:
    """A hash over all columns of a row, the same whenever the row is computed again."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def append_columns(df: DataFrame, text_col: str, compute: Callable[[list[bytes]], list[pa.Array]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """``df`` and columns computed from its texts, batch by batch; a column of the same name is replaced."""
    bound_batches(df.sparkSession)
    names = [n for n, _ in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = compute(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in kept], raw(text_col).alias("__bytes")).mapInArrow(run, schema)
