"""Tables kept in the shared folder, so that a lost executor costs no recomputation from the start."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parley.session import work_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str = "part", last: bool = False) -> DataFrame:
    """Written to a new folder under ``spark.checkpoint.dir`` and read again; with ``last`` its shuffle files go at once."""
    path = f"{work_dir(df.sparkSession)}-{name}-{uuid.uuid4().hex[:6]}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    if last:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if last:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, name: str, by: str, values: Iterable[int]) -> list[DataFrame]:
    """``kept`` in one pass with a folder for each of the ``values`` that the column ``by`` has: a table of each, without it."""
    spark = df.sparkSession
    path, schema = f"{work_dir(spark)}-{name}-{uuid.uuid4().hex[:6]}", df.drop(by).schema
    df.write.partitionBy(by).parquet(path)
    folders = [f"{path}/{by}={v}" for v in values]
    return [spark.read.schema(schema).parquet(f) if _folder(spark, f)[0] else spark.createDataFrame([], schema) for f in folders]


def _folder(spark: SparkSession, path: str) -> tuple[bool, Callable[[], bool]]:
    """Whether a folder is there, and a call that removes it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(folder), lambda: system.delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``kept`` or ``parted`` has written, once nothing reads them any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _folder(t.sparkSession, unquote(path))[1]()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fewer(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in tasks of about ``each`` of its ``rows`` rows, one a core at least, where the shuffle would deal them to more.

    For Python steps after a shuffle: a task takes longer to start there than a few rows take.  Larger inputs stay as they are.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(n) if n < partitions(df.sparkSession) else df


BITS = 1 << 25  # size of a row filter, whatever the number of keys: 4 MB
_SEGMENT = 1 << 19


def likely(keys: DataFrame, on: list[str]) -> Column:
    """A condition on rows with the columns ``on``: true for all whose key is among ``keys``, and by chance for a few others.

    For joins that keep few of many long rows, so that most texts are not shuffled.  The filter is a bitmap of fixed
    size (two bits a key).  With more keys than it can tell apart it lets every row through, and the join does the work.
    """
    spark = keys.sparkSession

    def places(h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        return np.r_[h % np.uint64(BITS), (h >> np.uint64(32)) % np.uint64(BITS)].astype(np.int64)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[places(batch.column("h").to_numpy(zero_copy_only=False))] = True
        used = [i for i in range(BITS // _SEGMENT) if bits[i * _SEGMENT:(i + 1) * _SEGMENT].any()]
        yield pa.RecordBatch.from_pydict({"segment": pa.array(used, pa.int32()), "bits": pa.array(
            [np.packbits(bits[i * _SEGMENT:(i + 1) * _SEGMENT]).tobytes() for i in used], pa.binary())})

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(_SEGMENT // 8, np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "segment int, bits binary"
    segments = keys.select(F.xxhash64(*on).alias("h")).mapInArrow(mark, schema).groupBy("segment").applyInArrow(joined, schema).collect()
    whole = np.zeros(BITS // 8, np.uint8)
    for r in segments:
        whole[r["segment"] * _SEGMENT // 8:(r["segment"] + 1) * _SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        at = places(h.to_numpy(np.int64))
        hit = (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return pd.Series(hit[:len(h)] & hit[len(h):]).astype(bool)

    return may(F.xxhash64(*on))
