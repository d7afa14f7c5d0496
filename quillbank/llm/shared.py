"""What several operators of this subpackage share: scratch tables, package shipping, word rules, a vectorised hash map."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.session import ship  # noqa: F401  the operators take it from here

#: ASCII white space as the contracts define it: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_made: list[str] = []


def _clean() -> None:
    """At the end of the driver's program the scratch tables that it made go, where its session is still there."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Py4JError, OSError):
        for path in _made if spark is not None else ():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session (tests) may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(root)
    if not _made:
        atexit.register(_clean)
    _made.append(f"{root.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared scratch folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished stages now rather than at the next chance collection.

    Results never depend on it; it only ends the files' life sooner.
    """
    for _ in range(2):  # what the first collection frees may hold the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def fold_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class LongMap:
    """Open addressing over distinct uint64 keys: ``find`` gives each query's row among the keys, or -1."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32 if len(keys) < 2**31 else np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.rows[at[left]] < 0
            tried = left[free]
            self.rows[at[tried]] = tried
            left = np.concatenate([left[~free], tried[self.rows[at[tried]] != tried]])
            at[left] = (at[left] + 1) & self.mask
        self.keys[at] = keys

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, queries: np.ndarray) -> np.ndarray:
        queries = np.ascontiguousarray(queries, np.uint64)
        at = self._home(queries)
        out = self.rows[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != queries))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            out[left] = self.rows[at[left]]
            left = left[(out[left] >= 0) & (self.keys[at[left]] != queries[left])]
        return out
