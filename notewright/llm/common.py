"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.order import BATCH_BYTES, BATCH_CONF, UNBOUNDED, by_bytes, checkpoint_folder, settled  # noqa: F401

#: Stands in for a null identifier wherever identifiers are compared: null sorts below all others.
NULL_ID = -(2**63)

M64 = 0xFFFFFFFFFFFFFFFF
#: An odd multiplier and its inverse modulo 2^64, so that prefix sums give rolling hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ident(name: str) -> Column:
    return F.coalesce(col(name).cast("long"), F.lit(NULL_ID))


def text_of(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables, which the driver and all executors share."""
    return checkpoint_folder(spark)


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, of at most so many parts."""
    return settled(df if parts is None else df.coalesce(parts))


def fewest(df: DataFrame, rows: int) -> int:
    """How many tasks tables of about as many rows as df are dealt to: one for each so many rows, and
    two a core at least. Each task of a loop's many small stages costs time, and room on the driver."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def merging(df: DataFrame) -> DataFrame:
    """The right side of a join by merging, whatever its size. A side that grows with the input is else
    collected and kept by the driver while it is below the broadcast threshold, and a loop of such
    joins keeps many at a time."""
    return df.hint("merge")


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a loop of jobs: Spark drops the shuffle files and checkpoints that nothing
    refers to any more when the driver collects its garbage, which such a loop seldom sets off, so
    they would add up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: spreads entropy over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: What a Python worker keeps between tasks: the latest of its models, so that workers that serve
#: several operators in turn don't add their caches up.
_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The worker's object of this key, made if it isn't the one held."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what the worker holds, for operators that keep nothing, and gives the memory back to the
    system: a worker that is used again would else keep the size of its largest model."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown as needed up to a chunk's length."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(size, BASE_INV, np.uint64)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of codes; a k-gram's hash does not depend on its position."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = POWERS.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    w = min(w, len(values))
    done = 1
    while done * 2 <= w:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    if done < w:
        values = np.minimum(values[: len(values) - (w - done)], values[w - done :])
    return values
