"""Parameter sets as tables: named, shaped arrays in blocks, loaded by name with shape checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a block: a large array spreads over many rows.
BLOCK_VALUES = 1 << 16
SCHEMA = "name string, shape array<long>, trainable boolean, block long, data array<double>"


def blocks(name: str, values: np.ndarray, trainable: bool = True, size: int = BLOCK_VALUES) -> Iterator[tuple]:
    """Rows of SCHEMA for one array, in row-major order. An array without values has one empty block."""
    flat = np.asarray(values, np.float64).reshape(-1)
    for at in range(0, max(1, len(flat)), size):
        yield name, list(np.shape(values)), trainable, at // size, flat[at : at + size].tolist()


def parameters(spark: SparkSession, arrays: dict[str, np.ndarray], frozen: Iterable[str] = (), size: int = BLOCK_VALUES) -> DataFrame:
    held = set(frozen)
    return spark.createDataFrame([r for n, a in arrays.items() for r in blocks(n, a, n not in held, size)], SCHEMA)


def save(table: DataFrame, folder: str, *, only: Column | None = None) -> None:
    """Writes a set, or the part of it that only selects, sorted by name so that footers prune."""
    kept = table if only is None else table.where(only)
    kept.repartitionByRange("name", "block").sortWithinPartitions("name", "block").write.mode("overwrite").parquet(folder)


def trainable() -> Column:
    return F.col("trainable")


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def report(model: DataFrame, loaded: DataFrame, ignored: Iterable[str] = ()) -> DataFrame:
    """(name, status) of every name on either side: loaded, missing (the model's alone), surplus (the
    file's alone), shape (both, but of different shapes) or ignored. Names only are joined."""
    shape = lambda t, c: t.groupBy("name").agg(F.first("shape").alias(c))
    both = shape(model, "wanted").join(shape(loaded, "found"), "name", "full")
    status = (
        F.when(F.col("name").isin(*ignored), "ignored").when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "surplus")
        .when(F.col("wanted") != F.col("found"), "shape").otherwise("loaded")
    )
    return both.select("name", status.alias("status"))


def load(model: DataFrame, loaded: DataFrame, *, strict: bool = False, ignored: Iterable[str] = ()) -> DataFrame:
    """The model's parameters with the values of loaded where the name is on both sides: a merge by name
    and block. Names that the model lacks, and those ignored, are left out; names that loaded lacks keep
    the model's values. Shapes that differ are an error, and so are, if strict, names on one side only."""
    found = report(model, loaded, ignored)
    wrong = ["shape", "missing", "surplus"] if strict else ["shape"]
    if bad := found.where(F.col("status").isin(*wrong)).orderBy("name").limit(20).collect():
        raise ValueError("; ".join(f"{r.name}: {r.status}" for r in bad))
    taken = found.where("status = 'loaded'").select("name")
    values = loaded.join(taken, "name", "left_semi").select("name", "block", F.col("data").alias("new"))
    return model.join(values, ["name", "block"], "left").withColumn("data", F.coalesce("new", "data")).select(*model.columns)


def arrays(table: DataFrame) -> dict[str, np.ndarray]:
    """The arrays on the driver: for sets that fit there, such as those that a task is given."""
    rows = sorted(table.collect(), key=lambda r: (r.name, r.block))
    out: dict[str, list] = {}
    shapes = {}
    for r in rows:
        out.setdefault(r.name, []).extend(r.data)
        shapes[r.name] = tuple(r.shape)
    return {n: np.array(v).reshape(shapes[n]) for n, v in out.items()}
