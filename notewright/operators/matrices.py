"""Matrices as tables of blocks: products by joining on the inner index, linear maps, low-rank gates,
and the removal of heads by remapped indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and columns of a block.
SIDE = 256
BLOCK = "i long, j long, rows int, cols int, data array<double>"


def from_vectors(vectors: DataFrame, row: str, vector: str, side: int = SIDE) -> DataFrame:
    """Blocks (i, j, ids, rows, cols, data) of a tall matrix whose rows are vectors: the rows whose number
    divided by side is i are a block's; ids are those present, in order, and stay with the block. Rows of
    one block meet in one task, at most side of them; a vector is sliced, never taken apart."""
    span = F.transform(F.sequence(F.lit(0), F.expr(f"cast(ceil(size(`{vector}`) / {side}) as int) - 1")), lambda j: F.struct(j.cast("long").alias("j"), F.slice(F.col(vector), j * side + 1, side).alias("part")))
    parts = vectors.select(F.expr(f"cast(`{row}` as bigint) div {side}").alias("i"), F.col(row).cast("long").alias("id"), F.inline(span))
    packed = parts.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("id", F.col("part").cast("array<double>").alias("part")))).alias("held"))
    return packed.select(
        "i", "j", F.transform("held", lambda h: h["id"]).alias("ids"), F.size("held").alias("rows"), F.size(F.col("held")[0]["part"]).alias("cols"),
        F.flatten(F.transform("held", lambda h: h["part"])).alias("data"),
    )


def from_array(spark, values: np.ndarray, side: int = SIDE) -> DataFrame:
    """Blocks of a matrix that is at hand, such as a weight."""
    rows = []
    for i in range(0, values.shape[0], side):
        for j in range(0, values.shape[1], side):
            part = values[i : i + side, j : j + side]
            rows.append((i // side, j // side, *part.shape, part.astype(float).reshape(-1).tolist()))
    return spark.createDataFrame(rows, BLOCK)


def transposed(blocks: DataFrame) -> DataFrame:
    """The blocks of the transpose; a block's values are picked anew, no row is exploded."""
    place = lambda x: (x % F.col("rows")) * F.col("cols") + F.floor(x / F.col("rows")).cast("int")
    data = F.transform(F.sequence(F.lit(0), F.size("data") - 1), lambda x: F.element_at("data", (place(x) + 1).cast("int")))
    turned = blocks.withColumn("data", data)  # by the old sizes, before these change names
    return turned.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("cols").alias("rows"), F.col("rows").alias("cols"), "data")


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Blocks of left times right, with left's ids where it has them: block (i, k) of left meets block
    (k, j) of right, and their products are summed by (i, j), partly before they move."""
    carried = ["ids"] if "ids" in left.columns else []
    a = left.select("i", F.col("j").alias("k"), F.col("rows").alias("rows"), F.col("cols").alias("inner"), F.col("data").alias("a"), *carried)
    b = right.select(F.col("i").alias("k"), "j", F.col("rows").alias("inner_b"), F.col("cols").alias("cols"), F.col("data").alias("b"))
    met = a.join(b, "k")

    @F.pandas_udf("array<double>")
    def multiplied(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for rows, inner, inner_b, x, y in parts:
            out = []
            for r, n, m, p, q in zip(rows, inner, inner_b, x, y, strict=True):
                if n != m:
                    raise ValueError("the inner sizes of two blocks differ")
                out.append((np.reshape(p, (r, n)) @ np.reshape(q, (m, -1))).reshape(-1))
            yield pd.Series(out)

    products = met.select("i", "j", "k", "rows", "cols", multiplied("rows", "inner", "inner_b", "a", "b").alias("data"), *carried)
    return summed(products, carried)


def summed(products: DataFrame, carried: list[str]) -> DataFrame:
    """Adds up blocks of the same place. Where the inner side has a single block there is nothing to add
    but the exchange is by place all the same; the sum takes the terms in the order of k."""
    key = ["i", "j", "rows", "cols"]
    terms = products.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("terms"), *[F.first(c).alias(c) for c in carried])
    first = F.col("terms")[0]["data"]
    total = F.aggregate(F.slice("terms", F.lit(2), F.size("terms")), first, lambda s, t: F.zip_with(s, t["data"], lambda x, y: x + y))
    return terms.select("i", "j", *carried, "rows", "cols", total.alias("data"))


def to_vectors(blocks: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, vector) of a tall matrix with ids."""
    piece = lambda at: F.slice("data", at * F.col("cols") + 1, F.col("cols"))
    pieces = blocks.select("j", F.posexplode("ids").alias("at", row), "data", "cols").select(row, "j", piece(F.col("at")).alias("piece"))
    ordered = pieces.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("j", "piece"))).alias("pieces"))
    return ordered.select(row, F.flatten(F.transform("pieces", lambda p: p["piece"])).alias(vector))


def linear(vectors: DataFrame, row: str, vector: str, weight: DataFrame, bias: Column | None = None, side: int = SIDE) -> DataFrame:
    """(row, vector) mapped by a weight of blocks (inputs by outputs), plus a bias array."""
    out = to_vectors(product(from_vectors(vectors, row, vector, side), weight), row, vector)
    return out if bias is None else out.withColumn(vector, F.zip_with(F.col(vector), bias, lambda x, b: x + b))


def gated_low_rank(vectors: DataFrame, row: str, vector: str, down: DataFrame, up: DataFrame, gate: float, side: int = SIDE) -> DataFrame:
    """(row, vector): x + gate * (x down up), through the narrow middle."""
    through = product(product(from_vectors(vectors, row, vector, side), down), up)
    change = to_vectors(through, row, "change")
    return vectors.select(row, F.col(vector).cast("array<double>").alias(vector)).join(change, row).select(row, F.zip_with(vector, "change", lambda x, c: x + gate * c).alias(vector))


def pruned_indexes(heads: DataFrame, asked: DataFrame, group: str = "layer", head: str = "head") -> DataFrame:
    """The heads of each layer that stay, with their index among those that do: heads(group, head) are
    numbered as in the whole model, asked(group, head, round) are the prunings, round after round. Adds
    kept (false for those pruned in any round; a head asked for twice, or one that a layer lacks, changes
    nothing), pruned_in (the first round that asked for it) and new_index (null if pruned): a running
    count of those that stay, which is the index that every round in turn would lead to."""
    first = asked.groupBy(group, head).agg(F.min("round").alias("pruned_in"))
    marked = heads.join(first, [group, head], "left").withColumn("kept", F.col("pruned_in").isNull())
    upto = Window.partitionBy(group).orderBy(head).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("new_index", F.when(F.col("kept"), F.sum(F.col("kept").cast("int")).over(upto) - 1))


def pruned_rows(weights: DataFrame, indexes: DataFrame, group: str = "layer", head: str = "head") -> DataFrame:
    """The weights' rows (group, head, ...) of heads that stay, numbered anew."""
    stay = indexes.where("kept").select(group, head, "new_index")
    return weights.join(stay, [group, head]).drop(head).withColumnRenamed("new_index", head)
