"""Deterministic sampling: every draw depends on its key alone, never on row order or partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.music import keyed_unit
from notewright.functions.order import global_index


def crop_starts(songs: DataFrame, length: int, stride: int = 1, seed: str = "crop") -> DataFrame:
    """Adds crop_start: a multiple of stride below length - target (0 where they are equal); songs
    shorter than the target go."""
    room = (F.col("length") - length).cast("double")
    start = F.floor(keyed_unit(seed, F.col("song")) * room / stride) * stride
    return songs.where(F.col("length") >= length).withColumn("crop_start", start.cast("int"))


def shift_draws(songs: DataFrame, seed: str = "shift") -> DataFrame:
    """Adds shift: a whole number from shift_min to shift_max, both included."""
    span = F.col("shift_max") - F.col("shift_min") + 1
    return songs.withColumn("shift", (F.floor(keyed_unit(seed, F.col("song")) * span) + F.col("shift_min")).cast("int"))


def crops(roll: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """The roll rows of each crop, steps counted from its start."""
    inside = (F.col("step") >= F.col("crop_start")) & (F.col("step") < F.col("crop_start") + length)
    return (
        roll.join(starts.select("song", "crop_start"), "song")
        .where(inside)
        .withColumn("step", F.col("step") - F.col("crop_start"))
        .drop("crop_start")
    )


def epoch_order(songs: DataFrame, epoch: int, seed: str = "epoch") -> DataFrame:
    """Adds nth: the song's position in the epoch's shuffled order."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col("song")))
    ordered = global_index(songs.withColumn("shuffle_key", key), ["shuffle_key", "song"], "nth")
    return ordered.withColumn("nth", F.col("nth").cast("int")).drop("shuffle_key")


def batches(ordered: DataFrame, size: int) -> DataFrame:
    """Adds batch and place; the last batch may be short."""
    return ordered.withColumns({"batch": F.expr(f"nth div {size}").cast("int"), "place": (F.col("nth") % size).cast("int")})


def span_masks(
    sequences: DataFrame, prob: float, length: int, *, least: int = 0, key: str = "song", size: int | None = None, seed: str = "mask"
) -> DataFrame:
    """(key, step) masked by spans of length steps from distinct starts; spans may overlap.

    The number of spans is int(prob * T / length + u), at least least, and no more than fit. T is
    size, or the column length; sequences shorter than a span fail."""
    if length < 1:
        raise ValueError("a mask is at least one step long")
    if size is not None and length > size:
        raise ValueError("a mask is no longer than its sequence")
    total = F.lit(size) if size is not None else F.col("length")
    long = F.when(total >= length, total).otherwise(F.raise_error("a mask is no longer than its sequence").cast("int"))
    n = F.greatest((prob * long / length + keyed_unit(seed + "n", F.col(key))).cast("int"), F.lit(least))
    spans = F.when(n * length > long, F.expr(f"total div {length}")).otherwise(n)
    starts = (
        sequences.withColumn("total", long)
        .withColumn("spans", spans)
        .select(key, "spans", F.explode(F.sequence(F.lit(0), F.col("total") - length)).alias("start"))
        .withColumn("u", keyed_unit(seed, F.col(key), F.col("start")))
    )
    order = Window.partitionBy(key).orderBy("u", "start")
    picked = starts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("spans"))
    steps = F.sequence(F.col("start"), F.col("start") + length - 1)
    return picked.select(key, F.explode(steps).alias("step")).distinct()


def multinomial_draws(choices: DataFrame, group: list[str], weight: str, item: str, seed: str = "draw") -> DataFrame:
    """(group, item): one item a group in proportion to weight, by the inverse of its cumulative sum."""
    upto = Window.partitionBy(*group).orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*group)
    u = keyed_unit(seed, *[F.col(g) for g in group])
    return (
        choices.withColumns({"upto": F.sum(weight).over(upto), "total": F.sum(weight).over(total), "u": u})
        .where(F.col("upto") > F.col("u") * F.col("total"))
        .groupBy(*group)
        .agg(F.min(item).alias(item))
    )


def attention_drop(pairs: DataFrame, ratio: float, keys: list[str], seed: str = "drop") -> DataFrame:
    """Pairs that a Bernoulli mask of the given ratio leaves."""
    return pairs.where(keyed_unit(seed, *[F.col(k) for k in keys]) >= ratio)


def dropout(value: Column, ratio: float, *keys: Column, seed: str = "dropout") -> Column:
    """The value, 0 with the given probability and else scaled so that its expectation stays."""
    if not 0 <= ratio < 1:
        raise ValueError("a dropout ratio is at least 0 and below 1")
    return F.when(keyed_unit(seed, *keys) >= ratio, value / F.lit(1.0 - ratio)).otherwise(F.lit(0.0))


def draw(seed: str, *keys: Column) -> Column:
    return keyed_unit(seed, *keys)
