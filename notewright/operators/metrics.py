"""Token and model metrics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.music import EOS, NORMAL_TOKENS, PAD_TOKEN, SUBBEATS


def cross_entropy(scored: DataFrame, prob: str = "prob", token: str = "token", pad: int = PAD_TOKEN) -> DataFrame:
    """(cross_entropy, tokens): the mean of -log p over tokens that are not pads."""
    real = scored.where(F.col(token) != pad)
    return real.agg(F.avg(-F.log(prob)).alias("cross_entropy"), F.count("*").alias("tokens"))


def song_perplexity(scored: DataFrame, prob: str = "prob", token: str = "token", pad: int = PAD_TOKEN) -> DataFrame:
    """(song, perplexity): exp of the summed -log p over the count of tokens that are not pads."""
    real = scored.where(F.col(token) != pad)
    return real.groupBy("song").agg(F.exp(F.sum(-F.log(prob)) / F.count("*")).alias("perplexity"))


def perplexity_summary(perplexities: DataFrame) -> DataFrame:
    return perplexities.agg(F.avg("perplexity").alias("mean"), F.stddev_samp("perplexity").alias("std"))


def softmax(scores: DataFrame, group: list[str], score: str, temperature: float = 1.0) -> DataFrame:
    """Adds weight: the softmax of score within group, shifted by its maximum."""
    within = Window.partitionBy(*group)
    shifted = (F.col(score) - F.max(score).over(within)) / temperature
    return scores.withColumn("exp", F.exp(shifted)).withColumn("weight", F.col("exp") / F.sum("exp").over(within)).drop("exp")


def log_sum_exp(scores: DataFrame, group: list[str], score: str, masked: Column | None = None) -> DataFrame:
    """(group, lse) of the scores that the mask leaves."""
    kept = scores if masked is None else scores.where(masked)
    top = kept.withColumn("top", F.max(score).over(Window.partitionBy(*group)))
    return top.groupBy(*group).agg((F.log(F.sum(F.exp(F.col(score) - F.col("top")))) + F.first("top")).alias("lse"))


def arg_max(scores: DataFrame, group: list[str], score: str, item: str) -> DataFrame:
    """(group, item) of the largest score, ties to the smaller item."""
    return scores.groupBy(*group).agg(F.max_by(item, F.struct(score, -F.col(item))).alias(item))


def one_hot(rows: DataFrame, item: str, size: int) -> DataFrame:
    return rows.withColumn("one_hot", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == F.col(item)).cast("int")))


def layer_norm(vectors: DataFrame, vector: str, epsilon: float = 1e-12) -> DataFrame:
    """Adds normed: the vector less its mean over the root of its variance plus epsilon.

    Columns that are merged into one projection are put into lambdas as expressions, so a mean or a
    variance would be summed up anew for every element. Here each is the element of an array of one,
    over which a lambda goes once."""
    values = F.col(vector).cast("array<double>")
    n = F.size(vector)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    var = lambda xs, mean: F.try_divide(total(F.transform(xs, lambda x: (x - mean) * (x - mean))), n)
    scaled = lambda xs, mean: once(F.sqrt(var(xs, mean) + epsilon), lambda root: F.transform(xs, lambda x: (x - mean) / root))
    return vectors.withColumn("normed", once(values, lambda xs: once(F.try_divide(total(xs), n), lambda mean: scaled(xs, mean))))


def best_checkpoints(log: DataFrame, n: int = 10, loss: str = "val_loss", tie: str = "step") -> DataFrame:
    """The n rows of least loss: a report of fixed size."""
    return log.orderBy(loss, tie).limit(n)


def early_stop(log: DataFrame, patience: int, run: str = "run", step: str = "step", loss: str = "val_loss") -> DataFrame:
    """Adds best (least loss so far), waited (rows since it was reached) and stop (whether patience
    has run out by this row)."""
    order = Window.partitionBy(run).orderBy(step)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(loss).over(upto)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = log.withColumns({"best": best, "row": F.row_number().over(order)})
    better = F.when(before.isNull() | (F.col(loss) < before), F.row_number().over(order))
    waited = numbered.withColumn("improved", better).withColumn("waited", F.col("row") - F.max("improved").over(upto))
    return waited.withColumn("stop", F.max((F.col("waited") >= patience).cast("int")).over(upto) == 1).drop("row", "improved")


def ended_before(tokens: DataFrame, eos: int = EOS) -> DataFrame:
    """Adds ended (an end of step came earlier in the step) and padded (pads from there on)."""
    earlier = Window.partitionBy("song", "part", "step").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("token") == eos).cast("int")).over(earlier), F.lit(0)) == 1
    return tokens.withColumn("ended", ended).withColumn("padded", F.when(F.col("ended"), PAD_TOKEN).otherwise(F.col("token")))


def all_ended(tokens: DataFrame, eos: int = EOS) -> DataFrame:
    """(step, all_ended): whether every song has an end of step there."""
    per_song = tokens.groupBy("step", "song").agg(F.bool_or(F.col("token") == eos).alias("has"))
    return per_song.groupBy("step").agg(F.bool_and("has").alias("all_ended"))


def sampling_allowed(
    step: Column, pos: Column, token: Column, *, instruments: list[int] | None = None, rhythm: int | None = None, cap: int = 16, rule: str = "consistent"
) -> Column:
    """Whether a token may be drawn at a position of a step.

    At even positions: programs (those of instruments, if given) below the cap, and the end of step;
    at odd ones: pitch and duration. Steps off the rhythm only end. The rule ``reference`` opens 256
    and up for pitch and duration, which bars the shortest duration; ``consistent`` opens the range
    that tokens are built in."""
    if rule not in ("consistent", "reference"):
        raise ValueError("rule is 'consistent' or 'reference'")
    low, high = (256, NORMAL_TOKENS) if rule == "reference" else (128, NORMAL_TOKENS - 128)
    program = token.isin(instruments) if instruments is not None else (token >= 0) & (token < 128)
    even = (token == EOS) | (program & (F.floor(pos / 2) < cap))
    usual = F.when(pos % 2 == 0, even).otherwise((token >= low) & (token < high))
    return usual if rhythm is None else F.when(step % rhythm != 0, token == EOS).otherwise(usual)


def masked_logits(logits: DataFrame, allowed: Column, logit: str = "logit") -> DataFrame:
    return logits.withColumn("masked", F.when(allowed, F.col(logit)).otherwise(F.lit(float("-inf"))))


def shifted_right(rows: DataFrame, group: list[str], order: str, value: str, start: Column) -> DataFrame:
    """Adds previous: the value one row before, or start."""
    return rows.withColumn("previous", F.coalesce(F.lag(value, 1).over(Window.partitionBy(*group).orderBy(order)), start))


def subbeat_seconds(tempo: float) -> float:
    return 60.0 / tempo / SUBBEATS
