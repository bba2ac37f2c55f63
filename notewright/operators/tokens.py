"""Rolls to tokens and tokens to notes.

A slot is two tokens: its program, then pitch and duration. Positions run through a step's slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.music import (
    DRUM_PROGRAM,
    DURATIONS,
    END_OF_STEP,
    EOS,
    NORMAL_TOKENS,
    PAD,
    PAD_TOKEN,
    PITCHES,
    VELOCITY_TOKENS,
    duration_subbeats,
    shrink_duration,
)


def token_columns(shift: Column, with_velocity: bool = False) -> tuple[Column, Column]:
    """The slot's two tokens. A slot without a pitch is two pads, and a marker's first token is the
    end of the step; drums are not transposed."""
    normal = VELOCITY_TOKENS if with_velocity else NORMAL_TOKENS
    eos, pad = normal + 1, normal + 2
    empty = F.col("pitch").isNull() | (F.col("pitch") == PAD)
    first = F.col("program")
    base = 16 if with_velocity else 1
    if with_velocity:
        first = first + F.expr("velocity div 8").cast("int") * PITCHES
    second = F.col("pitch") + (F.col("dur") + base) * PITCHES + F.when(F.col("program") != DRUM_PROGRAM, shift).otherwise(0)
    first = F.when(F.col("program") == END_OF_STEP, eos).when(empty, pad).otherwise(first)
    return first.cast("int"), F.when(empty, pad).otherwise(second).cast("int")


def tokenize(roll: DataFrame, shift: Column | int = 0, with_velocity: bool = False) -> DataFrame:
    """(song, part, step, pos, token) of each slot of the roll, end markers included."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    first, second = token_columns(shift, with_velocity)
    pair = F.posexplode(F.array(first, second)).alias("half", "token")
    return roll.select("song", "part", "step", "slot", pair).select(
        "song", "part", "step", (F.col("slot") * 2 + F.col("half")).alias("pos"), "token"
    )


def token_lists(tokens: DataFrame, width: int | None = None) -> DataFrame:
    """(song, part, step, tokens): a step's tokens in order, padded to width."""
    lists = tokens.groupBy("song", "part", "step").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("held"))
    filled = F.col("held.token")
    if width is not None:
        filled = F.concat(filled, F.array_repeat(F.lit(PAD_TOKEN), F.greatest(F.lit(0), F.lit(width) - F.size("held"))))
    return lists.select("song", "part", "step", filled.alias("tokens"))


def task_flags(task: str) -> dict[str, bool]:
    """Flags in a task name: rev, self and lmask, as whole words between underscores."""
    words = task.split("_")
    return {"reverse": "rev" in words, "self": "self" in words, "left_mask": "lmask" in words}


def task_flag_columns(name: Column) -> tuple[Column, Column, Column]:
    words = F.split(name, "_")
    return tuple(F.array_contains(words, w).alias(w) for w in ("rev", "self", "lmask"))


# Kinds of model and sets of data, by the first of these that a saved model's name holds.
MODEL_KINDS = ("cocomulla", "prompt", "yinyang", "seq2seq")
DATA_SETS = ("drums_nondrum", "_chord_mel", "_chords")


def _first_held(name: Column, words: tuple[str, ...], complaint: str) -> Column:
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w))
    return F.when(F.size(held) > 0, F.get(held, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit(complaint), F.coalesce(name, F.lit("null")))).cast("string"))


def model_kind(name: Column) -> Column:
    """Which kind of model a name stands for; a name without one, null included, fails."""
    return _first_held(name, MODEL_KINDS, "no kind of model in ")


def data_set(name: Column) -> Column:
    """Which set of data a model of this name works on; a name without one, null included, fails."""
    return _first_held(name, DATA_SETS, "no set of data in ")


def two_parts(roll: DataFrame, task: str = "") -> DataFrame:
    """Parts 0 (condition) and 1 (target): the roll's own, swapped by rev; by self both are part 0."""
    flags = task_flags(task)
    if flags["self"]:
        whole = roll.where(F.col("part") == 0)
        return whole.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    return roll.withColumn("part", 1 - F.col("part")) if flags["reverse"] else roll


def compressed_time(roll: DataFrame, ratio_left: int, ratio_right: int) -> DataFrame:
    """Keeps every ratio-th step of a part and shortens durations by 2 * floor(log2 ratio) indexes."""
    out = None
    for part, ratio in ((0, ratio_left), (1, ratio_right)):
        less = 2 * (ratio.bit_length() - 1)
        piece = (
            roll.where((F.col("part") == part) & (F.col("step") % ratio == 0))
            .withColumn("dur", shrink_duration(F.col("dur"), less))
            .withColumn("step", F.expr(f"step div {ratio}").cast("int"))
        )
        out = piece if out is None else out.unionByName(piece)
    return out


def index_vector(lengths: DataFrame, ratio: int) -> DataFrame:
    """(song, i): 0, ratio, 2 * ratio, ... below the song's length."""
    return lengths.select("song", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(ratio))).alias("i"))


def used_positions(tokens: DataFrame) -> DataFrame:
    """(pos) of the positions that hold anything but pads in some row."""
    return tokens.groupBy("pos").agg(F.min("token").alias("least")).where(F.col("least") != PAD_TOKEN).select("pos")


def valid_pairs(lists: DataFrame, list_col: str = "tokens") -> DataFrame:
    """Adds pairs: the (program, pitch, dur) of a step's tokens up to the first end of step, odd
    tail, or value out of range."""
    tokens = F.col(list_col)
    n = F.expr(f"size({list_col}) div 2").cast("int")

    def pair(i: Column) -> Column:
        value = F.get(tokens, i * 2 + 1) - PITCHES
        return F.struct(
            F.get(tokens, i * 2).alias("program"), F.pmod(value, F.lit(PITCHES)).alias("pitch"), F.floor(value / PITCHES).cast("int").alias("dur")
        )

    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pair)).otherwise(
        F.array().cast("array<struct<program:int,pitch:int,dur:int>>")
    )
    bad = F.transform(
        every,
        lambda p: (p["program"] == EOS) | (p["program"] < 0) | (p["program"] >= PITCHES) | (p["dur"] < 0) | (p["dur"] >= len(DURATIONS)),
    )
    stop = F.array_position(bad, True)
    return lists.withColumn("pairs", F.when(stop > 0, F.slice(every, 1, (stop - 1).cast("int"))).otherwise(every))


def detokenize(
    lists: DataFrame, *, tempo: float = 120.0, ratio: float = 1.0, velocity: int = 100, fixed_program: int | None = None
) -> DataFrame:
    """(song, part, step, at, program, is_drum, pitch, velocity, start, end) in seconds, stopping in
    each step at its first bad pair; fixed_program replaces the program of all but drums."""
    beat = 60.0 / tempo / 4
    notes = valid_pairs(lists).select("song", "part", "step", F.posexplode("pairs").alias("at", "note"))
    drum = F.col("note.program") == DRUM_PROGRAM
    start = F.col("step") * F.lit(beat)
    end = duration_subbeats(F.col("note.dur")) * F.lit(beat) + start
    program = F.when(drum, 0).otherwise(F.col("note.program") if fixed_program is None else F.lit(fixed_program))
    return notes.select(
        "song", "part", "step", "at", program.cast("int").alias("program"), drum.alias("is_drum"), F.col("note.pitch").alias("pitch"),
        F.lit(velocity).alias("velocity"), (start * ratio).alias("start"), (end * ratio).alias("end"),
    )


def with_extra_instruments(decoded: DataFrame, extra: DataFrame) -> DataFrame:
    """Decoded notes and those of further instruments, numbered by extra's column instrument. It is
    null for decoded notes, so both stay apart where they share a program; columns that one side
    lacks are null there."""
    return decoded.withColumn("instrument", F.lit(None).cast("int")).unionByName(extra, allowMissingColumns=True)


def rescaled(notes: DataFrame, *, tempo: float = 120.0, velocity: int | None = None, program: int | None = None) -> DataFrame:
    """Note times in subbeats to seconds; optionally one velocity, and one program for all, which
    fails on drums."""
    beat = 60.0 / tempo / 4
    out = notes.withColumns({"start": F.col("start") * F.lit(beat), "end": F.col("end") * F.lit(beat)})
    if velocity is not None:
        out = out.withColumn("velocity", F.lit(velocity))
    if program is not None:
        out = out.withColumn("program", F.when(F.col("is_drum"), F.raise_error("drums keep their program").cast("int")).otherwise(F.lit(program)))
    return out


def program_override(notes: DataFrame, program: int) -> DataFrame:
    return notes.withColumn("program", F.when(F.col("is_drum"), F.col("program")).otherwise(F.lit(program)))


def prompt(rows: DataFrame, steps: int) -> DataFrame:
    return rows.where(F.col("step") < steps)
