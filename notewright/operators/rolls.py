"""Rolls: the notes of each part and step, capped by arrival, deduplicated, in canonical order.

Within a step notes arrive in order of seq. The cap is tested before the selector, so a note that
is not selected takes no slot but is still seen while the step has room."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.music import END_OF_STEP, duration_index, recoded_program, step_of
from notewright.functions.order import settled
from notewright.operators.gates import end_steps, quantisation_gate
from notewright.operators.selectors import parse_parts, with_selector_inputs

ROLL = ("song", "part", "step", "slot", "program", "pitch", "dur", "velocity")


def quantised(notes: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Adds step and dur, recodes drum programs; with lengths, keeps steps in [0, length)."""
    step, end = step_of(F.col("start")), step_of(F.col("end"))
    out = notes.withColumns(
        {"step": step, "dur": duration_index(end - step), "program": recoded_program(F.col("program"), F.col("is_drum"))}
    ).where(F.col("step") >= 0)
    if lengths is None:
        return out
    return out.join(lengths.select("song", "length"), "song").where(F.col("step") < F.col("length")).drop("length")


def with_room(steps: DataFrame, selected: Column, cap: int, dedup: bool) -> DataFrame:
    """Adds selected, fills (whether the note takes a new slot if there is room), used (slots taken
    before it arrives) and room (whether used is below the cap).

    With dedup only the first selected arrival of a (program, step, pitch) takes a slot. The first
    arrival is flagged, since a window cannot count distinct keys."""
    steps = steps.withColumn("selected", F.coalesce(selected, F.lit(False)))
    fills = F.col("selected").cast("int")
    if dedup:
        key = Window.partitionBy("song", "step", "program", "pitch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        fills = F.when(F.col("selected") & (F.sum(F.col("selected").cast("int")).over(key) == 1), 1).otherwise(0)
    before = Window.partitionBy("song", "step").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        steps.withColumn("fills", fills)
        .withColumn("used", F.coalesce(F.sum("fills").over(before), F.lit(0)).cast("int"))
        .withColumn("room", F.col("used") < cap)
    )


def capped(steps: DataFrame, selected: Column, cap: int, dedup: bool, longest: str = "dur") -> DataFrame:
    """(song, step, slot, program, pitch, dur, velocity): at most cap notes a step, by arrival.

    With dedup a strictly longer repeat replaces duration and velocity in the first arrival's slot
    while the step has room; longest names the column that decides."""
    return _slots(with_room(steps, selected, cap, dedup).where("selected AND room"), [], dedup, longest)


def _slots(kept: DataFrame, keys: list[str], dedup: bool, longest: str = "dur") -> DataFrame:
    """The slots of selected notes with room, within keys, song and step."""
    if not dedup:
        return kept.select("song", *keys, "step", F.col("used").alias("slot"), "program", "pitch", "dur", "velocity")
    best = F.max_by(F.struct("dur", "velocity"), F.struct(F.col(longest), -F.col("seq")))
    return (
        kept.groupBy("song", *keys, "step", "program", "pitch")
        .agg(F.min(F.when(F.col("fills") == 1, F.col("used"))).alias("slot"), best.alias("best"))
        .select("song", *keys, "step", "slot", "program", "pitch", F.col("best.dur").alias("dur"), F.col("best.velocity").alias("velocity"))
    )


def in_canonical_order(roll: DataFrame) -> DataFrame:
    """Renumbers the slots of each (song, part, step) by velocity, program, pitch, duration."""
    order = Window.partitionBy("song", "part", "step").orderBy("velocity", "program", "pitch", "dur", "slot")
    return roll.withColumn("slot", F.row_number().over(order) - 1)


def with_end_markers(roll: DataFrame, lengths: DataFrame, parts: int, cap: int) -> DataFrame:
    """Adds the marker 254 in the first free slot of every step of every part that is not full."""
    every = lengths.select("song", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("step"))
    every = every.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
    # Every marker stands among its step's slots and counts them, so the roll is made once: counts apart
    # from the slots would make it twice, in the same tasks.
    blank = every.select("song", "part", "step", *[F.lit(None).cast("int").alias(c) for c in ROLL[3:]], F.lit(True).alias("marker"))
    both = roll.select(*ROLL, F.lit(False).alias("marker")).unionByName(blank)
    both = both.withColumn("held", F.count_if(~F.col("marker")).over(Window.partitionBy("song", "part", "step")).cast("int"))
    own = {"slot": F.when(F.col("marker"), F.col("held")).otherwise(F.col("slot")), "program": F.when(F.col("marker"), END_OF_STEP).otherwise(F.col("program"))}
    return both.where(~F.col("marker") | (F.col("held") < cap)).withColumns(own).select(*ROLL)


def pitch_shift_range(seen: DataFrame) -> DataFrame:
    """(song, shift_min, shift_max) from notes seen with room (song, pitch, is_drum): how far all
    pitches can move; (-127, 127) where a song has no pitched note."""
    pitched = F.when(~F.col("is_drum"), F.col("pitch"))
    return seen.groupBy("song").agg(
        (-F.coalesce(F.min(pitched), F.lit(127))).alias("shift_min"), (127 - F.coalesce(F.max(pitched), F.lit(0))).alias("shift_max")
    )


def build_rolls(
    notes: DataFrame,
    *,
    selectors: str | list[str] = "all",
    cap: int = 16,
    dedup: bool = False,
    gate: bool = True,
    fixed_length: int | None = None,
    seed: int = 0,
    dealt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(roll, songs) of the songs that pass every gate and have a note in every part that is not
    ``empty``. roll(song, part, step, slot, program, pitch, dur, velocity) includes end markers;
    songs(song, length, shift_min, shift_max).

    Everything is local to a song: one exchange on song up front serves all windows and joins; notes
    that are dealt by song already need none."""
    parts = parse_parts(selectors)
    notes = notes if dealt else notes.repartition("song")
    lengths = end_steps(notes, fixed_length)
    if gate:
        lengths = lengths.join(quantisation_gate(notes).select("song"), "song", "left_semi")
    steps = quantised(with_selector_inputs(notes, parts, seed), lengths)
    # All parts' flags stand side by side, so one sort a step serves them; they are settled, as the
    # songs' summary and the roll both read them.
    flags = []
    for i, part in enumerate(parts):
        steps = with_room(steps, part.column(), cap, dedup)
        flags.append(F.struct(F.lit(i).alias("part"), *[F.col(f"{c}_{i}").alias(c) for c in ("selected", "fills", "used", "room")]))
        steps = steps.withColumnsRenamed({c: f"{c}_{i}" for c in ("selected", "fills", "used", "room")})
    steps = settled(steps.select("song", "step", "seq", "program", "pitch", "dur", "velocity", "is_drum", F.array(*flags).alias("flags")))
    room = F.exists("flags", lambda f: f["room"])
    pitched = F.when(room & ~F.col("is_drum"), F.col("pitch"))
    filled = [F.bool_or(F.get("flags", F.lit(i))["selected"] & F.get("flags", F.lit(i))["room"]) for i, part in enumerate(parts) if part.kind != "empty"]
    songs = steps.groupBy("song").agg(
        (-F.coalesce(F.min(pitched), F.lit(127))).alias("shift_min"),
        (127 - F.coalesce(F.max(pitched), F.lit(0))).alias("shift_max"),
        reduce(Column.__and__, filled, F.lit(True)).alias("whole"),
    )
    songs = settled(lengths.join(songs.where("whole"), "song").select("song", "length", "shift_min", "shift_max"))
    kept = steps.join(songs.select("song"), "song", "left_semi").select("*", F.inline("flags")).where("selected AND room")
    roll = in_canonical_order(_slots(kept, ["part"], dedup).select(*ROLL))
    return with_end_markers(roll, songs, len(parts), cap), songs


def dense_rows(roll: DataFrame, parts: int, cap: int) -> DataFrame:
    """(song, step, cells): the dense form for sinks, parts * cap structs with 255 where free."""
    at = F.col("part") * cap + F.col("slot")
    cell = F.struct("program", *[F.coalesce(c, F.lit(255)).alias(c) for c in ROLL[5:]])
    blank = F.struct(*[F.lit(255).alias(c) for c in ROLL[4:]])
    filled = roll.groupBy("song", "step").agg(F.map_from_entries(F.collect_list(F.struct(at, cell))).alias("held"))
    return filled.select(
        "song", "step", F.transform(F.sequence(F.lit(0), F.lit(parts * cap - 1)), lambda i: F.coalesce(F.try_element_at("held", i), blank)).alias("cells")
    )
