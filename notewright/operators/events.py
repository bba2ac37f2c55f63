"""The event layer: ticks, relocation, programs in force, note pairing, instruments, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.order import next_value

#: Larger deltas count as 0; events that belong to track 0; a file's last sane tick.
LARGEST_DELTA = 0x7FFFFFFF
TRACK0_TYPES = ("set_tempo", "key_signature", "time_signature")
LARGEST_TICK = 10_000_000
TEXT_TYPES = ("lyrics", "text", "marker")


def absolute_ticks(events: DataFrame) -> DataFrame:
    """Adds tick: the running sum of dtick within a track."""
    upto = Window.partitionBy("song", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("dtick") > LARGEST_DELTA, 0).otherwise(F.col("dtick"))
    return events.withColumn("tick", F.sum(delta).over(upto))


def relocated_meta(events: DataFrame) -> DataFrame:
    """Moves tempo, key and time signature events to track 0 and numbers every track's events anew
    by (tick, original track, original position), which is the stable order."""
    order = Window.partitionBy("song", "track").orderBy("tick", "from_track", "from_idx")
    moved = F.when(F.col("type").isin(*TRACK0_TYPES), 0).otherwise(F.col("track"))
    return (
        events.withColumns({"from_track": F.col("track"), "from_idx": F.col("idx"), "track": moved})
        .withColumn("idx", F.row_number().over(order))
        .drop("from_track", "from_idx")
    )


def constant_clock(ticks: Column, resolution: int, beat_div: int = 4) -> Column:
    """Ticks to subbeats at a constant tempo."""
    return ticks * beat_div / F.lit(float(resolution))


def tempo_segments(events: DataFrame, resolution: int, default: int = 500_000) -> DataFrame:
    """(song, tick, until, seconds, per_tick): stretches of one tempo (microseconds a quarter)."""
    changes = events.where(F.col("type") == "set_tempo").groupBy("song", "tick").agg(F.max_by("tempo", "idx").alias("tempo"))
    starts = events.select("song").distinct().select("song", F.lit(0).cast("long").alias("tick"), F.lit(default).cast("double").alias("tempo"))
    starts = starts.join(changes.where(F.col("tick") == 0).select("song"), "song", "left_anti")
    by_tick = Window.partitionBy("song").orderBy("tick")
    per_tick = F.col("tempo") / 1e6 / resolution
    return (
        changes.select("song", F.col("tick").cast("long").alias("tick"), F.col("tempo").cast("double").alias("tempo"))
        .unionByName(starts)
        .withColumns({"until": F.lead("tick").over(by_tick), "per_tick": per_tick})
        .withColumn("passed", F.lag((F.col("until") - F.col("tick")) * F.col("per_tick"), 1, 0.0).over(by_tick))
        .withColumn("seconds", F.sum("passed").over(by_tick.rowsBetween(Window.unboundedPreceding, 0)))
        .select("song", "tick", "until", "seconds", "per_tick")
    )


def tempo_clock(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds time in seconds: the last segment that starts at or before the event, found by merging
    both in tick order, so no pairs are formed."""
    marked = events.select("*", F.lit(1).alias("is_event"), F.lit(None).cast("struct<tick:bigint,seconds:double,per_tick:double>").alias("seg"))
    rows = segments.select("song", "tick", F.struct("tick", "seconds", "per_tick").alias("seg"), F.lit(0).alias("is_event"))
    upto = Window.partitionBy("song").orderBy("tick", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(rows, allowMissingColumns=True).withColumn("in_force", F.last("seg", ignorenulls=True).over(upto))
    time = F.col("in_force.seconds") + (F.col("tick") - F.col("in_force.tick")) * F.col("in_force.per_tick")
    return both.where("is_event = 1").withColumn("time", time).drop("is_event", "seg", "in_force")


def corrupt_songs(events: DataFrame, largest: int = LARGEST_TICK) -> DataFrame:
    """(song, last_tick) of songs whose last tick is beyond the guard: the quarantine table."""
    return events.groupBy("song").agg(F.max("tick").alias("last_tick")).where(F.col("last_tick") + 1 > largest)


def program_in_force(events: DataFrame) -> DataFrame:
    """Adds in_force: the program last chosen on the track and channel, 0 before any."""
    upto = Window.partitionBy("song", "track", "channel").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.when(F.col("type") == "program_change", F.col("program"))
    return events.withColumn("in_force", F.coalesce(F.last(chosen, ignorenulls=True).over(upto), F.lit(0)))


def track_names(events: DataFrame) -> DataFrame:
    """Adds track_name: the last name seen so far on the track, empty before any."""
    upto = Window.partitionBy("song", "track").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("type") == "track_name", F.col("text"))
    return events.withColumn("track_name", F.coalesce(F.last(named, ignorenulls=True).over(upto), F.lit("")))


def next_off_pairs(events: DataFrame) -> DataFrame:
    """Notes where no two events of a key share a tick: every note-on ends at the next note-off of
    its (song, track, channel, note), with the program in force there. Window functions only."""
    notes = program_in_force(events).where(F.col("type").isin("note_on", "note_off"))
    off = next_value(F.when(F.col("type") == "note_off", F.struct("tick", "in_force")), ["song", "track", "channel", "note"], ["idx"])
    return (
        notes.withColumn("off", off)
        .where((F.col("type") == "note_on") & F.col("off").isNotNull())
        .select("song", "track", "channel", "note", F.col("tick").alias("on_tick"), F.col("off.tick").alias("off_tick"), F.col("off.in_force").alias("program"))
    )


def paired_notes(events: DataFrame) -> DataFrame:
    """(song, track, channel, note, velocity, program, on_tick, off_tick, seq), same-tick ties included.
    program is the one in force at the note's end; unclosed notes are left out; seq is the order in
    which a track's notes close, of those closed together the earlier opened first.

    A key's (song, track, channel, note) offs cut its events into gaps; a gap's note-ons meet the off
    that ends it. One that opened on an earlier tick closes there. One of the same tick stays open if
    that off closes anything else, and then closes at the next off if that one's tick differs; else it
    is gone. An off closes something if its gap has an earlier note-on (some), or if a note stayed
    open at the off before (carries): whether one did is settled by the latest off that has a note-on
    of its own tick and closes something by itself, or that has none or shares its tick with the off
    before. So windows and one aggregate replace a walk through the track."""
    rows = program_in_force(events).where(F.col("type").isin("note_on", "note_off"))
    key = ["song", "track", "channel", "note"]
    velocity = F.coalesce(F.col("velocity"), F.lit(0)).cast("int")
    rows = rows.select(*key, "idx", F.col("tick").cast("long").alias("tick"), velocity.alias("velocity"), "in_force", ((F.col("type") == "note_on") & (velocity > 0)).alias("on"))
    earlier = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("gap", F.coalesce(F.sum((~F.col("on")).cast("int")).over(earlier), F.lit(0)))
    opened, off = F.when(F.col("on"), F.col("tick")), F.when(~F.col("on"), F.struct("tick", "idx", "in_force"))
    ons = F.collect_list(F.when(F.col("on"), F.struct("idx", "tick", "velocity")))
    gaps = rows.groupBy(*key, "gap").agg(F.min(opened).alias("least"), F.max(opened).alias("last"), F.max(off).alias("off"), ons.alias("ons")).where(F.col("off").isNotNull())
    by_gap = Window.partitionBy(*key).orderBy("gap")
    some = F.coalesce(F.col("least") < F.col("off.tick"), F.lit(False))
    same = F.coalesce(F.col("last") == F.col("off.tick"), F.lit(False))
    apart = F.coalesce(F.lag("off.tick").over(by_gap) != F.col("off.tick"), F.lit(False))
    gaps = gaps.withColumns({"some": some, "same": same, "apart": apart, "next_off": F.lead("off").over(by_gap)})
    settled = F.when(F.col("same") & F.col("some"), True).when(~(F.col("same") & F.col("apart")), False)
    carries = F.coalesce(F.last(settled, ignorenulls=True).over(by_gap.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    closed = gaps.withColumn("carries", carries).select(*key, "off", "next_off", "carries", F.inline("ons"))
    later = F.when(F.col("carries") & (F.col("next_off.tick") != F.col("tick")), F.col("next_off"))
    closed = closed.withColumn("end", F.when(F.col("tick") != F.col("off.tick"), F.col("off")).otherwise(later)).where(F.col("end").isNotNull())
    order = Window.partitionBy("song", "track").orderBy("end.idx", "idx")
    return closed.select(
        F.col("song").cast("long").alias("song"), *[F.col(c).cast("int").alias(c) for c in ("track", "channel", "note", "velocity")],
        F.col("end.in_force").cast("int").alias("program"), F.col("tick").alias("on_tick"), F.col("end.tick").alias("off_tick"), (F.row_number().over(order) - 1).alias("seq"),
    )


def instruments(notes: DataFrame) -> DataFrame:
    """(song, program, channel, track, is_drum, rank): instruments in the order of their first
    closed note; channel 9 is drums."""
    first = notes.groupBy("song", "program", "channel", "track").agg(F.min(F.struct("off_tick", "track", "seq")).alias("first"))
    order = Window.partitionBy("song").orderBy(F.col("first.track"), F.col("first.seq"))
    return first.select("song", "program", "channel", "track", (F.col("channel") == 9).alias("is_drum"), (F.row_number().over(order) - 1).alias("rank"))


def note_table(notes: DataFrame, resolution: int, beat_div: int = 4) -> DataFrame:
    """note(song, track, program, is_drum, pitch, velocity, start, end, seq) at a constant tempo:
    track is the instrument's rank, seq the arrival order."""
    keyed = notes.join(instruments(notes), ["song", "program", "channel", "track"])
    order = Window.partitionBy("song").orderBy("rank", "seq")
    return keyed.select(
        "song", F.col("rank").alias("track"), "program", "is_drum", F.col("note").alias("pitch"), "velocity",
        constant_clock(F.col("on_tick"), resolution, beat_div).alias("start"), constant_clock(F.col("off_tick"), resolution, beat_div).alias("end"),
        F.row_number().over(order).alias("seq"),
    )


def bound_controls(events: DataFrame, notes: DataFrame, types: tuple[str, ...] = ("pitchwheel", "control_change")) -> DataFrame:
    """Pitch bends and control changes with the instrument they belong to: the one of the program
    in force if it exists by then, else the first instrument of the track and channel that comes
    after; without any, they are left out."""
    made = notes.groupBy("song", "track", "channel", "program").agg(F.min(F.struct("off_tick", "seq")).alias("made"))
    taken = program_in_force(events).where(F.col("type").isin(*types)).withColumnRenamed("in_force", "wanted")
    mine = made.select("song", "track", "channel", F.col("program").alias("wanted"), F.col("made.off_tick").alias("mine"))
    after = made.select("song", "track", "channel", F.col("program").alias("later"), F.col("made.off_tick").alias("at"))
    keys = ["song", "track", "channel", "idx"]
    straggler = (
        taken.select(*keys, "tick").join(after, ["song", "track", "channel"]).where(F.col("at") >= F.col("tick"))
        .groupBy(*keys).agg(F.min_by("later", "at").alias("next_program"))
    )
    joined = taken.join(mine, ["song", "track", "channel", "wanted"], "left").join(straggler, keys, "left")
    program = F.when(F.col("mine") <= F.col("tick"), F.col("wanted")).otherwise(F.col("next_program"))
    return joined.withColumn("bound_program", program).where(F.col("bound_program").isNotNull()).drop("wanted", "mine", "next_program")


def song_meta(events: DataFrame) -> DataFrame:
    """(song, kind, tick, track, idx, numerator, denominator, key, text): key and time signatures of
    track 0, lyrics, texts and markers of all tracks, merged by (tick, track, idx)."""
    kind = F.col("type")
    signatures = kind.isin("key_signature", "time_signature") & (F.col("track") == 0)
    rows = events.where(signatures | kind.isin(*TEXT_TYPES))
    return rows.select("song", kind.alias("kind"), "tick", "track", "idx", "numerator", "denominator", "key", "text").orderBy("song", "tick", "track", "idx")


def first_meta(events: DataFrame) -> DataFrame:
    """(song, type, first_idx, first_tick) of each song's tempo and signature events."""
    meta = events.where(F.col("type").isin(*TRACK0_TYPES))
    return meta.groupBy("song", "type").agg(F.min("idx").alias("first_idx"), F.min_by("tick", "idx").alias("first_tick"))


