"""The time layer: positional zips, interpolation, beat grids, downbeats, merges by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.music import close_to
from notewright.functions.order import global_index, next_value, prior_value


def zip_positional(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Pairs the n-th row of left with the n-th of right within keys, as long as both last. columns
    maps a column to its names on the left and on the right."""
    at = Window.partitionBy(*keys).orderBy(order)
    sides = [
        frame.select(*keys, F.row_number().over(at).alias("at"), *[F.col(c).alias(names[i]) for c, names in columns.items()])
        for i, frame in enumerate((left, right))
    ]
    return sides[0].join(sides[1], [*keys, "at"])


def time_map(perf: DataFrame, score: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, perf_time, score_time) of notes paired by position; of equal performance times the
    first pair stays."""
    pairs = zip_positional(perf, score, keys, order, {"start": ("perf_time", "score_time")})
    return pairs.groupBy(*keys, "perf_time").agg(F.min_by("score_time", "at").alias("score_time"))


def interpolated(queries: DataFrame, anchors: DataFrame, keys: list[str], x: str = "x", ax: str = "x", ay: str = "y") -> DataFrame:
    """Adds y: linear interpolation of the anchors at x, held constant outside them.

    Queries and anchors are merged in order of x; one pass up and one pass down give each query its
    neighbours, in time linear in the rows. Of anchors with equal x the one of smaller y counts."""
    unique = anchors.groupBy(*keys, F.col(ax).alias("at_x")).agg(F.min(ay).alias("at_y"))
    marks = unique.select(*keys, F.col("at_x").alias("merge_x"), F.struct("at_x", "at_y").alias("anchor"))
    both = queries.withColumns({"merge_x": F.col(x), "is_query": F.lit(1)}).unionByName(marks.withColumn("is_query", F.lit(0)), allowMissingColumns=True)
    order = ["merge_x", "is_query"]
    both = both.withColumns({"before": prior_value("anchor", keys, order), "after": next_value("anchor", keys, order)}).where("is_query = 1")
    width = F.col("after.at_x") - F.col("before.at_x")
    slope = F.try_divide(F.col("after.at_y") - F.col("before.at_y"), width)
    y = (
        F.when(F.col("before").isNull(), F.col("after.at_y"))
        .when(F.col("after").isNull(), F.col("before.at_y"))
        .otherwise(F.col("before.at_y") + slope * (F.col(x) - F.col("before.at_x")))
    )
    return both.withColumn("y", y).drop("merge_x", "is_query", "anchor", "before", "after")


def as_of(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, value: str, default: Column | None = None) -> DataFrame:
    """Adds value: that of the latest fact at or before the row's time, else default."""
    marks = facts.select(*keys, at, F.struct(value).alias("fact"), F.lit(0).alias("is_row"))
    both = rows.withColumn("is_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "is_row").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("fact", ignorenulls=True).over(order)[value]
    both = both.withColumn(value, found if default is None else F.coalesce(found, default))
    return both.where("is_row = 1").drop("is_row", "fact")


def beats_per_minute(qpm: Column, numerator: Column, denominator: Column) -> Column:
    """Quarter notes a minute to beats a minute: a compound meter's beat is three of its notes. Without
    a meter a beat is a quarter."""
    notes = qpm * denominator / 4
    compound = (numerator % 3 == 0) & (numerator != 3)
    return F.when(numerator.isNull(), qpm).otherwise(F.when(compound, notes / 3).otherwise(notes))


def _anchors(signatures: DataFrame, ends: DataFrame, start: float) -> DataFrame:
    """(song, time, numerator, denominator, k, next_at): where beats are counted from anew, that is at start, in
    the meter in force there (else the first to come), and at every later signature."""
    meters = signatures.select("song", F.col("time").cast("double").alias("time"), F.col("numerator").cast("int").alias("numerator"), F.col("denominator").cast("int").alias("denominator"))
    meter = F.struct("time", "numerator", "denominator")
    past = F.col("time") <= start
    found = meters.groupBy("song").agg(F.max(F.when(past, meter)).alias("held"), F.min(F.when(~past, meter)).alias("next"))
    held = F.coalesce("held", "next")
    first = ends.join(found, "song", "left").select("song", F.lit(start).alias("time"), held["numerator"].alias("numerator"), held["denominator"].alias("denominator"))
    order = Window.partitionBy("song").orderBy("time", "given", "numerator", "denominator")
    later = meters.where(~past).join(ends.select("song"), "song", "left_semi").withColumn("given", F.lit(1))
    return first.withColumn("given", F.lit(0)).unionByName(later).withColumns({"k": F.row_number().over(order), "next_at": F.lead("time").over(order)}).drop("given")


def song_beats(tempi: DataFrame, signatures: DataFrame, ends: DataFrame, start: float = 0.0) -> DataFrame:
    """beat(song, beat_idx, time, bpm, num, den): all beats from start to before the song's end.

    tempi(song, time, qpm), 120 before the first; signatures(song, time, numerator, denominator);
    ends(song, end). Anchors (see _anchors) and tempo changes cut a song into segments of one rate. A
    running total of the segments' beat fractions, from anchor to anchor, gives the beats that fall
    into each segment, so a beat that crosses a tempo change is spent in parts. A beat that an anchor
    cuts short, or that is close to one, gives way to it. bpm and meter are those in force from the
    beat on; the first row has -1 for all but its time. Windows of a song; nothing is folded."""
    song = F.col("song").cast("long").alias("song")
    ends = ends.select(song, F.col("end").cast("double").alias("end"))
    anchors = _anchors(signatures.withColumn("song", song), ends, start)
    given = tempi.select(song, F.col("time").cast("double").alias("time"), F.col("qpm").cast("double").alias("qpm"))
    changes = given.unionByName(ends.select("song", F.lit(float("-inf")).alias("time"), F.lit(120.0).alias("qpm")))
    marks = changes.select("song", "time", "qpm", F.lit(None).cast("struct<k:int,at:double,numerator:int,denominator:int,next_at:double>").alias("anchor"), F.lit(0).alias("kind"))
    spans = anchors.select("song", "time", F.lit(None).cast("double").alias("qpm"), F.struct("k", F.col("time").alias("at"), "numerator", "denominator", "next_at").alias("anchor"), F.col("k").alias("kind"))
    by_time = Window.partitionBy("song").orderBy("time", "kind", "qpm")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        marks.unionByName(spans).join(ends, "song")
        .withColumns({"qpm": F.last("qpm", ignorenulls=True).over(so_far), "anchor": F.last("anchor", ignorenulls=True).over(so_far)})
        .withColumn("until", F.least(F.coalesce(F.lead("time").over(by_time), F.col("end")), F.col("end")))
        .where(F.col("anchor").isNotNull() & (F.col("time") < F.col("end")))
        .select("song", "time", "until", F.col("kind").alias("kind"), "qpm", "end", *[F.col(f"anchor.{c}").alias(c) for c in ("k", "at", "numerator", "denominator", "next_at")])
        .withColumn("bpm", beats_per_minute(F.col("qpm"), F.col("numerator"), F.col("denominator")))
    )
    in_span = Window.partitionBy("song", "k").orderBy("time", "kind", "qpm")
    total = F.sum((F.col("until") - F.col("time")) * F.col("bpm") / 60).over(in_span.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", F.round(total, 9)).withColumn("since", F.coalesce(F.lag("upto").over(in_span), F.lit(0.0)))
    rows = rows.where(F.ceil("since") < F.ceil("upto"))
    beats = rows.withColumn("n", F.explode(F.sequence(F.ceil("since"), F.ceil("upto") - 1)))
    beats = beats.withColumn("beat", F.when(F.col("n") == 0, F.col("at")).otherwise(F.col("time") + (F.col("n") - F.col("since")) * 60 / F.col("bpm")))
    beats = beats.where((F.col("n") == 0) | F.col("next_at").isNull() | ~close_to(F.col("beat"), F.col("next_at")))
    index = (F.row_number().over(Window.partitionBy("song").orderBy("beat", "k", "n")) - 1).alias("beat_idx")
    numbered = beats.where(F.col("beat") < F.col("end")).select("song", index, F.col("beat").alias("time"), "bpm", "numerator", "denominator")
    shown = lambda c, default: F.when(F.col("beat_idx") == 0, -1).otherwise(F.coalesce(F.col(c), F.lit(default)))
    return numbered.select("song", "beat_idx", "time", shown("bpm", 0.0).cast("double").alias("bpm"), shown("numerator", 4).alias("num"), shown("denominator", 4).alias("den"))


def _later(value: str, order: Window) -> Column:
    """The first value that is not null in the rows after the row, in the order."""
    return F.expr(f"lead({value}, 1) IGNORE NULLS").over(order)


def downbeats(beats: DataFrame, signatures: DataFrame, start: float = 0.0) -> DataFrame:
    """(song, k, beat_idx, time): beats from each signature to the next, every numerator-th, or every
    third of it in compound meters.

    A 4/4 signature is assumed at start where none begins there. A span begins at the first beat
    close to its signature, else at the first beat, or for the last signature where the span
    before ends. Each span lists its own beats' indexes, so no span meets a beat that isn't its own. Indexes
    count a song's beats from 0. Beats and signatures are merged by time, then beats and lists by index: beats are
    made once, and where both are dealt by song nothing is dealt anew."""
    song = Window.partitionBy("song")
    implied = F.explode(F.when(F.col("beat_idx") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = beats.select("song", F.col("time").cast("double").alias("time"), F.col("beat_idx").cast("int").alias("idx"), implied.alias("implied"))
    own = lambda c, other: F.when(F.col("implied"), other).otherwise(c)
    rows = rows.select(
        "song", own(F.col("time"), F.lit(start)).alias("at"), own(F.col("idx"), F.lit(None)).alias("idx"), own(F.lit(None), -1).cast("int").alias("given"), own(F.lit(None), 4).cast("int").alias("numerator")
    )
    marks = signatures.select("song", F.col("time").cast("double").alias("at"), F.lit(None).cast("int").alias("idx"), F.lit(0).alias("given"), F.col("numerator").cast("int").alias("numerator"))
    is_mark = F.col("given").isNotNull()
    rows = rows.unionByName(marks).withColumns({"first": F.min(F.when(F.col("given") == 0, F.col("at"))).over(song), "n_beats": F.max("idx").over(song) + 1})
    rows = rows.where(~is_mark | (F.col("given") == 0) | F.col("first").isNull() | (F.col("first") > start)).withColumn("beat_at", F.when(~is_mark, F.col("at")))
    by_time = song.orderBy("at", is_mark, "given")
    upto, before = by_time.rowsBetween(Window.unboundedPreceding, 0), by_time.rowsBetween(Window.unboundedPreceding, -1)
    # Of a mark: the beat close to it, found among its two neighbours; then its number, what the next one has, and where the one before ends.
    sides = {f"{c}_{side}": what(c) for c in ("idx", "beat_at") for side, what in (("before", lambda c: F.last(c, ignorenulls=True).over(upto)), ("after", lambda c: _later(c, by_time)))}
    near = lambda side: F.when(close_to(F.col(f"beat_at_{side}"), F.col("at")), F.col(f"idx_{side}"))
    rows = rows.withColumns(sides).withColumn("mark", F.when(is_mark, F.struct(F.coalesce(near("before"), near("after")).alias("here")))).drop(*sides, "beat_at", "first")
    rows = rows.withColumns({"k": F.sum(is_mark.cast("int")).over(upto).cast("int"), "next": _later("mark", by_time)})
    is_last, begin = F.col("next").isNull(), F.coalesce("mark.here", F.lit(0))
    rows = rows.withColumn("ends", F.when(is_mark & ~is_last, F.coalesce("next.here", begin)))
    rows = rows.withColumn("ended", F.coalesce(F.last("ends", ignorenulls=True).over(before), F.lit(0)))
    begin = F.when(is_last, F.coalesce("mark.here", "ended")).otherwise(begin)
    compound = (F.col("numerator") % 3 == 0) & (F.col("numerator") != 3)
    stride = F.when(compound, F.expr("numerator div 3")).otherwise(F.col("numerator")).cast("int")
    stop = F.coalesce("ends", "n_beats")
    listed = F.when(~is_mark, F.array("idx")).when(begin < stop, F.sequence(begin, stop - 1, stride))
    rows = rows.select("song", F.when(is_mark, F.col("k")).alias("k"), F.when(~is_mark, F.col("at")).alias("at"), "idx", F.explode(listed).alias("beat_idx"))
    by_index = song.orderBy("beat_idx", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(by_index)
    found = rows.withColumns({"time": last("at"), "idx": last("idx")}).where(F.col("k").isNotNull() & (F.col("idx") == F.col("beat_idx")) & (F.col("time") >= start))
    return found.select("song", "k", "beat_idx", "time")


def merged_by_time(frames: list[DataFrame], time: str, tie: str) -> DataFrame:
    """Union of sorted lists in order of time, ties by list: adds list and at."""
    out = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn("list", F.lit(i))
        out = frame if out is None else out.unionByName(frame)
    return global_index(out, [time, "list", tie], "at").withColumn("at", (F.col("at") + 1).cast("int"))
