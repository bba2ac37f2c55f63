"""Queries over the surrogate events: ticks, programs, note pairs, tempo, time maps, beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.order import tasks_for
from notewright.operators import events, gates, timing
from notewright.plans.base import Registry, with_views
from notewright.sources.surrogates import midi_events, table

R = Registry()
#: Moves values off the ties of rounding, where the last bit of a sum would decide.
NUDGE = 0.0000017

EVENTS = """
ev AS (
  SELECT user_id AS song, 0 AS track, 0 AS channel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx,
         CASE event_type WHEN 'click' THEN 'note_on' WHEN 'view' THEN 'note_off' WHEN 'signup' THEN 'program_change' WHEN 'error' THEN 'set_tempo' WHEN 'purchase' THEN 'time_signature' END AS type,
         k % 4 AS note, k AS program, value AS tempo, epoch_us(ts) AS tick
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""
IN_FORCE = """
forced AS (
  SELECT *, coalesce(last_value(CASE WHEN type = 'program_change' THEN program END IGNORE NULLS) OVER (PARTITION BY song ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS in_force FROM ev)
"""
PAIRS = """
pairs AS (
  SELECT song, track, channel, note, tick AS on_tick, program_off AS program, off_tick
  FROM (SELECT *, first_value(CASE WHEN type = 'note_off' THEN tick END IGNORE NULLS) OVER f AS off_tick,
               first_value(CASE WHEN type = 'note_off' THEN in_force END IGNORE NULLS) OVER f AS program_off
        FROM forced WHERE type IN ('note_on', 'note_off')
        WINDOW f AS (PARTITION BY song, note ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  WHERE type = 'note_on' AND off_tick IS NOT NULL)
"""


@R.add("abs_ticks", with_views(EVENTS, then="SELECT song, idx, CAST(sum(d) OVER (PARTITION BY song ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tick FROM (SELECT song, idx, CASE WHEN delta > 2147483647 THEN 0 ELSE delta END AS d FROM (SELECT song, idx, coalesce(tick - lag(tick) OVER (PARTITION BY song ORDER BY idx), 0) AS delta FROM ev))"))
def abs_ticks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = midi_events(spark, sf)
    delta = F.coalesce(F.col("tick") - F.lag("tick").over(Window.partitionBy("song").orderBy("idx")), F.lit(0))
    out = events.absolute_ticks(rows.withColumn("dtick", delta).drop("tick"))
    return out.select("song", F.col("idx").cast("long").alias("idx"), "tick")


@R.add("program_asof", with_views(EVENTS, IN_FORCE, then="SELECT song, idx, in_force FROM forced"))
def program_asof(spark: SparkSession, sf: str) -> DataFrame:
    return events.program_in_force(midi_events(spark, sf)).select("song", F.col("idx").cast("long").alias("idx"), "in_force")


@R.add("note_pairs", with_views(EVENTS, IN_FORCE, PAIRS, then="SELECT * FROM pairs"))
def note_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return events.next_off_pairs(midi_events(spark, sf))


@R.add("note_pairs_fold", with_views(EVENTS, IN_FORCE, PAIRS, then="SELECT song, note, program, on_tick, off_tick FROM pairs"))
def note_pairs_fold(spark: SparkSession, sf: str) -> DataFrame:
    out = events.paired_notes(midi_events(spark, sf).withColumn("velocity", F.lit(64)))
    return out.select("song", "note", "program", "on_tick", "off_tick")


@R.add("instrument_order", with_views(EVENTS, IN_FORCE, PAIRS, then="SELECT song, program, CAST(row_number() OVER (PARTITION BY song ORDER BY first_off, first_on) - 1 AS INTEGER) AS rank FROM (SELECT song, program, min(off_tick) AS first_off, arg_min(on_tick, off_tick) AS first_on FROM pairs GROUP BY song, program)"))
def instrument_order(spark: SparkSession, sf: str) -> DataFrame:
    return events.instruments(events.paired_notes(midi_events(spark, sf).withColumn("velocity", F.lit(64)))).select("song", "program", "rank")


@R.add("meta_first", with_views(EVENTS, then="SELECT song, type, min(idx) AS first_idx, arg_min(tick, idx) AS first_tick FROM ev WHERE type IN ('set_tempo', 'time_signature') GROUP BY song, type"))
def meta_first(spark: SparkSession, sf: str) -> DataFrame:
    return events.first_meta(midi_events(spark, sf)).withColumn("first_idx", F.col("first_idx").cast("long"))


@R.add("track_names", with_views(EVENTS, then="SELECT song, idx, coalesce(last_value(CASE WHEN type = 'program_change' THEN 'n' || program END IGNORE NULLS) OVER (PARTITION BY song ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS track_name FROM ev"))
def track_names(spark: SparkSession, sf: str) -> DataFrame:
    """Program changes stand for names."""
    rows = midi_events(spark, sf).withColumns({"type": F.when(F.col("type") == "program_change", "track_name").otherwise(F.col("type")), "text": F.concat(F.lit("n"), "program")})
    return events.track_names(rows).select("song", F.col("idx").cast("long").alias("idx"), "track_name")


META = """
meta AS (
  SELECT song, CASE type WHEN 'set_tempo' THEN 'marker' WHEN 'note_off' THEN 'key_signature' ELSE type END AS kind, tick, CAST(idx % 2 AS INTEGER) AS track, idx,
         note AS numerator, CASE type WHEN 'note_off' THEN 'C' END AS key, CASE type WHEN 'set_tempo' THEN 'm' || program END AS text FROM ev)
"""


@R.add("song_meta", with_views(EVENTS, META, then="SELECT song, kind, tick, track, idx, numerator, key, text FROM meta WHERE kind IN ('lyrics', 'text', 'marker') OR (kind IN ('key_signature', 'time_signature') AND track = 0)"))
def song_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Tempo events stand for markers and note-offs for keys, dealt to two tracks."""
    kind = F.col("type")
    rows = midi_events(spark, sf).select(
        "song", "tick", "idx", F.when(kind == "set_tempo", "marker").when(kind == "note_off", "key_signature").otherwise(kind).alias("type"),
        (F.col("idx") % 2).alias("track"), F.col("note").alias("numerator"), F.lit(4).alias("denominator"),
        F.when(kind == "note_off", "C").alias("key"), F.when(kind == "set_tempo", F.concat(F.lit("m"), "program")).alias("text"),
    )
    return events.song_meta(rows).drop("denominator").withColumn("idx", F.col("idx").cast("long"))


BOUND = """
made AS (SELECT song, program, min(off_tick) AS made FROM pairs GROUP BY song, program),
bound AS (
  SELECT t.song, t.idx, CASE t.type WHEN 'set_tempo' THEN 'pitchwheel' ELSE 'control_change' END AS type,
         CASE WHEN m.made <= t.tick THEN t.in_force ELSE n.program END AS bound_program
  FROM (SELECT * FROM forced WHERE type IN ('set_tempo', 'time_signature')) t
  LEFT JOIN made m ON t.song = m.song AND t.in_force = m.program ASOF LEFT JOIN made n ON t.song = n.song AND t.tick <= n.made)
"""


@R.add("bound_controls", with_views(EVENTS, IN_FORCE, PAIRS, BOUND, then="SELECT * FROM bound WHERE bound_program IS NOT NULL"))
def bound_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Tempo events stand for pitch bends, signatures for control changes."""
    kind = F.col("type")
    rows = midi_events(spark, sf).withColumn("velocity", F.lit(64))
    rows = rows.withColumn("type", F.when(kind == "set_tempo", "pitchwheel").when(kind == "time_signature", "control_change").otherwise(kind))
    bound = events.bound_controls(rows, events.paired_notes(rows))
    return bound.select("song", F.col("idx").cast("long").alias("idx"), "type", F.col("bound_program").cast("int").alias("bound_program"))


RELOCATED = """
SELECT song, CAST(row_number() OVER (PARTITION BY song, moved ORDER BY tick, track, idx) AS INTEGER) AS idx, moved AS track, event_id
FROM (SELECT user_id AS song, event_id, epoch_us(ts) // 1000000000 AS tick, user_id % 3 + event_id % 2 AS track, event_id AS idx,
             CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE user_id % 3 + event_id % 2 END AS moved FROM events)
"""


@R.add("relocate_meta", RELOCATED)
def relocate_meta(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "set_tempo").when(F.col("event_type") == "purchase", "time_signature").otherwise("note_on")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("song"), "event_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000000").alias("tick"),
        (F.col("user_id") % 3 + F.col("event_id") % 2).alias("track"), F.col("event_id").alias("idx"), kind.alias("type"),
    )
    return events.relocated_meta(rows).select("song", "idx", F.col("track").cast("long").alias("track"), "event_id")


@R.add("tempo_drum_gate", with_views(EVENTS, then="SELECT song, count(*) AS changes FROM ev WHERE type = 'set_tempo' AND song IN (SELECT song FROM ev WHERE type = 'note_on' AND note = 3) GROUP BY song HAVING count(*) > 3"))
def tempo_drum_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = midi_events(spark, sf)
    return gates.tempo_drum_gate(rows.where("type = 'set_tempo'"), rows.where("type = 'note_on' AND note = 3").select("song").distinct())


@R.add("corrupt_guard", "SELECT l_suppkey AS song, max(l_orderkey * 100) AS last_tick FROM lineitem GROUP BY 1 HAVING max(l_orderkey * 100) + 1 > 1499000")
def corrupt_guard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("song"), (F.col("l_orderkey") * 100).alias("tick"))
    return events.corrupt_songs(rows, 1_499_000)


@R.add("constant_clock", with_views(EVENTS, then="SELECT song, idx, round((tick % 1000000) * 4 / 480.0::DOUBLE, 6) AS time FROM ev"))
def constant_clock(spark: SparkSession, sf: str) -> DataFrame:
    time = events.constant_clock(F.col("tick") % 1_000_000, 480)
    return midi_events(spark, sf).select("song", F.col("idx").cast("long").alias("idx"), F.round(time, 6).alias("time"))


# A tempo is 200,000 + 1,000 * value microseconds; ticks count seconds from 2024 on.
CLOCK = """
ticks AS (SELECT song, idx, type, 200000 + 1000 * tempo AS tempo, tick // 1000000 - 1704067200 AS tick FROM ev),
changes AS (SELECT song, tick, arg_max(tempo, idx) AS tempo FROM ticks WHERE type = 'set_tempo' GROUP BY song, tick),
starts AS (SELECT song, tick, tempo FROM changes UNION ALL SELECT DISTINCT song, 0, 500000 FROM ticks WHERE song NOT IN (SELECT song FROM changes WHERE tick = 0)),
segments AS (
  SELECT *, coalesce(sum(passed) OVER (PARTITION BY song ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seconds
  FROM (SELECT *, (lead(tick) OVER (PARTITION BY song ORDER BY tick) - tick) * (tempo / 1e6 / 480) AS passed FROM starts))
"""


@R.add("tempo_clock", with_views(EVENTS, CLOCK, then="SELECT t.song, idx, round(seconds + (t.tick - s.tick) * (s.tempo / 1e6 / 480) + 0.0000017, 4) AS time FROM ticks t ASOF JOIN segments s ON t.song = s.song AND t.tick >= s.tick"))
def tempo_clock(spark: SparkSession, sf: str) -> DataFrame:
    rows = midi_events(spark, sf).withColumns({"tick": F.expr("tick div 1000000 - 1704067200"), "tempo": 200_000 + 1000 * F.col("tempo")})
    timed = events.tempo_clock(rows, events.tempo_segments(rows, 480))
    return timed.select("song", F.col("idx").cast("long").alias("idx"), F.round(F.col("time") + NUDGE, 4).alias("time"))


ZIPPED = """
p AS (SELECT user_id AS song, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'click'),
s AS (SELECT user_id AS song, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'view')
"""


@R.add("zip_positional", with_views(ZIPPED, then="SELECT p.song, p.nth, p.value AS perf, s.value AS score FROM p JOIN s ON p.song = s.song AND p.nth = s.nth"))
def zip_positional(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumnRenamed("user_id", "song")
    sides = [rows.where(F.col("event_type") == t) for t in ("click", "view")]
    out = timing.zip_positional(*sides, ["song"], "event_id", {"value": ("perf", "score")})
    return out.select("song", F.col("at").cast("long").alias("nth"), "perf", "score")


INTERP = """
anchors AS (SELECT l_suppkey AS song, CAST(l_orderkey AS DOUBLE) AS x, min(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2),
asked AS (SELECT DISTINCT l_suppkey AS song, l_orderkey + 0.5::DOUBLE AS x FROM lineitem),
found AS (
  SELECT a.song, a.x, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy
  FROM asked a ASOF LEFT JOIN anchors b ON a.song = b.song AND a.x >= b.x ASOF LEFT JOIN anchors c ON a.song = c.song AND a.x <= c.x)
"""


@R.add("interp_map", with_views(INTERP, then="SELECT song, x, round(CASE WHEN bx IS NULL THEN cy WHEN cx IS NULL THEN by_ ELSE by_ + (cy - by_) / (cx - bx) * (x - bx) END + 0.0000017, 4) AS y FROM found"))
def interp_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("song"), F.col("l_orderkey").cast("double").alias("key"), F.col("l_extendedprice").alias("y"))
    anchors = rows.select("song", F.col("key").alias("x"), "y")
    asked = rows.select("song", (F.col("key") + 0.5).alias("x")).distinct()
    return timing.interpolated(asked, anchors, ["song"]).withColumn("y", F.round(F.col("y") + NUDGE, 4))


@R.add("as_of_value", with_views("p AS (SELECT user_id AS song, ts, value FROM events WHERE event_type = 'error')", then="SELECT e.user_id AS song, e.event_id, coalesce(p.value, -1) AS latest FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN p ON e.user_id = p.song AND e.ts >= p.ts"))
def as_of_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumnRenamed("user_id", "song")
    facts = rows.where("event_type = 'error'").select("song", "ts", F.col("value").alias("latest"))
    clicks = rows.where("event_type = 'click'").select("song", "event_id", "ts")
    return timing.as_of(clicks, facts, ["song"], "ts", "latest", F.lit(-1.0)).drop("ts")


# Beats every half second for 128 beats a song; signatures of 3 to 9 on every 32nd beat of some songs.
BEATS = """
beats AS (SELECT s_suppkey AS song, CAST(i AS INTEGER) AS beat_idx, i * 0.5::DOUBLE AS time FROM supplier CROSS JOIN (SELECT unnest(range(0, 128)) AS i)),
given AS (SELECT s_suppkey AS song, (8 + j * 32) * 0.5::DOUBLE AS time, CAST(3 + (s_suppkey + j) % 7 AS INTEGER) AS numerator FROM supplier CROSS JOIN (SELECT unnest(range(0, 3)) AS j) WHERE s_suppkey % 4 <> 0),
spans AS (
  SELECT song, numerator, time AS from_time, lead(time) OVER (PARTITION BY song ORDER BY time) AS until, row_number() OVER (PARTITION BY song ORDER BY time) AS k
  FROM (SELECT * FROM given UNION ALL SELECT s_suppkey, 0.0, 4 FROM supplier)),
placed AS (
  SELECT *, CAST(round(from_time * 2) AS INTEGER) AS start_idx, coalesce(CAST(round(until * 2) AS INTEGER), 128) AS stop_idx,
         CASE WHEN numerator % 3 = 0 AND numerator <> 3 THEN numerator // 3 ELSE numerator END AS stride FROM spans)
"""


@R.add("downbeat_interval", with_views(BEATS, then="SELECT b.song, CAST(k AS INTEGER) AS k, beat_idx, time FROM beats b JOIN placed p ON b.song = p.song AND beat_idx >= start_idx AND beat_idx < stop_idx WHERE (beat_idx - start_idx) % stride = 0"))
def downbeat_interval(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier")
    tasks = tasks_for(suppliers, 128)
    songs = suppliers.select(F.col("s_suppkey").alias("song")).repartition(tasks, "song")
    beats = songs.withColumn("beat_idx", F.explode(F.sequence(F.lit(0), F.lit(127)))).withColumn("time", F.col("beat_idx") * 0.5)
    given = songs.where(F.col("song") % 4 != 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    given = given.select("song", ((8 + F.col("j") * 32) * 0.5).alias("time"), (3 + (F.col("song") + F.col("j")) % 7).cast("int").alias("numerator"))
    return timing.downbeats(beats, given)


# Quarters a minute: 60, 120 from a, 240 from b. Odd songs have signatures of 4/4, 6/8 from c, 3/4 from d.
# The counterpart steps from beat to beat: by one beat's quarters, or to the next signature.
GRID = """
WITH RECURSIVE songs AS (
  SELECT s_suppkey AS song, 5.25::DOUBLE + s_suppkey % 4 AS a, 15.5::DOUBLE + s_suppkey % 3 AS b, 10.0::DOUBLE + s_suppkey % 5 * 0.25 AS c, 20.25::DOUBLE AS d, s_suppkey % 2 = 1 AS metered FROM supplier),
beats AS (
  SELECT song, 0 AS beat_idx, 0.0::DOUBLE AS time FROM songs
  UNION ALL
  SELECT song, beat_idx + 1, CASE WHEN metered AND time < c AND free > c - 1e-6 THEN c WHEN metered AND time < d AND free > d - 1e-6 THEN d ELSE free END
  FROM (
    SELECT *, CASE WHEN q <= a THEN q WHEN q <= 2 * b - a THEN a + (q - a) / 2 ELSE b + (q - 2 * b + a) / 4 END AS free
    FROM (
      SELECT *, least(time, a) + 2 * greatest(0, least(time, b) - a) + 4 * greatest(0, time - b) + CASE WHEN metered AND time >= c AND time < d THEN 1.5 ELSE 1.0 END AS q
      FROM beats JOIN songs USING (song)))
  WHERE time < 40),
shown AS (SELECT *, metered AND time >= c AND time < d AS compound FROM beats JOIN songs USING (song) WHERE time < 40)
SELECT song, beat_idx, round(time, 6) AS time,
       CASE WHEN beat_idx = 0 THEN -1 ELSE round(CASE WHEN time < a THEN 60 WHEN time < b THEN 120 ELSE 240 END / CASE WHEN compound THEN 1.5::DOUBLE ELSE 1.0 END, 6) END AS bpm,
       CASE WHEN beat_idx = 0 THEN -1 WHEN NOT metered OR time < c THEN 4 WHEN compound THEN 6 ELSE 3 END AS num,
       CASE WHEN beat_idx = 0 THEN -1 WHEN compound THEN 8 ELSE 4 END AS den
FROM shown
"""


@R.add("beat_grid", GRID)
def beat_grid(spark: SparkSession, sf: str) -> DataFrame:
    songs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("song"))
    pair = lambda *x: F.struct(*[c.alias(n) for n, c in zip(("time", "qpm"), x, strict=True)])
    at = lambda base, n, step=1.0: F.lit(base) + F.col("song") % n * step
    tempi = songs.select("song", F.inline(F.array(pair(F.lit(0.0), F.lit(60.0)), pair(at(5.25, 4), F.lit(120.0)), pair(at(15.5, 3), F.lit(240.0)))))
    sign = lambda t, n, d: F.struct(t.alias("time"), F.lit(n).alias("numerator"), F.lit(d).alias("denominator"))
    meters = songs.where("song % 2 = 1").select("song", F.inline(F.array(sign(F.lit(0.0), 4, 4), sign(at(10.0, 5, 0.25), 6, 8), sign(F.lit(20.25), 3, 4))))
    grid = timing.song_beats(tempi, meters, songs.withColumn("end", F.lit(40.0)))
    return grid.withColumns({"time": F.round("time", 6), "bpm": F.round("bpm", 6)})


@R.add("merge_text", "SELECT conv_id, turn, role, CAST(row_number() OVER (ORDER BY turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id) AS INTEGER) AS nth FROM conversations")
def merge_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    lists = [rows.where(F.col("role") == r) for r in ("system", "user", "assistant")]
    return timing.merged_by_time(lists, "turn", "conv_id").select("conv_id", "turn", "role", F.col("at").alias("nth"))


# An order is a song: its lines change the tempo, its first line (by number) gives the meter, and it ends
# some seconds after its last change. In one meter a beat is the k-th whole number that the running total
# of beats comes to, so the counterpart inverts that total, segment by segment.
ORDER_BEATS = """
lines AS (
  SELECT l_orderkey AS song, l_linenumber * 3.7::DOUBLE AS time, 10.0::DOUBLE + l_quantity AS qpm, l_linenumber AS nr,
         2 + CAST(l_quantity AS INTEGER) % 8 AS num, CASE WHEN l_returnflag = 'R' THEN 8 ELSE 4 END AS den
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth = 1),
meters AS (SELECT song, arg_min(num, nr) AS num, arg_min(den, nr) AS den, 4.1::DOUBLE + max(time) AS ends FROM lines GROUP BY song),
tempi AS (
  SELECT song, time, qpm FROM lines UNION ALL SELECT song, 0, 120 FROM meters),
segments AS (
  SELECT t.song, num, den, time AS t0, least(coalesce(lead(time) OVER w, ends), ends) AS t1,
         qpm * den / 4 / CASE WHEN num % 3 = 0 AND num <> 3 THEN 3 ELSE 1 END AS bpm
  FROM tempi t JOIN meters m ON t.song = m.song WINDOW w AS (PARTITION BY t.song ORDER BY time)),
totals AS (
  SELECT *, round(sum((t1 - t0) * bpm / 60) OVER (PARTITION BY song ORDER BY t0), 9) AS upto FROM segments),
spans AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY song ORDER BY t0), 0) AS since FROM totals),
order_beats AS (
  SELECT song, num, den, bpm, CAST(k AS INTEGER) AS k, t0 + (k - since) * 60 / bpm AS time
  FROM (SELECT *, unnest(range(CAST(ceil(since) AS BIGINT), CAST(ceil(upto) AS BIGINT))) AS k FROM spans))
"""


#: About how many beats a line gives rise to, for dealing orders to tasks.
LINE_BEATS = 4


def _order_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tempo changes, the meter from 0 on, and the end of each order."""
    from pyspark.sql import Window

    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_quantity", "l_partkey", "l_suppkey")
    read = table(spark, sf, "lineitem")
    lines = read.repartition(tasks_for(read, LINE_BEATS), "l_orderkey").withColumn("nth", F.row_number().over(first)).where("nth = 1").select(
        F.col("l_orderkey").alias("song"), (F.col("l_linenumber") * 3.7).alias("time"), (10.0 + F.col("l_quantity")).alias("qpm"), "l_linenumber",
        (2 + F.col("l_quantity").cast("int") % 8).alias("numerator"), F.when(F.col("l_returnflag") == "R", 8).otherwise(4).alias("denominator"),
    )
    meters = lines.groupBy("song").agg(*[F.min_by(c, "l_linenumber").alias(c) for c in ("numerator", "denominator")]).withColumn("time", F.lit(0.0))
    return lines.select("song", "time", "qpm"), meters, lines.groupBy("song").agg((4.1 + F.max("time")).alias("end"))


@R.add("order_beats", with_views(ORDER_BEATS, then="SELECT song, k AS beat_idx, round(time + 0.0000017::DOUBLE, 5) AS time, CASE WHEN k = 0 THEN -1 ELSE round(bpm, 5) END AS bpm, CASE WHEN k = 0 THEN -1 ELSE num END AS num, CASE WHEN k = 0 THEN -1 ELSE den END AS den FROM order_beats"))
def order_beats(spark: SparkSession, sf: str) -> DataFrame:
    return timing.song_beats(*_order_lines(spark, sf)).withColumns({"time": F.round(F.col("time") + NUDGE, 5), "bpm": F.round("bpm", 5)})


@R.add("order_downbeats", with_views(ORDER_BEATS, then="SELECT song, 1 AS k, k AS beat_idx, round(time + 0.0000017::DOUBLE, 5) AS time FROM order_beats b WHERE b.k % CASE WHEN num % 3 = 0 AND num <> 3 THEN num // 3 ELSE num END = 0"))
def order_downbeats(spark: SparkSession, sf: str) -> DataFrame:
    tempi, meters, ends = _order_lines(spark, sf)
    beats = timing.song_beats(tempi, meters, ends)
    return timing.downbeats(beats, meters).withColumn("time", F.round(F.col("time") + NUDGE, 5))


# Lines are events whose ticks often coincide; the counterpart walks through a key's events one by one.
TIES = """
WITH RECURSIVE events AS (
  SELECT l_suppkey AS song, l_linenumber % 2 AS track, l_linenumber % 3 AS channel, 60 + l_partkey % 5 AS note, CAST(tick AS BIGINT) AS tick, sounds, CAST(l_quantity AS INTEGER) % 100 AS velocity,
         row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2 ORDER BY tick, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx
  FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 40 AS tick, l_orderkey % 2 = 0 AS sounds FROM lineitem)),
keyed AS (SELECT *, row_number() OVER (PARTITION BY song, track, channel, note ORDER BY idx) AS i FROM events),
walk AS (
  SELECT DISTINCT song, track, channel, note, 0::BIGINT AS i, []::STRUCT(idx BIGINT, tick BIGINT, velocity INTEGER)[] AS sounding,
         []::STRUCT(idx BIGINT, tick BIGINT, velocity INTEGER)[] AS closed, 0::BIGINT AS tick, 0::BIGINT AS since FROM keyed
  UNION ALL
  SELECT k.song, k.track, k.channel, k.note, k.i,
         CASE WHEN sounds THEN list_append(sounding, {'idx': k.idx, 'tick': k.tick, 'velocity': k.velocity})
              WHEN len(list_filter(sounding, lambda x: x.tick < k.tick)) > 0 THEN list_filter(sounding, lambda x: x.tick = k.tick) ELSE [] END,
         CASE WHEN sounds THEN [] ELSE list_filter(sounding, lambda x: x.tick < k.tick) END, k.tick, k.idx
  FROM walk w JOIN keyed k ON w.song = k.song AND w.track = k.track AND w.channel = k.channel AND w.note = k.note AND k.i = w.i + 1),
ended AS (SELECT song, track, channel, note, tick, since, unnest(closed) AS c FROM walk)
SELECT song, CAST(track AS INTEGER) AS track, CAST(channel AS INTEGER) AS channel, CAST(note AS INTEGER) AS note, c.velocity AS velocity, 0 AS program, c.tick AS on_tick, tick AS off_tick,
       CAST(row_number() OVER (PARTITION BY song, track ORDER BY since, c.idx) - 1 AS INTEGER) AS seq
FROM ended
"""


@R.add("note_pairs_ties", TIES)
def note_pairs_ties(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    tick = F.expr("datediff(cast(l_shipdate as date), date'1992-01-01') div 40")
    lines = table(spark, sf, "lineitem")
    rows = lines.repartition(tasks_for(lines), "l_suppkey").withColumns({"tick": tick, "track": F.col("l_linenumber") % 2})
    order = Window.partitionBy("l_suppkey", "track").orderBy("tick", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    sounds = F.col("l_orderkey") % 2 == 0
    made = rows.select(
        F.col("l_suppkey").alias("song"), "track", (F.row_number().over(order) - 1).alias("idx"), F.when(sounds, "note_on").otherwise("note_off").alias("type"),
        (F.col("l_linenumber") % 3).alias("channel"), (60 + F.col("l_partkey") % 5).alias("note"), F.when(sounds, F.col("l_quantity").cast("int") % 100).alias("velocity"),
        F.lit(None).cast("int").alias("program"), "tick",
    )
    return events.paired_notes(made)
