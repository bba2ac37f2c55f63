"""Queries over the surrogate notes: buckets, gates, selectors, rolls, corpus and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.music import PAD, duration_index, recoded_program, step_of
from notewright.operators import corpus, gates, rolls, sampling, selectors
from notewright.plans.base import CAP, RANKS, STEPS, NOTES, DENSITY, Registry, on_notes, on_roll, on_steps, on_tracks, unit, with_views
from notewright.sources.surrogates import notes, table

R = Registry()
KEYS = ("song", "seq")
#: Seeds as SQL literals.
CROP, SHIFT, MASK_N, MASK, DROP, DROPOUT, DRAW = ("'crop'", "'shift'", "'maskn'", "'mask'", "'drop'", "'dropout'", "'draw'")


@R.add("half_even_onset", on_notes("SELECT song, seq, start, CAST(round_even(start, 0) AS INTEGER) AS step FROM notes"))
def half_even_onset(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(*KEYS, "start", step_of(F.col("start")).alias("step"))


@R.add("duration_bucket", on_steps("SELECT song, seq, end_step - step AS subbeats, dur FROM steps"))
def duration_bucket(spark: SparkSession, sf: str) -> DataFrame:
    n = step_of(F.col("end")) - step_of(F.col("start"))
    rows = notes(spark, sf).where(step_of(F.col("start")) >= 0)
    return rows.select(*KEYS, n.alias("subbeats"), duration_index(n).alias("dur"))


@R.add("drum_recode", on_notes("SELECT song, seq, is_drum, CASE WHEN is_drum THEN 127 ELSE program END AS program FROM notes"))
def drum_recode(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(*KEYS, "is_drum", recoded_program(F.col("program"), F.col("is_drum")).alias("program"))


@R.add("time_range", on_notes("SELECT n.song, seq, CAST(round_even(start, 0) AS INTEGER) AS step FROM notes n JOIN (SELECT song, CAST(floor(max(\"end\")) AS INTEGER) AS length FROM notes GROUP BY song) l ON n.song = l.song WHERE round_even(start, 0) >= 0 AND round_even(start, 0) < length"))
def time_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = notes(spark, sf)
    return rolls.quantised(rows, gates.end_steps(rows)).select(*KEYS, "step")


@R.add("fixed_length", on_notes("SELECT song, seq, CAST(round_even(start, 0) AS INTEGER) AS step FROM notes WHERE round_even(start, 0) >= 0 AND round_even(start, 0) < 64"))
def fixed_length(spark: SparkSession, sf: str) -> DataFrame:
    rows = notes(spark, sf)
    return rolls.quantised(rows, gates.end_steps(rows, 64)).select(*KEYS, "step")


@R.add("quant_histogram", on_notes("SELECT song, track, ((s % 4) + 4) % 4 AS subbeat, count(*) AS n FROM (SELECT *, CAST(round_even(start, 0) AS INTEGER) AS s FROM notes) GROUP BY 1, 2, 3"))
def quant_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return gates.onset_histogram(notes(spark, sf))


@R.add("quant_score", on_tracks("SELECT song, score FROM scores"))
def quant_score(spark: SparkSession, sf: str) -> DataFrame:
    return gates.quantisation_scores(notes(spark, sf))


@R.add("quant_gate", on_tracks("SELECT song, score FROM scores WHERE score <= 0.45 OR (score > 0.65 AND score < 1.0)"))
def quant_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.quantisation_gate(notes(spark, sf))


@R.add("track_density", on_tracks("SELECT song, track, density FROM tracks"))
def track_density(spark: SparkSession, sf: str) -> DataFrame:
    return gates.track_density(notes(spark, sf))


GATED = "gated AS (SELECT song, min(density) AS least, max(density) AS most FROM tracks GROUP BY song HAVING count(*) > 1 AND min(density) < 0.7 AND max(density) > 0.8)"


@R.add("density_gate", on_tracks("SELECT song, least, most FROM gated", GATED))
def density_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.density_gate(gates.track_density(notes(spark, sf)))


SIDES = f"""
sides AS (
  SELECT song, track, CASE WHEN nth <= floor({unit("'split0'", "song")} * (tracks - 1)) + 1 THEN 1 ELSE 0 END AS side
  FROM (SELECT song, track, count(*) OVER (PARTITION BY song) AS tracks,
               row_number() OVER (PARTITION BY song ORDER BY {unit("'0'", "song", "track")}, track) AS nth
        FROM (SELECT DISTINCT song, track FROM notes)) WHERE tracks > 1)
"""


def _select(name: str, selector: str, where: str, extra: tuple[str, ...] = (), join: str = "") -> None:
    sql = with_views(NOTES, STEPS, RANKS, *extra, then=f"SELECT r.song, seq, r.track, step FROM ranked r {join} WHERE {where}")

    def query(spark: SparkSession, sf: str) -> DataFrame:
        part = selectors.Selector.parse(selector)
        rows = selectors.with_selector_inputs(notes(spark, sf), [part])
        return rolls.quantised(rows).where(part.column()).select("song", "seq", "track", "step")

    R.add(name, sql)(query)


_GATED = (DENSITY, GATED)
_DENSE = "JOIN tracks t ON r.song = t.song AND r.track = t.track JOIN gated g ON r.song = g.song"
for _args in (
    ("select_all", "all", "true"),
    ("select_empty", "empty", "false"),
    ("select_track", "track-1", "rank = 1"),
    ("select_upto", "upto-1", "rank <= 1"),
    ("select_from", "from-2", "rank >= 2"),
    ("select_notrack", "notrack-3", "rank <> 3"),
    ("select_drum", "drum", "is_drum"),
    ("select_nondrum", "nondrum", "NOT is_drum"),
    ("select_dense", "dense", "density <= 0.75", _GATED, _DENSE),
    ("select_random", "random-1", "side = 1", (SIDES,), "JOIN sides s ON r.song = s.song AND r.track = s.track"),
):
    _select(*_args)


@R.add("select_sparse", with_views(NOTES, STEPS, RANKS, *_GATED, then=f"SELECT r.song, seq, r.track, step FROM ranked r {_DENSE} WHERE density > 0.75"))
def select_sparse(spark: SparkSession, sf: str) -> DataFrame:
    parts = selectors.parse_parts(["dense", "sparse"])
    rows = selectors.with_selector_inputs(notes(spark, sf), parts)
    return rolls.quantised(rows).where(parts[1].column()).select("song", "seq", "track", "step")


@R.add("random_sides", with_views(NOTES, SIDES, then="SELECT song, track, side FROM sides"))
def random_sides(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.random_sides(notes(spark, sf))


@R.add("reject_empty_part", on_notes('SELECT song FROM (SELECT *, floor(max("end") OVER (PARTITION BY song)) AS length FROM notes) WHERE round_even(start, 0) >= 0 AND round_even(start, 0) < length GROUP BY song HAVING bool_or(is_drum) AND bool_or(NOT is_drum)'))
def reject_empty_part(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.build_rolls(notes(spark, sf), dealt=True, selectors=["drum", "nondrum"], cap=CAP, gate=False)[1].select("song")


@R.add("instrument_rank", with_views(NOTES, STEPS, RANKS, then="SELECT DISTINCT song, track, rank FROM ranked"))
def instrument_rank(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.instrument_ranks(notes(spark, sf)).select("song", "track", F.col("rank").cast("long").alias("rank")).distinct()


@R.add("roll_capped", on_steps(f"SELECT song, step, CAST(nth - 1 AS INTEGER) AS slot, program, pitch, dur, velocity FROM (SELECT *, row_number() OVER (PARTITION BY song, step ORDER BY seq) AS nth FROM steps) WHERE nth <= {CAP}"))
def roll_capped(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.capped(rolls.quantised(notes(spark, sf)), F.lit(True), CAP, dedup=False)


@R.add("roll_capped_dedup", on_roll("SELECT song, step, CAST(slot AS INTEGER) AS slot, program, pitch, dur, velocity FROM slots"))
def roll_capped_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.capped(rolls.quantised(notes(spark, sf)), F.lit(True), CAP, dedup=True)


def _roll(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.in_canonical_order(roll_capped_dedup(spark, sf).withColumn("part", F.lit(0))).select(*rolls.ROLL)


MARKERS = f"""
marked AS (
  SELECT song, part, step, slot, program, pitch, dur, velocity FROM roll
  UNION ALL
  SELECT e.song, 0, e.step, coalesce(n, 0), 254, 255, 255, 255
  FROM (SELECT song, CAST(unnest(range(0, length)) AS INTEGER) AS step FROM lengths) e
  LEFT JOIN (SELECT song, step, CAST(count(*) AS INTEGER) AS n FROM roll GROUP BY song, step) c ON e.song = c.song AND e.step = c.step
  WHERE coalesce(n, 0) < {CAP})
"""


@R.add("roll_sorted_with_end", on_roll("SELECT * FROM marked", MARKERS))
def roll_sorted_with_end(spark: SparkSession, sf: str) -> DataFrame:
    marked = rolls.with_end_markers(_roll(spark, sf), gates.end_steps(notes(spark, sf)), 1, CAP)
    return marked.fillna(PAD, ["pitch", "dur", "velocity"])


BUILT_SQL = with_views(
    NOTES,
    STEPS,
    DENSITY,
    "kept AS (SELECT song FROM scores WHERE score <= 0.45 OR (score > 0.65 AND score < 1.0))",
    "lengths AS (SELECT n.song, CAST(floor(max(\"end\")) AS INTEGER) AS length FROM notes n JOIN kept USING (song) GROUP BY n.song)",
    "inside AS (SELECT s.* FROM steps s JOIN lengths l ON s.song = l.song WHERE step < length)",
    "parts AS (SELECT song, step, seq, pitch, is_drum, program, dur, velocity, part, CASE WHEN (part = 0) = is_drum THEN 1 ELSE 0 END AS fills FROM inside CROSS JOIN (SELECT unnest([0, 1]) AS part))",
    "counted AS (SELECT *, coalesce(sum(fills) OVER (PARTITION BY song, part, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM parts)",
    f"room AS (SELECT * FROM counted WHERE used < {CAP})",
    "paired AS (SELECT song FROM room WHERE fills = 1 GROUP BY song HAVING count(DISTINCT part) = 2)",
    then="""
SELECT l.song, any_value(length) AS length, -coalesce(min(CASE WHEN NOT is_drum THEN pitch END), 127) AS shift_min,
       127 - coalesce(max(CASE WHEN NOT is_drum THEN pitch END), 0) AS shift_max, CAST(sum(fills) AS BIGINT) AS slots
FROM room r JOIN paired USING (song) JOIN lengths l ON l.song = r.song GROUP BY l.song
""",
)


@R.add("corpus_drums_nondrum", BUILT_SQL)
def corpus_drums_nondrum(spark: SparkSession, sf: str) -> DataFrame:
    roll, songs = rolls.build_rolls(notes(spark, sf), dealt=True, selectors=["drum", "nondrum"], cap=CAP)
    slots = roll.where("program <> 254").groupBy("song").agg(F.count("*").alias("slots"))
    return songs.join(slots, "song")


@R.add("pitch_shift_range", on_steps(f"SELECT song, -coalesce(min(CASE WHEN NOT is_drum THEN pitch END), 127) AS shift_min, 127 - coalesce(max(CASE WHEN NOT is_drum THEN pitch END), 0) AS shift_max FROM (SELECT *, row_number() OVER (PARTITION BY song, step ORDER BY seq) AS nth FROM steps) WHERE nth <= {CAP} GROUP BY song"))
def pitch_shift_range(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.pitch_shift_range(rolls.with_room(rolls.quantised(notes(spark, sf)), F.lit(True), CAP, dedup=False).where("room"))


LENGTHS = "lengths AS (SELECT song, CAST(floor(max(\"end\")) AS INTEGER) AS length FROM notes GROUP BY song HAVING floor(max(\"end\")) > 0)"
SHIFTS = f"shifts AS (SELECT song, -coalesce(min(CASE WHEN NOT is_drum THEN pitch END), 127) AS lo, 127 - coalesce(max(CASE WHEN NOT is_drum THEN pitch END), 0) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY song, step ORDER BY seq) AS nth FROM steps) WHERE nth <= {CAP} GROUP BY song)"
CLAMPED = "clamped AS (SELECT song, CASE WHEN song % 10 > 1 THEN greatest(lo, -5) ELSE 0 END AS shift_min, CASE WHEN song % 10 > 1 THEN least(hi, 6) ELSE 0 END AS shift_max FROM shifts)"


@R.add("song_lengths", with_views(NOTES, LENGTHS, then="SELECT song, length FROM lengths"))
def song_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return gates.end_steps(notes(spark, sf))


@R.add("song_offsets", with_views(NOTES, LENGTHS, then="SELECT song, length, CAST(coalesce(sum(length) OVER (ORDER BY song ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lengths"))
def song_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.song_offsets(gates.end_steps(notes(spark, sf)))


@R.add("song_index", "SELECT s_name AS relpath, CAST(row_number() OVER (ORDER BY s_name) - 1 AS INTEGER) AS i FROM supplier")
def song_index(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.song_index(table(spark, sf, "supplier").select(F.col("s_name").alias("relpath")))


@R.add("min_length", with_views(NOTES, LENGTHS, then="SELECT song, length FROM lengths WHERE length >= 300"))
def min_length(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.long_enough(gates.end_steps(notes(spark, sf)), 300)


@R.add("split_assign", "SELECT s_suppkey AS song, CASE s_suppkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM supplier")
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("song"), corpus.split_of(F.col("s_suppkey")).alias("split"))


@R.add("shift_clamp", with_views(NOTES, STEPS, SHIFTS, CLAMPED, then="SELECT song, shift_min, shift_max FROM clamped"))
def shift_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.clamped_shifts(pitch_shift_range(spark, sf), corpus.split_of(F.col("song")))


@R.add("skip_existing", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    written = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"))
    return corpus.not_yet_written(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path")), written)


CROPPED = f"cropped AS (SELECT song, length, CAST(floor({unit(CROP, 'song')} * (length - 64)::DOUBLE / 4) * 4 AS INTEGER) AS crop_start FROM lengths WHERE length >= 64)"


@R.add("crop_windows", with_views(NOTES, LENGTHS, CROPPED, then="SELECT song, length, crop_start FROM cropped"))
def crop_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.crop_starts(gates.end_steps(notes(spark, sf)), 64, 4)


@R.add("crop_rows", on_roll("SELECT r.song, part, step - crop_start AS step, slot, program, pitch, dur, velocity FROM roll r JOIN cropped c ON r.song = c.song AND step >= crop_start AND step < crop_start + 64", CROPPED))
def crop_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.crops(_roll(spark, sf), crop_windows(spark, sf), 64)


@R.add("shift_draw", with_views(NOTES, STEPS, SHIFTS, CLAMPED, then=f"SELECT song, CAST(floor({unit(SHIFT, 'song')} * (shift_max - shift_min + 1)) + shift_min AS INTEGER) AS shift FROM clamped"))
def shift_draw(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shift_draws(shift_clamp(spark, sf)).select("song", "shift")


EPOCH = "epoch AS (SELECT s_suppkey AS song, CAST(row_number() OVER (ORDER BY md5('epoch:3:' || CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS INTEGER) AS nth FROM supplier)"


@R.add("epoch_order", with_views(EPOCH, then="SELECT song, nth FROM epoch"))
def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.epoch_order(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("song")), 3)


@R.add("batch_assign", with_views(EPOCH, then="SELECT song, nth, CAST(nth // 8 AS INTEGER) AS batch, nth % 8 AS place FROM epoch"))
def batch_assign(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(epoch_order(spark, sf), 8)


MASK_SQL = with_views(
    f"exact AS (SELECT s_suppkey AS song, least(greatest(CAST(floor(0.3::DOUBLE * 96 / 10 + {unit(MASK_N, 's_suppkey')}) AS INTEGER), 1), 9) AS n FROM supplier)",
    f"picked AS (SELECT song, start FROM (SELECT song, n, start, row_number() OVER (PARTITION BY song ORDER BY {unit(MASK, 'song', 'start')}, start) AS nth FROM exact CROSS JOIN (SELECT unnest(range(0, 87)) AS start)) WHERE nth <= n)",
    then="SELECT DISTINCT song, CAST(start + i AS INTEGER) AS step FROM picked CROSS JOIN (SELECT unnest(range(0, 10)) AS i)",
)


@R.add("span_mask", MASK_SQL)
def span_mask(spark: SparkSession, sf: str) -> DataFrame:
    songs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("song"))
    return sampling.span_masks(songs, 0.3, 10, least=1, size=96)


@R.add("attention_drop", f"SELECT o_orderkey AS q, o_custkey AS k FROM orders WHERE {unit(DROP, 'o_orderkey', 'o_custkey')} >= 0.25")
def attention_drop(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("k"))
    return sampling.attention_drop(pairs, 0.25, ["q", "k"])


@R.add("dropout", f"SELECT o_orderkey, CASE WHEN {unit(DROPOUT, 'o_orderkey')} >= 0.25 THEN o_totalprice / 0.75::DOUBLE ELSE 0.0::DOUBLE END AS value FROM orders")
def dropout(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", sampling.dropout(F.col("o_totalprice"), 0.25, F.col("o_orderkey")).alias("value"))


DRAW_SQL = with_views(
    NOTES,
    "weights AS (SELECT song, pitch, CAST(count(*) AS BIGINT) AS n FROM notes GROUP BY song, pitch)",
    f"sums AS (SELECT song, pitch, sum(n) OVER (PARTITION BY song ORDER BY pitch) AS upto, sum(n) OVER (PARTITION BY song) AS total, {unit(DRAW, 'song')} AS u FROM weights)",
    then="SELECT song, min(pitch) AS pitch FROM sums WHERE upto > u * total GROUP BY song",
)


@R.add("multinomial_draw", DRAW_SQL)
def multinomial_draw(spark: SparkSession, sf: str) -> DataFrame:
    weights = notes(spark, sf).groupBy("song", "pitch").agg(F.count("*").alias("n"))
    return sampling.multinomial_draws(weights, ["song"], "n", "pitch")


@R.add("step_counts", on_roll("SELECT song, part, step, count(*) AS n FROM roll GROUP BY song, part, step"))
def step_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _roll(spark, sf).groupBy("song", "part", "step").agg(F.count("*").alias("n"))
