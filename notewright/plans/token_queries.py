"""Queries over tokens: tokenise, two-part tasks, time compression, decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.music import DURATIONS, duration_subbeats, shrink_duration
from notewright.operators import events, gates, generation, metrics, rolls, tokens
from notewright.plans.base import NOTES, Registry, on_notes, on_roll, on_steps, unit, with_views
from notewright.plans.event_queries import EVENTS, IN_FORCE, PAIRS
from notewright.plans.note_queries import LENGTHS, MARKERS, _roll, roll_sorted_with_end
from notewright.sources.surrogates import midi_events, notes, table

R = Registry()

TOKENS = """
tokens AS (
  SELECT song, part, step, slot * 2 AS pos, CASE WHEN program = 254 THEN 3329 ELSE program END AS token FROM marked
  UNION ALL
  SELECT song, part, step, slot * 2 + 1, CASE WHEN pitch = 255 THEN 3330 ELSE pitch + (dur + 1) * 128 + CASE WHEN program <> 127 THEN {shift} ELSE 0 END END FROM marked)
"""


@R.add("tokenize", on_roll("SELECT song, part, step, CAST(pos AS INTEGER) AS pos, CAST(token AS INTEGER) AS token FROM tokens", MARKERS, TOKENS.format(shift=3)))
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.tokenize(roll_sorted_with_end(spark, sf), 3)


VELOCITY_SQL = """
SELECT song, part, step, CAST(slot * 2 AS INTEGER) AS pos,
       CAST(CASE WHEN program = 254 THEN 5121 ELSE program + 128 * (velocity // 8) END AS INTEGER) AS token FROM marked
UNION ALL
SELECT song, part, step, slot * 2 + 1, CASE WHEN pitch = 255 THEN 5122 ELSE pitch + (dur + 16) * 128 END FROM marked
"""


@R.add("tokenize_velocity", on_roll(VELOCITY_SQL, MARKERS))
def tokenize_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.tokenize(roll_sorted_with_end(spark, sf), 0, with_velocity=True)


PARTS = "parts AS (SELECT song, CASE WHEN program = 127 THEN 0 ELSE 1 END AS part, step, slot, program, pitch, dur, velocity FROM roll)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _roll(spark, sf).withColumn("part", F.when(F.col("program") == 127, 0).otherwise(1))


@R.add("swap_parts", on_roll("SELECT song, 1 - part AS part, step, slot, program, pitch, dur, velocity FROM parts", PARTS))
def swap_parts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.two_parts(_parts(spark, sf), "cp_rev").select(*rolls.ROLL)


@R.add("self_parts", on_roll("SELECT song, p AS part, step, slot, program, pitch, dur, velocity FROM roll CROSS JOIN (SELECT unnest([0, 1]) AS p)"))
def self_parts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.two_parts(_roll(spark, sf), "cp_self").select(*rolls.ROLL)


COMPRESSED = """
SELECT song, part, CAST(step // CASE part WHEN 0 THEN 4 ELSE 2 END AS INTEGER) AS step, slot, program, pitch,
       CAST(greatest(dur, CASE part WHEN 0 THEN 4 ELSE 2 END) - CASE part WHEN 0 THEN 4 ELSE 2 END AS INTEGER) AS dur, velocity
FROM parts WHERE step % CASE part WHEN 0 THEN 4 ELSE 2 END = 0
"""


@R.add("compress_time", on_roll(COMPRESSED, PARTS))
def compress_time(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.compressed_time(_parts(spark, sf), 4, 2).select(*rolls.ROLL)


@R.add("shrink_duration", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 300 < 255 THEN greatest(l_partkey % 300, 4) - 4 ELSE l_partkey % 300 END AS shrunk FROM lineitem")
def shrink(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("l_partkey") % 300
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shrink_duration(value, 4).alias("shrunk"))


@R.add("index_vector", with_views(NOTES, LENGTHS, then="SELECT song, CAST(unnest(range(0, length, 4)) AS INTEGER) AS i FROM lengths"))
def index_vector(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.index_vector(gates.end_steps(notes(spark, sf)), 4)


@R.add("used_positions", on_roll("SELECT CAST(pos AS INTEGER) AS pos FROM tokens GROUP BY pos HAVING min(token) <> 3330", MARKERS, TOKENS.format(shift=0)))
def used_positions(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.used_positions(tokens.tokenize(roll_sorted_with_end(spark, sf)))


@R.add("task_flags", "SELECT p_partkey, list_contains(string_split(p_type, ' '), 'SMALL') AS rev, list_contains(string_split(p_type, ' '), 'TIN') AS self, list_contains(string_split(p_type, ' '), 'PLATED') AS lmask FROM part")
def task_flags(spark: SparkSession, sf: str) -> DataFrame:
    named = F.replace(F.replace(F.replace("p_type", F.lit("SMALL"), F.lit("rev")), F.lit("TIN"), F.lit("self")), F.lit("PLATED"), F.lit("lmask"))
    return table(spark, sf, "part").select("p_partkey", *tokens.task_flag_columns(F.replace(named, F.lit(" "), F.lit("_"))))


@R.add("prompt_steps", on_roll("SELECT song, part, step, slot, program, pitch, dur, velocity FROM roll WHERE step < 32"))
def prompt_steps(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.prompt(_roll(spark, sf), 32)


# Prompts of a customer's orders, one token a step; a token follows from the one before it.
SAMPLED = """
WITH RECURSIVE kept AS (
  SELECT o_custkey AS song, sample, (nth - 1)::INTEGER AS step, (o_orderkey % 128)::INTEGER AS token
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders), (SELECT unnest([0, 1]) AS sample) WHERE nth <= 12),
grown AS (
  SELECT song, sample, max(step) AS step, arg_max(token, step) AS token, false AS drawn FROM kept GROUP BY song, sample
  UNION ALL
  SELECT song, sample, step + 1, (token * 5 + 7 + step + 1 + sample) % 128, true FROM grown WHERE step < 11)
SELECT song, sample, step, token FROM kept UNION ALL SELECT song, sample, step, token FROM grown WHERE drawn
"""


class LastToken:
    """A stand-in for a model: its state is the last token and the number of the sample."""

    def begin(self, song: int, sample: int) -> tuple[int, int]:
        return 0, sample

    def feed(self, state: tuple[int, int], step: int, tokens: list[int]) -> tuple[int, int]:
        return tokens[-1], state[1]

    def draw(self, state: tuple[int, int], step: int) -> list[int]:
        return [(state[0] * 5 + 7 + step + state[1]) % 128]


@R.add("sampled_steps", SAMPLED)
def sampled_steps(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    prompts = table(spark, sf, "orders").select(F.col("o_custkey").alias("song"), nth.alias("step"), F.array((F.col("o_orderkey") % 128).cast("int")).alias("tokens"))
    out = generation.sample_steps(prompts, LastToken(), steps=12, samples=2)
    return out.select("song", "sample", "step", F.col("tokens")[0].alias("token"))


# A vector's label gives the scores of 64 tokens at each of 6 places; 63 ends the step.
LOCAL = f"""
WITH weights AS (
  SELECT vec_id AS song, place, tok, exp((label * 7 + tok * 13 + place * 5) % 17 / 4.0::DOUBLE / 0.8) AS w
  FROM embeddings, (SELECT unnest(range(0, 6)) AS place), (SELECT unnest(range(0, 64)) AS tok)),
summed AS (
  SELECT *, sum(w) OVER (PARTITION BY song, place ORDER BY tok) AS upto, sum(w) OVER (PARTITION BY song, place) AS total, {unit("'local'", "song", "0", "1", "place")} AS u FROM weights),
drawn AS (SELECT song, place, min(tok) FILTER (WHERE upto > u * total) AS token FROM summed GROUP BY song, place)
SELECT song, CAST(place AS INTEGER) AS place,
       CAST(CASE WHEN coalesce(max(CASE WHEN token = 63 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 3330 ELSE token END AS INTEGER) AS token
FROM drawn
"""


class LabelScores:
    """A stand-in for a model: scores follow from the last step's first token and the place."""

    def begin(self, song: int, sample: int) -> int:
        return 0

    def feed(self, state: int, step: int, tokens: list[int]) -> int:
        return tokens[0]

    def scores(self, state: int, step: int, drawn: list[int]) -> list[float]:
        return [(state * 7 + tok * 13 + len(drawn) * 5) % 17 / 4.0 for tok in range(64)]


@R.add("local_sampling", LOCAL)
def local_sampling(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("song"), F.lit(0).alias("step"), F.array("label").alias("tokens"))
    sampler = generation.PlaceByPlace(LabelScores(), places=6, temperature=0.8, end=63)
    out = generation.sample_steps(prompts, sampler, steps=2).where("step = 1")
    return out.select("song", F.posexplode("tokens").alias("place", "token"))


NAMED = """
decoded AS (
  SELECT song, part, step, slot AS nth, program, pitch, dur FROM roll)
"""
TIMES = "list_value(" + ", ".join(map(str, DURATIONS)) + ")[dur + 1]"


@R.add("detokenize", on_roll(f"SELECT song, part, step, nth, CASE WHEN program = 127 THEN 0 ELSE program END AS program, program = 127 AS is_drum, pitch, 100 AS velocity, round(step * 0.125::DOUBLE, 6) AS start, round({TIMES} * 0.125::DOUBLE + step * 0.125::DOUBLE, 6) AS \"end\" FROM decoded", NAMED))
def detokenize(spark: SparkSession, sf: str) -> DataFrame:
    lists = tokens.token_lists(tokens.tokenize(roll_sorted_with_end(spark, sf)))
    out = tokens.detokenize(lists).withColumnRenamed("at", "nth")
    return out.withColumns({c: F.round(c, 6) for c in ("start", "end")})


# Pairs made to go wrong: programs up to 139, values below 128 and beyond the last duration.
RAW = """
raw AS (
  SELECT l_orderkey AS song, l_linenumber AS n, l_partkey AS k,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS nth,
         l_suppkey * 7 % 140 AS program, l_partkey * 13 % 3500 AS value FROM lineitem),
checked AS (
  SELECT *, max(CASE WHEN program >= 128 OR value < 128 OR value - 128 >= 24 * 128 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY nth) AS bad FROM raw)
"""


@R.add("takewhile_valid", with_views(RAW, then="SELECT song, CAST(nth AS INTEGER) AS nth, program, (value - 128) % 128 AS pitch, (value - 128) // 128 AS dur FROM checked WHERE bad = 0"))
def takewhile_valid(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pair = F.array((F.col("l_suppkey") * 7 % 140).cast("int"), (F.col("l_partkey") * 13 % 3500).cast("int"))
    rows = table(spark, sf, "lineitem").withColumn("nth", F.row_number().over(order)).select(F.col("l_orderkey").alias("song"), "nth", pair.alias("pair"))
    lists = rows.groupBy("song").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "pair"))), lambda s: s["pair"])).alias("tokens"))
    found = tokens.valid_pairs(lists).select("song", F.posexplode("pairs").alias("nth", "p"))
    return found.select("song", "nth", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("program", "pitch", "dur")])


@R.add("rescale_notes", on_notes("SELECT song, seq, round(start * 0.15::DOUBLE, 6) AS start, round(\"end\" * 0.15::DOUBLE, 6) AS \"end\", 80 AS velocity FROM notes"))
def rescale_notes(spark: SparkSession, sf: str) -> DataFrame:
    out = tokens.rescaled(notes(spark, sf), tempo=100.0, velocity=80)
    return out.select("song", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "velocity")


@R.add("program_override", on_notes("SELECT song, seq, is_drum, CASE WHEN is_drum THEN program ELSE 40 END AS program FROM notes"))
def program_override(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.program_override(notes(spark, sf), 40).select("song", "seq", "is_drum", "program")


EXTRA_SQL = with_views(
    NOTES,
    EVENTS,
    IN_FORCE,
    PAIRS,
    then="""
SELECT song, NULL::INTEGER AS instrument, program, pitch, start FROM notes
UNION ALL SELECT song, note AS instrument, program, note AS pitch, on_tick / 1000000.0::DOUBLE AS start FROM pairs
""",
)


@R.add("extra_instruments", EXTRA_SQL)
def extra_instruments(spark: SparkSession, sf: str) -> DataFrame:
    pairs = events.next_off_pairs(midi_events(spark, sf))
    extra = pairs.select("song", F.col("note").alias("instrument"), "program", F.col("note").alias("pitch"), (F.col("on_tick") / F.lit(1000000.0)).alias("start"))
    return tokens.with_extra_instruments(notes(spark, sf).select("song", "program", "pitch", "start"), extra)


@R.add("duration_lookup", on_steps(f"SELECT song, seq, dur, CAST({list(DURATIONS)}[dur + 1] AS INTEGER) AS subbeats FROM steps"))
def duration_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return rolls.quantised(notes(spark, sf)).select("song", "seq", "dur", duration_subbeats(F.col("dur")).alias("subbeats"))


@R.add("condition_then_target", on_roll("SELECT song, step, slot, pitch FROM roll UNION ALL SELECT r.song, step + length, slot, pitch FROM roll r JOIN lengths l ON r.song = l.song"))
def condition_then_target(spark: SparkSession, sf: str) -> DataFrame:
    roll = _roll(spark, sf).select("song", "step", "slot", "pitch")
    return generation.condition_then_target(roll, roll, gates.end_steps(notes(spark, sf)))


DISPATCH = """
WITH names AS (
  SELECT o_orderkey, ['a_cocomulla_prompt', 'a_prompt', 'yinyang', 'seq2seq'][o_orderkey % 4 + 1] || ['_drums_nondrum', '_chord_mel', '_chords', '_chords_drums_nondrum'][o_custkey % 4 + 1] AS name FROM orders)
SELECT o_orderkey, CASE WHEN contains(name, 'cocomulla') THEN 'cocomulla' WHEN contains(name, 'prompt') THEN 'prompt' WHEN contains(name, 'yinyang') THEN 'yinyang' ELSE 'seq2seq' END AS kind,
       CASE WHEN contains(name, 'drums_nondrum') THEN 'drums_nondrum' WHEN contains(name, '_chord_mel') THEN '_chord_mel' ELSE '_chords' END AS data
FROM names
"""


@R.add("model_dispatch", DISPATCH)
def model_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda words, key: F.get(F.array(*[F.lit(w) for w in words]), (F.col(key) % 4).cast("int"))
    name = F.concat(
        pick(("a_cocomulla_prompt", "a_prompt", "yinyang", "seq2seq"), "o_orderkey"),
        pick(("_drums_nondrum", "_chord_mel", "_chords", "_chords_drums_nondrum"), "o_custkey"),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", name.alias("name"))
    return rows.select("o_orderkey", tokens.model_kind(F.col("name")).alias("kind"), tokens.data_set(F.col("name")).alias("data"))


ENDED = """
SELECT song, part, step, CAST(pos AS INTEGER) AS pos, CAST(token AS INTEGER) AS token, seen AS ended, CAST(CASE WHEN seen THEN 3330 ELSE token END AS INTEGER) AS padded
FROM (SELECT *, coalesce(max(CASE WHEN token = 3329 THEN 1 ELSE 0 END) OVER (PARTITION BY song, part, step ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM tokens)
"""


@R.add("ended_flags", on_roll(ENDED, MARKERS, TOKENS.format(shift=0)))
def ended_flags(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ended_before(tokens.tokenize(roll_sorted_with_end(spark, sf)))


@R.add("all_ended", on_roll("SELECT step, bool_and(has) AS all_ended FROM (SELECT step, song, bool_or(token = 3329) AS has FROM tokens GROUP BY step, song) GROUP BY step", MARKERS, TOKENS.format(shift=0)))
def all_ended(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.all_ended(tokens.tokenize(roll_sorted_with_end(spark, sf)))


ALLOWED = """
SELECT o_orderkey, CASE WHEN o_custkey % 32 % 2 = 0 THEN (t = 3329 OR (t < 128 AND (o_custkey % 32) // 2 < 12)) ELSE (t >= 128 AND t < 3200) END AS allowed,
       CASE WHEN o_orderkey % 3 <> 0 THEN t = 3329 WHEN o_custkey % 32 % 2 = 0 THEN t = 3329 OR t IN (0, 24, 32) ELSE (t >= 256 AND t < 3328) END AS allowed_reference
FROM (SELECT *, (o_orderkey * 31 + o_custkey * 7) % 3331 AS t FROM orders)
"""


@R.add("sampling_mask", ALLOWED)
def sampling_mask(spark: SparkSession, sf: str) -> DataFrame:
    token = (F.col("o_orderkey") * 31 + F.col("o_custkey") * 7) % 3331
    pos, step = F.col("o_custkey") % 32, F.col("o_orderkey")
    wide = metrics.sampling_allowed(step, pos, token, cap=12)
    narrow = metrics.sampling_allowed(step, pos, token, instruments=[0, 24, 32], rhythm=3, rule="reference")
    return table(spark, sf, "orders").select("o_orderkey", wide.alias("allowed"), narrow.alias("allowed_reference"))
