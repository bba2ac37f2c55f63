"""Tokens: round trips and rows that go wrong."""

import pytest
from pyspark.sql import functions as F

from notewright.functions.music import EOS, PAD_TOKEN
from notewright.operators import generation, metrics, sampling, tokens

ROLL = "song long, part int, step int, slot int, program int, pitch int, dur int, velocity int"


def test_round_trip_of_all_notes(spark):
    grid = (
        spark.range(128 * 128 * 24)
        .select((F.col("id") % 128).cast("int").alias("program"), (F.expr("id div 128") % 128).cast("int").alias("pitch"), F.expr("id div 16384").cast("int").alias("dur"), "id")
        .select(F.col("id").alias("song"), F.lit(0).alias("part"), F.lit(0).alias("step"), F.lit(0).alias("slot"), "program", "pitch", "dur", F.lit(80).alias("velocity"))
    )
    pairs = tokens.valid_pairs(tokens.token_lists(tokens.tokenize(grid))).select("song", F.inline("pairs"))
    back = pairs.select(F.col("song").alias("id"), "program", "pitch", "dur").exceptAll(grid.select(F.col("song").alias("id"), "program", "pitch", "dur"))
    assert pairs.count() == 128 * 128 * 24 and back.count() == 0


@pytest.mark.parametrize(
    "row,n",
    [([EOS, PAD_TOKEN, 1, 300], 0), ([1, 300, 5], 1), ([1, 300, 200, 300, 2, 300], 1), ([1, 300, 2, 100], 1), ([1, 300, 2, 3199, 3, 3200], 2), ([], 0), ([1, 300, 2, 400], 2)],
)
def test_stops_at_the_first_bad_pair(spark, row, n):
    df = spark.createDataFrame([(1, 0, 0, row)], "song long, part int, step int, tokens array<int>")
    assert tokens.detokenize(df).count() == n


def test_token_layout(spark):
    rows = [(1, 0, 0, 0, 5, 60, 2, 79), (1, 0, 0, 1, 127, 40, 0, 90), (1, 0, 0, 2, 254, None, None, None), (1, 0, 0, 3, 255, 255, 255, 255)]
    df = spark.createDataFrame(rows, ROLL)
    assert tokens.token_lists(tokens.tokenize(df, 2)).first().tokens == [5, 60 + 2 + 3 * 128, 127, 40 + 128, EOS, PAD_TOKEN, PAD_TOKEN, PAD_TOKEN]
    with_velocity = tokens.token_lists(tokens.tokenize(df.limit(2), 0, with_velocity=True)).first().tokens
    assert with_velocity == [5 + 128 * 9, 60 + 18 * 128, 127 + 128 * 11, 40 + 16 * 128]
    assert tokens.token_lists(tokens.tokenize(df.limit(1)), 6).first().tokens[2:] == [PAD_TOKEN] * 4


def test_decoded_times_and_programs(spark):
    df = spark.createDataFrame([(1, 0, 4, [127, 128 + 36, 7, 128 + 60 + 5 * 128])], "song long, part int, step int, tokens array<int>")
    drum, other = tokens.detokenize(df, ratio=2.0, fixed_program=33).orderBy("at").collect()
    assert (drum.is_drum, drum.program, other.program, other.pitch) == (True, 0, 33, 60)
    assert (other.start, other.end) == (4 * 0.125 * 2, (4 + 8) * 0.125 * 2)
    notes = spark.createDataFrame([(True, 0, 1.0, 2.0)], "is_drum boolean, program int, start double, end double")
    with pytest.raises(Exception, match="drums keep"):
        tokens.rescaled(notes, program=3).collect()


def test_task_flags():
    assert tokens.task_flags("cp_rev_self") == {"reverse": True, "self": True, "left_mask": False}
    assert tokens.task_flags("reverse_lmask") == {"reverse": False, "self": False, "left_mask": True}


def test_sampling_mask_rules(spark):
    def allowed(**kw):
        token = F.col("id").cast("int")
        return {r.id for r in spark.range(3331).where(metrics.sampling_allowed(F.lit(0), F.lit(kw.pop("pos")), token, **kw)).collect()}

    assert allowed(pos=0) == {*range(128), EOS}
    assert allowed(pos=32) == {EOS}
    assert allowed(pos=1) == set(range(128, 3200))
    assert allowed(pos=1, rule="reference") == set(range(256, 3328))
    assert allowed(pos=0, instruments=[3, 9]) == {3, 9, EOS}
    off = spark.range(3331).where(metrics.sampling_allowed(F.lit(5), F.lit(0), F.col("id").cast("int"), rhythm=4))
    assert [r.id for r in off.collect()] == [EOS]


def test_generation_harness(spark):
    prompts = spark.createDataFrame([(1, 0, [5, 200]), (1, 1, [6, 201]), (2, 0, [7, 202])], "song long, step int, tokens array<int>")
    sampler = lambda song, sample, history, step: [song, sample, len(history), step]
    rows = {(r.song, r.sample, r.step): r.tokens for r in generation.sample_steps(prompts, sampler, steps=3, samples=2).collect()}
    assert len(rows) == 12 and rows[1, 1, 1] == [6, 201] and rows[2, 1, 2] == [2, 1, 2, 2]
    lengths = spark.createDataFrame([(1, 2), (2, 1)], "song long, length int")
    both = generation.condition_then_target(prompts, prompts, lengths)
    assert sorted((r.song, r.step) for r in both.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]


def test_a_long_song_streams_through_a_bounded_state(spark):
    """The sampler holds four steps; the table function gives steps out as they come."""
    seen = lambda song, sample, last, step: [len(last), sum(t[-1] for t in last) % 1000]
    prompt = spark.range(30_000).select(F.lit(7).alias("song"), F.col("id").alias("step"), F.array(F.col("id").cast("int") % 1000).alias("tokens"))
    out = generation.sample_steps(prompt, generation.Windowed(seen, 4), steps=40_000).collect()
    got = [r.tokens for r in sorted(out, key=lambda r: r.step)]
    want = [[i % 1000] for i in range(30_000)]
    while len(want) < 40_000:
        want.append([4, sum(t[-1] for t in want[-4:]) % 1000])
    assert got == want


class Uneven:
    """Scores that favour the token after the last one drawn."""

    def begin(self, song, sample):
        return song

    def feed(self, state, step, tokens):
        return tokens[0]

    def scores(self, state, step, drawn):
        return [3.0 * (t == (drawn[-1] if drawn else state) + 1) for t in range(3331)]


def test_tokens_are_drawn_place_by_place(spark):
    sampler = generation.PlaceByPlace(Uneven(), places=5, temperature=0, end=9)
    assert sampler.draw(sampler.feed(sampler.begin(1, 0), 0, [3]), 1) == [4, 5, 6, 7, 8]
    assert sampler.draw(sampler.feed(sampler.begin(1, 0), 0, [7]), 1) == [8, 9, PAD_TOKEN, PAD_TOKEN, PAD_TOKEN]
    barred = generation.PlaceByPlace(Uneven(), places=4, temperature=1.0, hook=lambda step, place, s: generation.only_allowed(s, step, place, cap=1))
    for song in range(30):
        drawn = barred.draw(barred.begin(song, 0), 0)
        assert drawn == barred.draw(barred.begin(song, 0), 0)
        assert drawn[0] == EOS or (drawn[0] < 128 <= drawn[1] < 3200 and drawn[2:] == [EOS, PAD_TOKEN])
    firsts = [generation.PlaceByPlace(Uneven(), places=1, temperature=0.2).draw((((i, 0)), 5), 0)[0] for i in range(200)]
    assert sum(t == 6 for t in firsts) > 190


def test_the_hook_bars_what_the_mask_bars(spark):
    import numpy as np

    for kw in ({}, {"rule": "reference"}, {"instruments": [3, 9]}, {"rhythm": 4}, {"cap": 2}):
        for step, place in ((0, 0), (0, 1), (5, 0), (0, 4)):
            mask = metrics.sampling_allowed(F.lit(step), F.lit(place), F.col("id").cast("int"), **kw)
            want = {r.id for r in spark.range(3331).where(mask).collect()}
            assert set(np.flatnonzero(generation.only_allowed(np.zeros(3331), step, place, **kw) == 0).tolist()) == want


def test_sampling_edges(spark):
    schema = "song long, step int, tokens array<int>"
    count = lambda song, sample, before, step: [len(before)]
    prompts = spark.createDataFrame([(1, s, [s]) for s in range(6)] + [(2, 0, None), (None, 0, [5])], schema)
    rows = {(r.song, r.step): r.tokens for r in generation.sample_steps(prompts, count, steps=3).collect()}
    assert rows == {(1, 0): [0], (1, 1): [1], (1, 2): [2], (2, 0): [], (2, 1): [1], (2, 2): [2], (None, 0): [5], (None, 1): [1], (None, 2): [2]}
    assert generation.sample_steps(prompts.limit(0), count, steps=3).count() == 0
    spark.udtf.register("continued", generation.sampling_function(generation.Windowed(count, 2), 4))
    prompts.withColumn("sample", F.lit(0)).createOrReplaceTempView("prompt_rows")
    sql = "SELECT song, count(*) AS n FROM continued(TABLE(SELECT song, sample, step, tokens FROM prompt_rows) PARTITION BY (song, sample) ORDER BY step) GROUP BY song"
    assert {r.song: r.n for r in spark.sql(sql).collect()} == {1: 4, 2: 4, None: 4}


def test_names_without_a_kind_or_set_fail(spark):
    for column in (tokens.model_kind, tokens.data_set):
        for name in ("'other'", "CAST(NULL AS STRING)"):
            with pytest.raises(Exception, match="no (kind of model|set of data) in"):
                spark.sql(f"SELECT {name} AS name").select(column(F.col("name"))).collect()


def test_dropout_keeps_the_expectation(spark):
    for ratio in (-0.1, 1.0):
        with pytest.raises(ValueError):
            sampling.dropout(F.lit(1.0), ratio)
    mean = spark.range(20_000).select(F.avg(sampling.dropout(F.lit(1.0), 0.25, F.col("id")))).first()[0]
    assert abs(mean - 1) < 0.02
    assert spark.range(5).select(sampling.dropout(F.lit(2.0), 0.0, F.col("id"))).distinct().count() == 1
