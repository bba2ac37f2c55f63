"""Rolls, gates and selectors against literal sequential models and hand-written edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from notewright.functions.music import DURATIONS, duration_index, step_of
from notewright.operators import corpus, gates, rolls, sampling, selectors

NOTE = "song long, track int, is_drum boolean, program int, pitch int, velocity int, start double, end double, len int, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, NOTE)


def note(song=1, track=0, drum=False, program=0, pitch=60, velocity=80, start=0.0, length=1, seq=1):
    return (song, track, drum, program, pitch, velocity, float(start), float(start + length), length, seq)


def model(notes, chosen, cap, dedup, length):
    """Notes one at a time: slots of a part, and pitches seen with room."""
    slots, used, first, seen = {}, {}, {}, []
    for n in sorted(notes, key=lambda n: n[9]):
        step, end = round(n[6]), round(n[7])
        if not 0 <= step < length or used.get(step, 0) >= cap:
            continue
        dur = sum((a + b) / 2 < end - step for a, b in zip(DURATIONS, DURATIONS[1:], strict=False))
        if not n[2]:
            seen.append(n[4])
        if not chosen(n):
            continue
        program = 127 if n[2] else n[3]
        key = (program, step, n[4])
        if dedup and key in first:
            at = first[key]
            if slots[step, at][2] < dur:
                slots[step, at] = (program, n[4], dur, n[5])
            continue
        at = used.get(step, 0)
        first[key] = at
        slots[step, at] = (program, n[4], dur, n[5])
        used[step] = at + 1
    return slots, seen


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("selector", ["all", "drum", "nondrum", "upto-1", "empty"])
def test_capped_matches_sequential_model(spark, dedup, selector):
    rng = random.Random(7)
    rows = []
    for song in range(8):
        for seq in range(200):
            track = seq // 50
            rows.append(note(song, track, track == 3, track * 5, rng.randint(50, 55), rng.randint(40, 44), rng.randint(-1, 40) / 2, rng.randint(0, 9), seq))
    df = frame(spark, rows)
    lengths = spark.createDataFrame([(s, 18) for s in range(8)], "song long, length int")
    part = selectors.Selector.parse(selector)
    steps = rolls.quantised(selectors.with_selector_inputs(df, [part]), lengths)
    got = {(r.song, r.step, r.slot): (r.program, r.pitch, r.dur, r.velocity) for r in rolls.capped(steps, part.column(), 4, dedup).collect()}
    seen = rolls.with_room(steps, part.column(), 4, dedup).where("room AND NOT is_drum")
    pitches = {}
    for r in seen.collect():
        pitches.setdefault(r.song, []).append(r.pitch)
    chosen = {"all": lambda n: True, "drum": lambda n: n[2], "nondrum": lambda n: not n[2], "upto-1": lambda n: n[1] <= 1, "empty": lambda n: False}[selector]
    want = {}
    for song in range(8):
        slots, heard = model([r for r in rows if r[0] == song], chosen, 4, dedup, 18)
        want.update({(song, *k): v for k, v in slots.items()})
        assert sorted(heard) == sorted(pitches.get(song, []))
    assert got == want


def test_rounding_and_durations(spark):
    row = spark.range(1).select(*[step_of(F.lit(x)).alias(str(i)) for i, x in enumerate((0.5, 1.5, 2.5))]).first()
    assert tuple(row) == (0, 2, 2)
    row = spark.range(1).select(*[duration_index(F.lit(x)).alias(str(i)) for i, x in enumerate((0, 1, 2, 5, 7, 10, 5000))]).first()
    assert tuple(row) == (0, 0, 1, 3, 4, 5, 23)


def test_duplicates(spark):
    def kept(*lengths):
        rows = [note(velocity=50 + i, length=n, seq=i) for i, n in enumerate(lengths)]
        r = rolls.capped(rolls.quantised(frame(spark, rows)), F.lit(True), 2, True).collect()
        assert len(r) == 1
        return r[0].dur, r[0].velocity

    assert kept(2, 8) == (5, 51)
    assert kept(2, 2) == (1, 50)
    assert kept(8, 2) == (5, 50)
    late = [note(pitch=60, length=1, seq=0), note(pitch=61, length=1, seq=1), note(pitch=60, length=9, seq=2)]
    r = rolls.capped(rolls.quantised(frame(spark, late)), F.lit(True), 2, True).where("pitch = 60").first()
    assert r.dur == 0  # the step was full


@pytest.mark.parametrize("off,total,keep", [(9, 20, None), (45, 100, True), (46, 100, False), (65, 100, False), (66, 100, True), (100, 100, False), (0, 21, True)])
def test_quantisation_gate(spark, off, total, keep):
    rows = [note(start=1 if i < off else 0, seq=i) for i in range(total)]
    score = gates.quantisation_scores(frame(spark, rows)).first().score
    if keep is None:
        assert score == 1.0  # 20 notes are too few to score
    else:
        assert score == off / total
        assert (gates.quantisation_gate(frame(spark, rows)).count() == 1) == keep


def test_shift_range_of_drums(spark):
    row = rolls.pitch_shift_range(rolls.quantised(frame(spark, [note(drum=True)]))).first()
    assert (row.shift_min, row.shift_max) == (-127, 127)


def test_build_rolls_parts_and_markers(spark):
    rows = [note(start=s, length=1, seq=s, program=s) for s in (0, 0, 2)] + [note(track=1, drum=True, start=1, seq=9)]
    roll, songs = rolls.build_rolls(frame(spark, rows), selectors=["nondrum", "empty"], cap=2, gate=False, fixed_length=3)
    got = {(r.part, r.step, r.slot, r.program) for r in roll.collect()}
    assert {g for g in got if g[0] == 1} == {(1, s, 0, 254) for s in range(3)}
    assert {g for g in got if g[0] == 0} == {(0, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 254), (0, 2, 0, 2), (0, 2, 1, 254)}
    assert songs.first().length == 3
    roll, songs = rolls.build_rolls(frame(spark, [note()]), selectors=["nondrum", "drum"], gate=False)
    assert songs.count() == 0 and roll.count() == 0
    for selector in ("dense", "random-0"):
        assert rolls.build_rolls(frame(spark, [note()]), selectors=selector, gate=False)[1].count() == 0
    cells = rolls.dense_rows(rolls.build_rolls(frame(spark, rows), cap=2, gate=False, fixed_length=3)[0], 1, 2).orderBy("step").collect()
    assert [c.program for c in cells[1].cells] == [127, 254] and cells[1].cells[1].pitch == 255


@pytest.mark.parametrize("bad", [3, "track", "track-x", "other", "random-2", ["sparse", "dense"], ["all", "random-0"]])
def test_bad_selectors(bad):
    with pytest.raises((NotImplementedError, ValueError)):
        selectors.parse_parts(bad)


def test_random_sides_are_never_empty(spark):
    rows = [note(song=s, track=t, seq=t) for s in range(30) for t in range(s % 5 + 1)]
    sides = {}
    for r in selectors.random_sides(frame(spark, rows)).collect():
        sides.setdefault(r.song, set()).add(r.side)
    assert all(v == {0, 1} for v in sides.values())
    assert set(sides) == {s for s in range(30) if s % 5}


def test_crops_and_masks(spark):
    songs = spark.createDataFrame([(i, n) for i, n in enumerate([63, 64, 65, 1000])], "song long, length int")
    got = {r.song: r.crop_start for r in sampling.crop_starts(songs, 64, 4).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2] == 0 and got[3] % 4 == 0 and got[3] < 936
    with pytest.raises(ValueError):
        sampling.span_masks(songs, 0.5, 0)
    with pytest.raises(ValueError):
        sampling.span_masks(songs, 0.5, 11, size=10)
    assert sampling.span_masks(songs, 2.0, 10, size=20).groupBy("song").count().where("count > 20").count() == 0


def test_corpus_round_trip(spark, tmp_path):
    rows = [note(start=s, seq=s) for s in range(5)]
    roll, songs = rolls.build_rolls(frame(spark, rows), cap=2, gate=False)
    corpus.write_corpus(roll, songs, str(tmp_path / "c"), "test")
    again, index = corpus.read_corpus(spark, str(tmp_path / "c"), "test")
    assert again.drop("preset").exceptAll(roll).count() == 0 and index.count() == 1
    corpus.write_index(spark.createDataFrame([("b.mid",), ("a.mid",)], "relpath string"), str(tmp_path / "index"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "index")).collect()) == ["0\ta.mid", "1\tb.mid"]
    assert {r.song for r in corpus.in_split(spark.range(20).withColumnRenamed("id", "song"), "val").collect()} == {1, 11}


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_running_totals_over_ranges(spark, n):
    from notewright.functions.order import global_index, running_total

    rows = [(i * 37 % 1009, i % 11) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    got = {r.k: (r.before, r.at) for r in global_index(running_total(df, ["k"], F.col("v"), "before"), ["k"], "at").collect()}
    want, total = {}, 0
    for at, (k, v) in enumerate(sorted(rows)):
        want[k] = (total, at)
        total += v
    assert got == want
