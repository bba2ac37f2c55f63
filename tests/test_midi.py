"""Files, events, note pairing, time: byte fixtures and literal models."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from notewright.operators import events, timing
from notewright.plans import presets
from notewright.sources import midi
from notewright.streaming import ingest


def smf(*tracks, resolution=480):
    head = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), resolution)
    return head + b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)


END = b"\x00\xff\x2f\x00"


def test_decode():
    track = (
        b"\x00\xff\x03\x05Piano" + b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x00\xff\x58\x04\x06\x03\x18\x08" + b"\x00\xff\x59\x02\xfe\x01"
        + b"\x00\xc0\x05" + b"\x81\x00\x90\x3c\x40" + b"\x60\x3c\x00" + b"\x00\xe0\x00\x40" + b"\x00\xb0\x07\x64" + b"\x05\xf0\x03abc" + b"\x03\x80\x3c\x00" + END
    )
    resolution, rows = midi.decode_midi(smf(track))
    kinds = [e["type"] for e in rows]
    assert resolution == 480
    assert kinds == ["track_name", "set_tempo", "time_signature", "key_signature", "program_change", "note_on", "note_on", "pitchwheel", "control_change", "note_off", "end_of_track"]
    assert rows[1]["tempo"] == 500000 and (rows[2]["numerator"], rows[2]["denominator"]) == (6, 8) and rows[3]["key"] == "Gm"
    assert rows[5]["dtick"] == 128 and rows[6]["velocity"] == 0 and rows[7]["pitch"] == 0 and rows[9]["dtick"] == 8
    assert midi.decode_midi(smf(b"\x00\x90\x3c\xff" + END))[1][0]["velocity"] == 127


@pytest.mark.parametrize("bad", [b"", b"RIFF", smf(END)[:-2], smf(b"\x00\x3c\x40" + END), smf(END)[:12] + b"\x80\x00" + smf(END)[14:]])
def test_bad_files_are_rejected(spark, bad):
    with pytest.raises(ValueError):
        midi.decode_midi(bad)
    row = midi.read_events(spark.createDataFrame([("a.mid", bad)], "path string, content binary")).first()
    assert row.status != "ok" and row.events is None


EV = "song long, track int, idx int, type string, channel int, note int, velocity int, program int, tick long"


def pairs(spark, *rows):
    full = [(1, 0, i, kind, 0, note, vel, prog, tick) for i, (tick, kind, note, vel, prog) in enumerate(rows)]
    return [(r.note, r.on_tick, r.off_tick, r.program) for r in events.paired_notes(spark.createDataFrame(full, EV)).orderBy("seq").collect()]


def test_note_pairing_edges(spark):
    on = lambda t, v=64: (t, "note_on", 60, v, None)
    off = lambda t: (t, "note_off", 60, 0, None)
    program = lambda t, p: (t, "program_change", None, None, p)
    assert pairs(spark, on(5), off(5)) == []
    assert pairs(spark, on(0), on(5), off(5), off(9)) == [(60, 0, 5, 0), (60, 5, 9, 0)]
    assert pairs(spark, off(3)) == []
    assert pairs(spark, on(0), on(4, 0)) == [(60, 0, 4, 0)]
    assert pairs(spark, program(0, 3), on(1), program(2, 8), off(3)) == [(60, 1, 3, 8)]
    assert pairs(spark, on(0), on(2), off(4)) == [(60, 0, 4, 0), (60, 2, 4, 0)]
    assert pairs(spark, on(0)) == []


def test_note_pairing_with_ties(spark):
    """Random tracks with many events on one tick, against the rule applied one event at a time."""
    rng = random.Random(9)
    rows, want = [], {}
    for song in range(150):
        tick, sounding, program, found = 0, {}, {}, []
        for i in range(rng.randint(1, 60)):
            tick += rng.choice([0, 0, 0, 1, 2])
            kind, channel, note = rng.choice(["note_on"] * 3 + ["note_off"] * 3 + ["program_change"]), rng.randrange(2), rng.choice([60, 61])
            velocity = rng.choice([0, 50, 90]) if kind == "note_on" else None
            rows.append((song, 0, i, kind, channel, note if kind != "program_change" else None, velocity, i if kind == "program_change" else None, tick))
            if kind == "program_change":
                program[channel] = i
            elif velocity:
                sounding.setdefault((channel, note), []).append((tick, velocity))
            else:
                at = sounding.get((channel, note), [])
                ends = [x for x in at if x[0] < tick]
                found += [(channel, note, v, program.get(channel, 0), t, tick) for t, v in ends]
                sounding[channel, note] = [x for x in at if x[0] == tick] if ends else []
        want[song] = found
    got = {}
    for r in events.paired_notes(spark.createDataFrame(rows, EV)).orderBy("song", "seq").collect():
        got.setdefault(r.song, []).append((r.channel, r.note, r.velocity, r.program, r.on_tick, r.off_tick))
        assert r.seq == len(got[r.song]) - 1
    assert got == {k: v for k, v in want.items() if v} and sum(map(len, want.values())) > 500


def test_ticks_and_relocation(spark):
    rows = [(1, 1, 0, "note_on", 3), (1, 1, 1, "set_tempo", 0x80000000), (1, 1, 2, "note_off", 4), (1, 0, 0, "text", 9)]
    df = spark.createDataFrame(rows, "song long, track int, idx int, type string, dtick long")
    out = events.relocated_meta(events.absolute_ticks(df)).orderBy("track", "idx").collect()
    assert [(r.track, r.idx, r.type, r.tick) for r in out] == [(0, 1, "set_tempo", 3), (0, 2, "text", 9), (1, 1, "note_on", 3), (1, 2, "note_off", 7)]
    assert events.corrupt_songs(events.absolute_ticks(df), 8).count() == 1


def test_controls_bind_to_their_instrument(spark):
    rows = [
        (1, 0, 0, "control_change", 0, None, None, None, 0), (1, 0, 1, "program_change", 0, None, None, 5, 0), (1, 0, 2, "note_on", 0, 60, 64, None, 1),
        (1, 0, 3, "note_off", 0, 60, 0, None, 2), (1, 0, 4, "pitchwheel", 0, None, None, None, 3), (1, 0, 5, "control_change", 1, None, None, None, 3),
    ]
    df = spark.createDataFrame(rows, EV)
    bound = events.bound_controls(df, events.paired_notes(df)).orderBy("idx").collect()
    assert [(r.idx, r.bound_program) for r in bound] == [(0, 5), (4, 5)]


def test_meta_and_names(spark):
    rows = [(1, 0, 0, "track_name", "a", 0), (1, 0, 1, "lyrics", "la", 4), (1, 1, 0, "text", "x", 2), (1, 1, 1, "key_signature", None, 3), (1, 0, 2, "key_signature", None, 5)]
    df = spark.createDataFrame(rows, "song long, track int, idx int, type string, text string, tick long")
    df = df.withColumns({"numerator": F.lit(4), "denominator": F.lit(4), "key": F.lit("C")})
    assert [(r.kind, r.tick) for r in events.song_meta(df).collect()] == [("text", 2), ("lyrics", 4), ("key_signature", 5)]
    assert [r.track_name for r in events.track_names(df).orderBy("track", "idx").collect()] == ["a", "a", "a", "", ""]


def notes_of(rng, n=30):
    return [
        {"is_drum": False, "program": rng.choice([0, 5]), "pitch": 40 + i, "velocity": rng.randint(1, 127), "start": (s := rng.randint(0, 40) / 8), "end": s + rng.randint(1, 8) / 8}
        for i in range(n)
    ]


def test_files_to_rolls_and_back(spark, tmp_path):
    rng = random.Random(2)
    wanted = {}
    for i, name in enumerate(["b.mid", "sub/a.MID", "sub/c.Mid", "bad.mid"]):
        path = tmp_path / "MIDIs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        wanted[name] = notes_of(rng)
        path.write_bytes(midi.encode_midi(wanted[name], resolution=480) if name != "bad.mid" else b"MThd")
    folder = str(tmp_path / "MIDIs")
    listed = [os.path.basename(r.path) for r in midi.midi_files(spark, folder).orderBy("path").collect()]
    assert listed == ["b.mid", "bad.mid", "a.MID"]
    assert midi.midi_files(spark, folder, subfolders=False).count() == 2
    assert midi.midi_files(spark, folder, limit=1).count() == 1
    notes, songs = presets.notes_of(midi.midi_files(spark, folder))
    got = {}
    for r in notes.join(songs, "song").collect():
        got.setdefault(r.relpath.split("/")[-1], []).append((r.program, r.pitch, r.velocity, r.start, r.end))
    assert set(got) == {"b.mid", "a.MID"}
    for name in ("b.mid", "sub/a.MID"):
        # half a second is one beat of four subbeats
        assert sorted(got[name.split("/")[-1]]) == sorted((n["program"], n["pitch"], n["velocity"], n["start"] * 8, n["end"] * 8) for n in wanted[name])
    roll, kept = presets.build(spark, str(tmp_path), "la")
    assert set(kept.columns) >= {"song", "length", "relpath"} and roll.columns[0] == "song"
    rows = spark.createDataFrame([{**n, "path": "out/x.mid"} for n in wanted["b.mid"]])
    midi.write_files(midi.midi_content(rows), str(tmp_path / "written"))
    _, again = midi.decode_midi((tmp_path / "written/out/x.mid").read_bytes())
    assert sum(e["type"] == "note_on" for e in again) == len(wanted["b.mid"])


def test_stream_decodes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for round_ in range(2):
        (tmp_path / "in" / f"{round_}.mid").write_bytes(midi.encode_midi(notes_of(random.Random(round_), 3)))
        query = ingest.decode_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == round_ + 1


def test_presets():
    assert presets.DEFAULT in presets.PRESETS and len(presets.PRESETS) == 12
    from notewright.operators.selectors import parse_parts

    for p in presets.PRESETS.values():
        parse_parts(list(p.selectors))


def test_interpolation_is_held_outside(spark):
    anchors = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 20.0)], "song long, x double, y double")
    asked = spark.createDataFrame([(1, x) for x in (-1.0, 0.0, 0.5, 2.0, 7.0)] + [(2, 1.0)], "song long, x double")
    got = {(r.song, r.x): r.y for r in timing.interpolated(asked, anchors, ["song"]).collect()}
    assert got == {(1, -1.0): 10.0, (1, 0.0): 10.0, (1, 0.5): 12.5, (1, 2.0): 20.0, (1, 7.0): 20.0, (2, 1.0): None}
    perf = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 1.0)], "song long, idx int, start double")
    score = spark.createDataFrame([(1, 0, 0.0), (1, 1, 4.0)], "song long, idx int, start double")
    assert [(r.perf_time, r.score_time) for r in timing.time_map(perf, score, ["song"], "idx").orderBy("perf_time").collect()] == [(0.0, 0.0), (1.0, 4.0)]


def grid(spark, tempi, meters, end, start=0.0):
    frames = [
        spark.createDataFrame([(1, *x) for x in rows], f"song long, {kind}")
        for rows, kind in ((tempi, "time double, qpm double"), (meters, "time double, numerator int, denominator int"), ([(end,)], "end double"))
    ]
    return [tuple(r)[2:] for r in timing.song_beats(*frames, start).orderBy("beat_idx").collect()]


def test_beat_grid(spark):
    times = lambda *a, **k: [round(b[0], 6) for b in grid(spark, *a, **k)]
    assert times([(0.0, 120.0)], [], 2.0) == times([], [], 2.0) == [0.0, 0.5, 1.0, 1.5]
    # 60 a minute to 1.5 s, then 120: the second beat is half slow, half fast
    assert times([(0.0, 60.0), (1.5, 120.0)], [], 3.0) == [0.0, 1.0, 1.75, 2.25, 2.75]
    found = grid(spark, [(0.0, 120.0)], [(0.0, 4, 4), (1.2, 6, 8)], 2.5)
    assert [round(b[0], 6) for b in found] == [0.0, 0.5, 1.0, 1.2, 1.95] and found[3][2:] == (6, 8)
    assert found[0] == (0.0, -1.0, -1, -1)
    assert times([(0.0, 120.0)], [(0.7, 4, 4)], 2.0) == [0.0, 0.5, 0.7, 1.2, 1.7]
    assert times([(0.0, 120.0)], [(0.0, 4, 4), (1.0, 3, 4)], 2.2, start=0.3) == [0.3, 0.8, 1.0, 1.5, 2.0]
    assert times([(0.0, 120.0)], [], 0.0) == []


def test_beats_last_one_beat_each(spark):
    """Between two beats without a signature in between, the rates over time add up to one beat."""
    rng = random.Random(6)
    for _ in range(4):
        tempi = [(0.0, 100.0)] + sorted((rng.uniform(0.1, 30), rng.uniform(40, 240)) for _ in range(12))
        meters = sorted((rng.uniform(0, 30), rng.choice([3, 4, 6, 9]), rng.choice([4, 8])) for _ in range(4))
        found = [b[0] for b in grid(spark, tempi, meters, 32.0)]
        assert {round(m[0], 9) for m in meters} <= {round(t, 9) for t in found} and found == sorted(found)
        for low, high in zip(found, found[1:], strict=False):
            held = [m for m in meters if m[0] <= low + 1e-9] or meters[:1]
            quarters = 4 / held[-1][2] * (3 if held[-1][1] % 3 == 0 and held[-1][1] != 3 else 1)
            cuts = [low, *[t for t, _ in tempi if low < t < high], high]
            rate = lambda x: [q for t, q in tempi if t <= x][-1] / 60 / quarters
            spent = sum((b - a) * rate((a + b) / 2) for a, b in zip(cuts, cuts[1:], strict=False))
            at_signature = any(abs(high - m[0]) < 1e-9 for m in meters)
            assert spent == pytest.approx(1) or at_signature and spent < 1.001
