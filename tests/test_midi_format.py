"""The midi data source: partitions, filters, columns, rejects, and a commit in two phases."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_midi import END, smf

from notewright.sources import midi, midi_format


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    midi_format.register(spark)


def song(notes, program=1):
    body = bytes([0, 0xC0, program]) + b"".join(bytes([1, 0x90, 60 + i % 20, 64, 1, 0x80, 60 + i % 20, 0]) for i in range(notes))
    return smf(body + END)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("midi")
    (root / "deep" / "er").mkdir(parents=True)
    files = {f"s{i:03}.mid": song(i % 7 + 1) for i in range(60)} | {"deep/er/x.MID": song(3), "hot.mid": song(40_000), "deep/bad.mid": song(5)[:-3], "odd.Mid": song(1), "read.txt": b"no"}
    (root / "_staging").mkdir()
    files["_staging/left.mid"] = song(2)
    cut = song(40_000)
    files["deep/hot_bad.mid"] = cut[: len(cut) - 2]
    for name, content in files.items():
        (root / name).write_bytes(content)
    return root, files


def shown(files):
    return {n: c for n, c in files.items() if n.endswith((".mid", ".MID")) and not n.startswith("_")}


def test_reads_what_the_decoder_reads(spark, folder):
    root, files = folder
    out = spark.read.format("midi").load(str(root))
    assert out.columns == midi_format.SCHEMA.names
    got = {os.path.relpath(r.path, root): (r.status, r.n, r.size) for r in out.groupBy("path", "status", "size").agg(F.count("type").alias("n")).collect()}
    assert set(got) == set(shown(files))
    for name, content in shown(files).items():
        try:
            want = ("ok", len(midi.decode_midi(content)[1]), len(content))
        except ValueError as reason:
            want = (str(reason), 0, len(content))
        assert got[name] == want
    one = out.where(F.col("path").endswith("s005.mid")).orderBy("track", "idx").collect()
    assert [{c: r[c] for c in midi.FIELDS if r[c] is not None} for r in one] == [{c: e[c] for c in midi.FIELDS if e.get(c) is not None} for e in midi.decode_midi(files["s005.mid"])[1]]


def test_a_corrupt_file_yields_one_row_however_large(spark, folder):
    root, _ = folder
    bad = spark.read.format("midi").load(str(root)).where("status <> 'ok'").collect()
    assert sorted(os.path.basename(r.path) for r in bad) == ["bad.mid", "hot_bad.mid"] and all(r.type is None for r in bad)


def test_options(spark, folder):
    root, files = folder
    flat = spark.read.format("midi").option("recursive", "false").load(str(root)).select("path").distinct()
    assert flat.count() == sum("/" not in n for n in shown(files))
    first = spark.read.format("midi").option("limit", 3).load(str(root)).select("path").distinct().collect()
    assert sorted(os.path.relpath(r.path, root) for r in first) == sorted(shown(files))[:3]


def test_partitions_are_planned_by_bytes(folder):
    files = [(f"s{i:03}", 100) for i in range(1000)] + [("hot", 50 << 20)]
    parts = midi_format.planned(files, 8 << 20)
    assert sorted(f for p in parts for f in p) == sorted(files)
    assert [p for p in parts if ("hot", 50 << 20) in p] == [[("hot", 50 << 20)]]
    sizes = [len(p) for p in parts if len(p) > 1]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) > 7
    assert midi_format.planned([]) == []


def test_filters_and_columns_reach_the_source(spark, folder):
    root, files = folder
    some = spark.read.format("midi").schema(midi_format.some_columns("path", "status", "type", "note")).load(str(root))
    asked = some.where((F.col("path") == f"{root}/s003.mid") & (F.col("type").isin("note_on", "note_off")) & (F.col("note") > 60))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "(note#" in plan and " IN (" not in plan and "isnotnull(path" not in plan
    assert sorted((r.type, r.note) for r in asked.collect()) == sorted((e["type"], e["note"]) for e in midi.decode_midi(files["s003.mid"])[1] if e.get("note", 0) > 60)
    reader = midi_format.MidiReader(midi_format.SCHEMA, {"path": str(root)})
    assert list(reader.pushFilters([midi_format.StringStartsWith(("path",), f"{root}/deep"), midi_format.EqualTo(("note",), 3)])) == [midi_format.EqualTo(("note",), 3)]
    assert sorted(os.path.relpath(f[0], root) for p in reader.partitions() for f in p.files) == sorted(n for n in shown(files) if n.startswith("deep"))
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("midi").schema("nonsense int").load(str(root)).collect()


def test_empty_folder(spark, tmp_path):
    assert spark.read.format("midi").load(str(tmp_path)).count() == 0


def contents(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_write_and_read_back(spark, tmp_path):
    rows = [(f"a/{i}.mid", song(i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, midi_format.WRITTEN).repartition(4)
    target = str(tmp_path / "out")
    df.write.format("midi").mode("append").save(target)
    assert contents(target) == dict(rows)
    more = spark.createDataFrame([("b.mid", song(2)), ("a/3.mid", song(9))], midi_format.WRITTEN)
    more.write.format("midi").mode("append").save(target)
    assert contents(target) == dict(rows) | {"b.mid": song(2), "a/3.mid": song(9)}
    more.write.format("midi").mode("overwrite").save(target)
    assert contents(target) == {"b.mid": song(2), "a/3.mid": song(9)}
    spark.createDataFrame([], midi_format.WRITTEN).write.format("midi").mode("append").save(target)
    assert len(contents(target)) == 2


@pytest.mark.parametrize("bad", ["../x.mid", "", "a/_b.mid", "x.txt", None])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    target = tmp_path / "out"
    rows = [(f"{i}.mid", song(1)) for i in range(10)] + [(bad, song(1))]
    with pytest.raises(Exception, match="not a path"):
        spark.createDataFrame(rows, midi_format.WRITTEN).repartition(5).write.format("midi").mode("append").save(str(target))
    assert midi_format.listed(str(tmp_path)) == [] and spark.read.format("midi").load(str(tmp_path)).count() == 0


def test_the_same_path_twice_is_refused(spark, tmp_path):
    rows = [("x.mid", song(1)), ("./x.mid", song(2))]
    with pytest.raises(Exception, match="same path"):
        spark.createDataFrame(rows, midi_format.WRITTEN).repartition(2).write.format("midi").mode("append").save(str(tmp_path))
    assert contents(tmp_path) == {}


def test_lost_between_write_and_commit(tmp_path):
    """A task that ran twice, of which one message arrives, and a driver lost before or in the commit."""
    writer = midi_format.MidiWriter({"path": str(tmp_path)}, overwrite=False)
    rows = [{"path": f"{i}.mid", "content": song(i + 1)} for i in range(4)]
    writer.write(iter(rows[:2]))  # lost before its message
    again, rest = writer.write(iter(rows[:2])), writer.write(iter(rows[2:]))
    assert midi_format.listed(str(tmp_path)) == []
    writer.commit([again, None, rest])
    assert contents(tmp_path) == {r["path"]: r["content"] for r in rows}
    writer.write(iter(rows[:1]))  # a task that the end of its job found running
    assert midi_format.recover(str(tmp_path)) == 0 and contents(tmp_path) == {r["path"]: r["content"] for r in rows}


def test_recovery_finishes_a_commit(tmp_path, monkeypatch):
    writer = midi_format.MidiWriter({"path": str(tmp_path)}, overwrite=False)
    message = writer.write(iter([{"path": f"d/{i}.mid", "content": song(i + 1)} for i in range(4)]))
    with monkeypatch.context() as m:
        m.setattr(midi_format, "finish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            writer.commit([message])
    store, root, staging = writer._staging()
    todo = json.load(open(f"{staging}/moves.json"))
    os.makedirs(f"{root}/d")
    os.replace(f"{staging}/{todo['moves'][0][0]}", f"{root}/{todo['moves'][0][1]}")  # one move was made
    assert midi_format.recover(str(tmp_path)) == 1 and midi_format.recover(str(tmp_path)) == 0
    assert contents(tmp_path) == {f"d/{i}.mid": song(i + 1) for i in range(4)}
