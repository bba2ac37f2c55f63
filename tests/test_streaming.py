"""Files that arrive: lasting numbers, restarts, rejects kept apart."""

import os
import shutil

import pytest
from test_midi_format import song

from notewright.streaming import ingest


def table(spark, path):
    return spark.read.parquet(path) if os.path.exists(path) else None


def numbers(spark, out):
    """Each path's songs, over events and rejects."""
    found = {}
    for name in ("events", "rejects"):
        for r in spark.read.parquet(f"{out}/{name}").select("path", "song").distinct().collect():
            found.setdefault(os.path.basename(r.path), []).append(r.song)
    return found


def run(spark, root, **kw):
    query = ingest.ingest_stream(spark, f"{root}/in", f"{root}/out", f"{root}/state", buckets=4, **kw)
    query.awaitTermination(240)
    assert query.exception() is None


@pytest.fixture
def root(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def put(root, name, content):
    (root / "in" / name).write_bytes(content)


def test_numbers_last_over_restarts(spark, root):
    for i in range(9):
        put(root, f"a{i}.mid", song(i + 1))
    put(root, "bad.mid", song(3)[:-2])
    run(spark, root, files_per_trigger=4)
    first = numbers(spark, f"{root}/out")
    assert len(first) == 10 and all(len(s) == 1 for s in first.values()) and len({s[0] for s in first.values()}) == 10
    rejects = spark.read.parquet(f"{root}/out/rejects").collect()
    assert [os.path.basename(r.path) for r in rejects] == ["bad.mid"] and rejects[0].status != "ok"
    events = {os.path.basename(r.path): r["count"] for r in spark.read.parquet(f"{root}/out/events").groupBy("path").count().collect()}
    assert events == {f"a{i}.mid": 2 * (i + 1) + 2 for i in range(9)}

    for i in range(5):
        put(root, f"b{i}.MID", song(2))
    run(spark, root)
    second = numbers(spark, f"{root}/out")
    assert len(second) == 15 and {k: second[k] for k in first} == first
    assert len({s[0] for s in second.values()}) == 15

    run(spark, root)  # nothing new
    assert numbers(spark, f"{root}/out") == second


def test_a_batch_that_runs_again_replaces_itself(spark, root):
    """The last batch's commit is lost, as when a driver dies after writing: it runs again from state."""
    for i in range(6):
        put(root, f"a{i}.mid", song(i + 1))
    run(spark, root, files_per_trigger=3)
    before = numbers(spark, f"{root}/out")
    commits = sorted(n for n in os.listdir(f"{root}/state/commits") if n.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{root}/state/commits/{name}"):
            os.remove(f"{root}/state/commits/{name}")
    shutil.rmtree(f"{root}/out/events/batch={commits[-1]}")
    put(root, "late.mid", song(1))
    run(spark, root)
    after = numbers(spark, f"{root}/out")
    assert set(after) == {*before, "late.mid"} and all(len(s) == 1 for s in after.values()) and len({s[0] for s in after.values()}) == 7
