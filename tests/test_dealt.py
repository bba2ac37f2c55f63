"""Tasks that hold as many rows whatever the table's size."""

import re

import pytest

from notewright.functions import order
from notewright.operators import rolls, timing
from notewright.plans import event_queries
from notewright.plans.catalog import queries
from notewright.sources.surrogates import notes

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_rows(spark, monkeypatch):
    rows = spark.range(1000)
    assert order.tasks_for(rows) == 1 and order.tasks_for(rows.limit(0)) == 1
    monkeypatch.setattr(order, "DEALT", 20)
    assert order.tasks_for(rows) == 50 and order.tasks_for(rows, 3) == 150
    assert notes(spark, SF).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["tokenize", "crop_rows", "note_pairs_ties", "order_beats", "order_downbeats", "downbeat_interval"])
def test_rows_are_dealt_by_number(spark, name, capsys, monkeypatch):
    """Every exchange of rows names its number of tasks; none is left to the shuffle partitions."""
    monkeypatch.setattr(order, "DEALT", 500)
    monkeypatch.setattr(event_queries, "tasks_for", lambda df, times=1: 11)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries()[name](spark, SF).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


def planned(df, capsys) -> list[str]:
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df.explain()
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return capsys.readouterr().out.splitlines()


@pytest.mark.parametrize("name", ["self_parts", "swap_parts", "step_counts"])
def test_rolls_in_parts_are_dealt_by_number(spark, name, capsys, monkeypatch):
    monkeypatch.setattr(order, "DEALT", 500)
    exchanges = [line for line in planned(queries()[name](spark, SF), capsys) if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0], exchanges


@pytest.mark.parametrize("name", ["self_parts", "swap_parts", "step_counts"])
def test_only_columns_of_the_lines_are_dealt(spark, name, capsys, monkeypatch):
    """What is made from a line is made after the exchange, so a reading task holds six columns a line."""
    monkeypatch.setattr(order, "DEALT", 500)
    plan = planned(queries()[name](spark, SF), capsys)
    at = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line)
    dealt = re.sub(r"#\d+L?", "", plan[at + 1].split("[")[1].split("]")[0]).split(", ")
    assert sorted(dealt) == ["l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_suppkey AS song"]


@pytest.mark.parametrize("name", ["roll_sorted_with_end", "tokenize", "tokenize_velocity", "detokenize", "ended_flags", "all_ended"])
def test_marked_roll_is_made_once(spark, name, capsys, monkeypatch):
    """Lines are read for the roll and for the songs' lengths, and rows of songs are dealt once for each."""
    monkeypatch.setattr(order, "DEALT", 500)
    plan = planned(queries()[name](spark, SF), capsys)
    exchanges = [line for line in plan if "Exchange hashpartitioning(song" in line]
    assert len(exchanges) == 2 and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges
    assert sum("FileScan parquet" in line for line in plan) == 2
    assert [line for line in plan if "Exchange" in line and "hashpartitioning(song" not in line and "hashpartitioning(step" not in line] == []


def test_markers_of_every_part_stand_after_its_slots(spark):
    kinds = "song long, part int, step int, slot int, program int, pitch int, dur int, velocity int"
    roll = spark.createDataFrame([(1, 0, 0, 0, 1, 60, 1, 9), (1, 1, 1, 0, 2, 61, 1, 9), (1, 1, 1, 1, 3, 62, 1, 9), (2, 0, 0, 0, 4, 63, 1, 9)], kinds)
    marked = rolls.with_end_markers(roll, spark.createDataFrame([(1, 2), (3, 1)], "song long, length int"), 2, 2)
    assert marked.dtypes == roll.dtypes
    assert sorted(map(tuple, marked.where("program <> 254").collect())) == sorted(map(tuple, roll.collect()))
    found = sorted((r.song, r.part, r.step, r.slot) for r in marked.where("program = 254 AND pitch IS NULL AND dur IS NULL AND velocity IS NULL").collect())
    assert found == [(1, 0, 0, 1), (1, 0, 1, 0), (1, 1, 0, 0), (3, 0, 0, 0), (3, 1, 0, 0)]


def test_markers_only_within_the_length(spark):
    roll = spark.createDataFrame([(1, 0, 0, 0, 1, 60, 1, 9), (1, 0, 0, 1, 1, 61, 1, 9), (1, 0, 5, 0, 1, 60, 1, 9)], "song long, part int, step int, slot int, program int, pitch int, dur int, velocity int")
    marked = rolls.with_end_markers(roll, spark.createDataFrame([(1, 2)], "song long, length int"), 1, 2)
    assert [(r.step, r.slot) for r in marked.where("program = 254").collect()] == [(1, 0)]


def test_beats_give_way_to_the_next_signature(spark):
    tempi = spark.createDataFrame([(1, 0.0, 60.0)], "song long, time double, qpm double")
    meters = spark.createDataFrame([(1, 0.0, 4, 4), (1, 1.5, 3, 4)], "song long, time double, numerator int, denominator int")
    beats = timing.song_beats(tempi, meters, spark.createDataFrame([(1, 4.0)], "song long, end double"))
    assert [r.time for r in beats.orderBy("beat_idx").collect()] == [0.0, 1.0, 1.5, 2.5, 3.5]


def test_downbeats_make_beats_once(spark, capsys):
    """Beside what order_beats reads, only the meters are read, and nothing is dealt by beat."""
    plans = {name: planned(queries()[name](spark, SF), capsys) for name in ("order_beats", "order_downbeats")}
    reads = {name: sum("FileScan parquet" in line for line in plan) for name, plan in plans.items()}
    assert reads["order_downbeats"] == reads["order_beats"] + 1
    assert not any("Exchange hashpartitioning" in line and "beat_idx" in line for line in plans["order_downbeats"])


def spans_by_walk(times, signatures):
    """(k, beat_idx) of a song by the definition."""
    given = sorted(signatures)
    if times and (not given or given[0][0] > 0):
        given = [(0.0, 4), *given]
    close = lambda at: next((i for i, t in enumerate(times) if abs(t - at) <= 1e-8 + 1e-5 * abs(at)), None)
    out, ended = [], 0
    for k, (at, numerator) in enumerate(given):
        here, is_last = close(at), k + 1 == len(given)
        begin = here if here is not None else ended if is_last else 0
        there = None if is_last else close(given[k + 1][0])
        stop = len(times) if is_last else there if there is not None else begin
        out += [(k + 1, i) for i in range(begin, stop, numerator // 3 if numerator % 3 == 0 and numerator != 3 else numerator)]
        ended = stop
    return out


def test_downbeats_by_walk(spark):
    """Signatures on beats, close to them and between them; spans that overlap; songs without either."""
    times = [i * 0.5 for i in range(40)]
    songs = {
        1: [(2.25, 3), (8.0, 6), (12.3, 2)], 2: [], 3: [(0.0, 3), (4.0, 9), (4.25, 2), (10.0, 5)], 4: [(-1.0, 2), (0.0, 3)], 5: [(6.0 + 1e-6, 4), (9.0 - 1e-6, 3)],
        6: [(1.0, 2), (1.25, 3), (15.0, 2), (16.25, 1), (18.0, 12)], 7: [(30.0, 2)],
    }
    beats = spark.createDataFrame([(s, i, t) for s in songs for i, t in enumerate(times)], "song long, beat_idx int, time double").repartition(3)
    signatures = spark.createDataFrame([(s, t, n) for s, given in songs.items() for t, n in given] + [(8, 1.0, 4)], "song long, time double, numerator int")
    out = timing.downbeats(beats, signatures)
    assert out.dtypes == [("song", "bigint"), ("k", "int"), ("beat_idx", "int"), ("time", "double")]
    want = sorted((s, k, i, times[i]) for s, given in songs.items() for k, i in spans_by_walk(times, given))
    assert sorted(map(tuple, out.collect())) == want
