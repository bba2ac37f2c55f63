"""Metric log, retention and parameter sets."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.operators import metrics, parameters
from notewright.operators.training_log import LOG, MetricLog, Retention, StreamMetrics
from notewright.sources import store


def test_observed_metrics_reach_the_log(spark, tmp_path):
    log = MetricLog(spark, str(tmp_path / "log"))
    for step, loss in enumerate([4.0, 2.0, 3.0, 1.0, 5.0]):
        df, done = log.observed(spark.range(10), "a", step, val_loss=F.avg(F.lit(loss)), n=F.count("*"), nothing=F.max(F.lit(None).cast("double")))
        df.write.format("noop").mode("overwrite").save()
        done()
    assert log.read().count() == 10
    log.append("a", 4, {"val_loss": 5.0, "n": 10})  # a step that ran again
    wide = log.wide("val_loss", "n").orderBy("step").collect()
    assert [(r.step, r.val_loss, r.n) for r in wide] == [(0, 4.0, 10), (1, 2.0, 10), (2, 3.0, 10), (3, 1.0, 10), (4, 5.0, 10)]
    best = metrics.best_checkpoints(log.wide("val_loss"), 2)
    assert [r.step for r in best.collect()] == [3, 1]
    stop = metrics.early_stop(log.wide("val_loss"), 2).orderBy("step").collect()
    assert [(r.best, r.waited, r.stop) for r in stop] == [(4.0, 0, False), (2.0, 0, False), (2.0, 1, False), (1.0, 0, False), (1.0, 1, False)]


def test_a_stream_logs_while_it_runs(spark, tmp_path):
    log = MetricLog(spark, str(tmp_path / "log"))
    spark.createDataFrame([("x", 1.0)], "k string, loss double").write.parquet(str(tmp_path / "in"))
    listener = StreamMetrics(log, "scores")
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.createDataFrame([("x", float(i)), ("y", 10.0)], "k string, loss double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = spark.readStream.schema("k string, loss double").parquet(str(tmp_path / "in")).observe("scores", F.avg("loss").alias("val_loss"), F.count("*").alias("n"))
            query = rows.writeStream.queryName("run").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.run, r.step, r.metric): r.value for r in log.read().collect()}
    assert sum(v for (_, _, m), v in got.items() if m == "n") == 7 and {r for r, _, _ in got} == {"run"}
    assert len({s for _, s, _ in got}) == 3


def put(values):
    return lambda folder: (os.makedirs(folder), open(f"{folder}/data", "w").write(values))


def test_the_best_and_the_last_are_kept(tmp_path):
    kept = Retention(str(tmp_path), 3)
    losses = [5.0, 4.0, 4.0, 6.0, 4.0, float("nan"), 3.0, 9.0]
    for step, loss in enumerate(losses):
        best = kept.offer(step, loss, put(str(step)))
        ranked = sorted((x, s) for s, x in enumerate(losses[: step + 1]) if x == x)[:3]
        held, last = kept.manifest()
        assert [(k.loss, k.step) for k in held] == ranked and last.step == step and best == ((loss, step) in ranked)
        folders = store.folders(str(tmp_path))
        assert set(folders) == {k.folder for k in held} | {last.folder}
        assert {open(f"{tmp_path}/{k.folder}/data").read() for k in held} == {str(k.step) for k in held}
    assert kept.offer(6, 8.0, put("again")) and [k.step for k in kept.manifest()[0]] == [1, 2, 6]  # in place of its own earlier set


@pytest.mark.parametrize("when", ["write", "swap", "sweep"])
def test_crashes(tmp_path, monkeypatch, when):
    kept = Retention(str(tmp_path), 2)
    for step, loss in enumerate([3.0, 2.0]):
        kept.offer(step, loss, put(str(step)))
    before = kept.manifest()

    def lost(*a):
        raise OSError("lost")

    def half(folder):
        os.makedirs(folder)
        lost()

    with monkeypatch.context() as m:
        if when == "swap":
            m.setattr(store, "swap_json", lost)
        if when == "sweep":
            m.setattr(Retention, "sweep", lost)
        with pytest.raises(OSError):
            kept.offer(2, 1.0, half if when == "write" else put("2"))
    held, last = kept.manifest()
    assert (held, last) == before if when != "sweep" else [k.step for k in held] == [2, 1]
    assert all(os.path.exists(f"{tmp_path}/{k.folder}/data") for k in [*held, last])
    assert kept.sweep() == 1 and kept.sweep() == 0
    assert kept.offer(3, 0.5, put("3")) and json.load(open(tmp_path / "manifest.json"))["last"][1] == 3


ARRAYS = {"head.weight": np.arange(12.0).reshape(3, 4), "head.bias": np.array([1.0, 2.0]), "scale": np.array(7.0), "none": np.zeros((0, 3))}


def same(a, b):
    return a.keys() == b.keys() and all(np.array_equal(a[n], b[n]) and a[n].shape == b[n].shape for n in a)


def test_parameters_round_trip(spark, tmp_path):
    table = parameters.parameters(spark, ARRAYS, frozen=["scale"], size=5)
    parameters.save(table, str(tmp_path / "all"))
    assert same(parameters.arrays(parameters.read(spark, str(tmp_path / "all"))), ARRAYS)
    parameters.save(table, str(tmp_path / "part"), only=parameters.trainable())
    assert set(parameters.arrays(parameters.read(spark, str(tmp_path / "part")))) == set(ARRAYS) - {"scale"}


def test_loading_by_name(spark):
    model = parameters.parameters(spark, ARRAYS, size=5)
    given = {"head.weight": -np.arange(12.0).reshape(3, 4), "old.positions": np.ones(3), "scale": np.array(9.0)}
    loaded = parameters.parameters(spark, given, size=5)
    assert {r.name: r.status for r in parameters.report(model, loaded, ["old.positions"]).collect()} == {
        "head.weight": "loaded", "head.bias": "missing", "scale": "loaded", "none": "missing", "old.positions": "ignored",
    }
    got = parameters.arrays(parameters.load(model, loaded))
    assert same(got, ARRAYS | {"head.weight": given["head.weight"], "scale": given["scale"]})
    with pytest.raises(ValueError, match="head.bias: missing.*old.positions: surplus"):
        parameters.load(model, loaded, strict=True)
    wrong = parameters.parameters(spark, {"head.bias": np.ones((2, 1))})
    with pytest.raises(ValueError, match="head.bias: shape"):
        parameters.load(model, wrong)
    assert same(parameters.arrays(parameters.load(model, wrong, ignored=["head.bias"])), ARRAYS)


def test_a_set_of_parameters_under_retention(spark, tmp_path):
    kept = Retention(str(tmp_path), 1)
    for step, loss in enumerate([2.0, 1.0]):
        table = parameters.parameters(spark, {"w": np.full(4, float(step))})
        kept.offer(step, loss, lambda folder, table=table: parameters.save(table, folder))
    best = kept.manifest()[0][0]
    assert parameters.arrays(parameters.read(spark, f"{tmp_path}/{best.folder}"))["w"].tolist() == [1.0] * 4
    assert LOG.startswith("run")
