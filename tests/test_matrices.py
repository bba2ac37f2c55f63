"""GELU, blocked products, pruning and the stage graph."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_midi import END, smf

from notewright.functions.music import erf, gelu
from notewright.operators import matrices
from notewright.plans import presets, stages


def test_erf_and_gelu(spark):
    xs = [0.0, -0.0, 0.1, 0.46875, 0.4687500001, 1.0, 2.5, 4.0, 5.9, 6.0, 30.0, float("inf")]
    xs += [random.Random(1).uniform(-6, 6) for _ in range(500)]
    xs += [-x for x in xs]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erf(F.col("x")).alias("e"), gelu(F.col("x")).alias("g")).collect()
    for r in rows:
        assert abs(r.e - math.erf(r.x)) < 1e-10
        assert math.isinf(r.x) or abs(r.g - r.x * 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 1e-9
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(erf(F.col("x")).alias("e")).collect()
    assert odd[0].e is None and math.isnan(odd[1].e)


def dense(blocks, side):
    rows = blocks.collect()
    out = np.full((max(r.i * side + r.rows for r in rows), max(r.j * side + r.cols for r in rows)), np.nan)
    for r in rows:
        out[r.i * side : r.i * side + r.rows, r.j * side : r.j * side + r.cols] = np.reshape(r.data, (r.rows, r.cols))
    return out


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (8, 4, 12), (13, 9, 4)])
def test_products(spark, shape):
    rng = np.random.default_rng(2)
    n, k, m = shape
    a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    left, right = matrices.from_array(spark, a, 4), matrices.from_array(spark, b, 4)
    assert dense(matrices.product(left, right), 4) == pytest.approx(a @ b)
    assert dense(matrices.transposed(left), 4) == pytest.approx(a.T)
    assert dense(matrices.product(matrices.transposed(right), matrices.transposed(left)), 4) == pytest.approx((a @ b).T)


def test_sizes_that_differ_fail(spark):
    with pytest.raises(Exception, match="inner sizes"):
        matrices.product(matrices.from_array(spark, np.ones((2, 3))), matrices.from_array(spark, np.ones((2, 3)))).collect()


def test_linear_maps_of_vectors(spark):
    rng = np.random.default_rng(3)
    ids = sorted(random.Random(4).sample(range(200), 50))
    x, w, b = rng.normal(size=(50, 10)), rng.normal(size=(10, 6)), rng.normal(size=6)
    down, up = rng.normal(size=(10, 2)), rng.normal(size=(2, 10))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>").repartition(3)
    out = matrices.linear(vectors, "id", "v", matrices.from_array(spark, w, 4), F.array(*[F.lit(float(y)) for y in b]), side=4)
    got = {r.id: r.v for r in out.collect()}
    assert sorted(got) == ids and np.array([got[i] for i in ids]) == pytest.approx(x @ w + b)
    gated = matrices.gated_low_rank(vectors, "id", "v", matrices.from_array(spark, down, 4), matrices.from_array(spark, up, 4), 0.3, side=4)
    got = {r.id: r.v for r in gated.collect()}
    assert np.array([got[i] for i in ids]) == pytest.approx(x + 0.3 * (x @ down @ up))


def test_pruning_like_round_after_round(spark):
    rng = random.Random(5)
    heads = [(layer, h) for layer in range(6) for h in range(10)]
    rounds = [(layer, rng.randrange(12), r) for r in range(4) for layer in range(6) for _ in range(rng.randint(0, 2))]
    frames = spark.createDataFrame(heads, "layer int, head int"), spark.createDataFrame(rounds, "layer int, head int, round int")
    got = {(r.layer, r.head): (r.kept, r.new_index) for r in matrices.pruned_indexes(*frames).collect()}
    left = {layer: list(range(10)) for layer in range(6)}
    for layer, head, _ in sorted(rounds, key=lambda r: r[2]):
        if head in left[layer]:  # the place that it has by now goes
            left[layer].pop(left[layer].index(head))
    assert got == {(layer, h): (h in left[layer], left[layer].index(h) if h in left[layer] else None) for layer, h in heads}
    weights = frames[0].withColumn("w", F.col("head") * 1.0)
    rows = matrices.pruned_rows(weights, matrices.pruned_indexes(*frames)).collect()
    assert {(r.layer, r.head, r.w) for r in rows} == {(layer, left[layer].index(h), float(h)) for layer in left for h in left[layer]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    (folder / "MIDIs" / "a").mkdir(parents=True)
    for i in range(6):
        (folder / "MIDIs" / "a" / f"{i}.mid").write_bytes(tune(24 + i, i))
    return str(folder)


def tune(notes, program):
    body = bytes([0, 0xC0, program]) + b"".join(bytes([1, 0x90, 60 + i % 20, 64, 1, 0x80, 60 + i % 20, 0]) for i in range(notes))
    return smf(body + END, resolution=2)


def shown(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_a_preset_as_stages(spark, root):
    graph = stages.preset_stages(spark, root, "la")
    assert graph.names() == ["files", "songs", "decoded", "events", "sane", "pairs", "notes", "built"]
    roll, songs = graph.built()["built"]
    want = presets.build(spark, root, "la")
    assert shown(roll) == shown(want[0]) and shown(songs) == shown(want[1]) and roll.count() > 10


def test_roots_come_from_settings(spark, root):
    with pytest.raises(ValueError, match="notewright.data.root"):
        presets.build_named(spark, "la")
    spark.conf.set("notewright.data.root", "/nowhere")
    spark.conf.set("notewright.data.MIDIs", root)
    try:
        assert presets.data_root(spark, "MIDI") == "/nowhere"
        assert shown(presets.build_named(spark, "la")[0]) == shown(presets.build(spark, root, "la")[0])
    finally:
        spark.conf.unset("notewright.data.root")
        spark.conf.unset("notewright.data.MIDIs")


def test_a_tap_changes_what_follows_and_nothing_else(spark, root):
    graph = stages.preset_stages(spark, root, "la")
    louder = graph.tapped("pairs", lambda df: df.withColumn("velocity", F.lit(99)))
    assert {r.velocity for r in louder.built("notes")["notes"].collect()} == {99}
    assert {r.velocity for r in graph.built("notes")["notes"].collect()} == {64}
    a, b = louder.built("notes"), graph.built("notes")
    assert shown(a["sane"]) == shown(b["sane"]) and shown(a["notes"].drop("velocity")) == shown(b["notes"].drop("velocity"))
    seen = []
    looked = graph.tapped("sane", lambda df: seen.append(df.columns) or df)
    assert shown(looked.built()["built"][0]) == shown(graph.built()["built"][0]) and len(seen) == 1
    twice = graph.tapped("pairs", lambda df: df.withColumn("velocity", F.lit(5))).tapped("pairs", lambda df: df.withColumn("velocity", F.col("velocity") + 1))
    assert {r.velocity for r in twice.built("pairs")["pairs"].collect()} == {6}


def test_stages_can_be_replaced(spark, root):
    graph = stages.preset_stages(spark, root, "la")
    few = graph.replaced("files", lambda m: graph.built("files")["files"].where(F.col("path").endswith("3.mid")))
    assert few.built("songs")["songs"].count() == 1 and graph.built("songs")["songs"].count() == 6
    for wrong in (lambda: graph.replaced("x", None), lambda: graph.tapped("x", None), lambda: graph.built("x"), lambda: graph.then("files", None)):
        with pytest.raises(KeyError):
            wrong()
    assert stages.Stages().then("a", lambda m: m["n"] + 1).then("b", lambda m: m["a"] * 2).built(n=3) == {"n": 3, "a": 4, "b": 8}
