"""Queries over embeddings and derived scores: attention, positions, losses, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.music import gelu
from notewright.operators import attention, matrices, metrics, parameters
from notewright.plans.base import Registry, with_views
from notewright.sources.surrogates import table

R = Registry()

# The vectors of a label are one sequence; each attends to all of its own.
def _attention_sql(condition: str) -> str:
    return f"""
pairs AS (
  SELECT q.vec_id AS q_pos, k.vec_id AS k_pos, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) / 8 AS score, k.embedding AS v
  FROM embeddings q JOIN embeddings k ON {condition}),
weighed AS (SELECT q_pos, k_pos, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY q_pos) AS weight, v FROM (SELECT *, max(score) OVER (PARTITION BY q_pos) AS top FROM pairs))
"""


PAIRS = _attention_sql("q.label = k.label")
CAUSAL_PAIRS = _attention_sql("q.label = k.label AND k.vec_id <= q.vec_id")
WHOLE = _attention_sql("q.vec_id % 50 = 0")
SEQUENCE = ["label"]


def _vectors(spark: SparkSession, sf: str, pos: str, name: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("label", F.col("vec_id").alias(pos), F.col("embedding").alias(name))


def _weights(spark: SparkSession, sf: str, causal: bool = False) -> DataFrame:
    """Every vector with all of its label."""
    return attention.attention_weights(_vectors(spark, sf, "q_pos", "q"), _vectors(spark, sf, "k_pos", "k"), group=SEQUENCE, causal=causal, size=64, digits=6)


def _attended(spark: SparkSession, sf: str, causal: bool = False) -> DataFrame:
    """Outputs of all vectors over those of their label, block by block."""
    keys = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("k_pos"), F.col("embedding").alias("k"))
    out = attention.attended(_vectors(spark, sf, "q_pos", "q"), keys, group=SEQUENCE, causal=causal, size=64)
    return out.select("q_pos", F.posexplode("value").alias("dim", "value")).withColumn("value", F.round("value", 5) + 0.0)


@R.add("attention_weights", with_views(PAIRS, then="SELECT q_pos, k_pos, round(weight, 6) AS weight FROM weighed"))
def attention_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select("q_pos", "k_pos", "weight")


@R.add("attention_output", with_views(PAIRS, then="SELECT q_pos, CAST(dim - 1 AS INTEGER) AS dim, round(sum(weight * x), 5) + 0.0 AS value FROM (SELECT q_pos, weight, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM weighed) GROUP BY q_pos, dim"))
def attention_output(spark: SparkSession, sf: str) -> DataFrame:
    return _attended(spark, sf)


@R.add("causal_attention_output", with_views(CAUSAL_PAIRS, then="SELECT q_pos, CAST(dim - 1 AS INTEGER) AS dim, round(sum(weight * x), 5) + 0.0 AS value FROM (SELECT q_pos, weight, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM weighed) GROUP BY q_pos, dim"))
def causal_attention_output(spark: SparkSession, sf: str) -> DataFrame:
    return _attended(spark, sf, causal=True)


@R.add("causal_attention", with_views(CAUSAL_PAIRS, then="SELECT q_pos, k_pos, round(weight, 6) AS weight FROM weighed"))
def causal_attention(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf, causal=True).select("q_pos", "k_pos", "weight")


@R.add("attention_query_set", with_views(WHOLE, then="SELECT q_pos, k_pos, round(weight, 6) AS weight FROM weighed"))
def attention_query_set(spark: SparkSession, sf: str) -> DataFrame:
    """A stated query set, the vectors whose vec_id is divisible by 50, against all vectors in blocks."""
    asked = _vectors(spark, sf, "q_pos", "q").where(F.col("q_pos") % 50 == 0).drop("label")
    return attention.attention_weights(asked, _vectors(spark, sf, "k_pos", "k").drop("label"), size=64, digits=6)


POSITIONS = """
SELECT vec_id, CAST(i AS INTEGER) AS dim, round(CASE WHEN i < 8 THEN sin(vec_id / pow(10000.0::DOUBLE, 2.0 * i / 16)) ELSE cos(vec_id / pow(10000.0::DOUBLE, 2.0 * (i - 8) / 16)) END, 6) + 0.0 AS value
FROM embeddings CROSS JOIN (SELECT unnest(range(0, 16)) AS i)
"""


@R.add("positions_sinusoid", POSITIONS)
def positions_sinusoid(spark: SparkSession, sf: str) -> DataFrame:
    rows = attention.sinusoid_positions(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 16)
    return rows.select("vec_id", F.posexplode("encoding").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


ROTARY = """
SELECT vec_id, CAST(i AS INTEGER) AS dim,
       round(CASE WHEN i % 2 = 0 THEN x * cos(a) - y * sin(a) ELSE y * cos(a) + x * sin(a) END, 5) + 0.0 AS value
FROM (SELECT vec_id, i, CAST(embedding[(i // 2) * 2 + 1] AS DOUBLE) AS x, CAST(embedding[(i // 2) * 2 + 2] AS DOUBLE) AS y, vec_id / pow(10000.0::DOUBLE, 2.0 * (i // 2) / 64) AS a
      FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS i))
"""


@R.add("rotary_positions", ROTARY)
def rotary_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = attention.sinusoid_positions(table(spark, sf, "embeddings"), "vec_id", 64)
    turned = attention.rotary(rows, "embedding", "encoding").select("vec_id", F.posexplode("rotated").alias("dim", "value"))
    return turned.withColumn("value", F.round("value", 5) + 0.0)


@R.add("layer_norm", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round((x - m) / sqrt(s + 1e-12), 4) + 0.0 AS value FROM (SELECT vec_id, x, i, avg(x) OVER (PARTITION BY vec_id) AS m, var_pop(x) OVER (PARTITION BY vec_id) AS s FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))")
def layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.layer_norm(table(spark, sf, "embeddings"), "embedding").select("vec_id", F.posexplode("normed").alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 4) + 0.0)


@R.add("one_hot", "SELECT vec_id, CAST(i AS INTEGER) AS dim, CASE WHEN label = i THEN 1 ELSE 0 END AS hot FROM embeddings CROSS JOIN (SELECT unnest(range(0, 16)) AS i)")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.one_hot(table(spark, sf, "embeddings"), "label", 16).select("vec_id", F.posexplode("one_hot").alias("dim", "hot"))


# A token's probability is 1 / l_quantity; returned lines stand for pads.
SCORED = "scored AS (SELECT l_suppkey AS song, 1.0::DOUBLE / l_quantity AS prob, CASE WHEN l_returnflag = 'R' THEN 3330 ELSE l_linenumber END AS token FROM lineitem)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    token = F.when(F.col("l_returnflag") == "R", 3330).otherwise(F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("song"), (1.0 / F.col("l_quantity")).alias("prob"), token.alias("token"))


@R.add("cross_entropy", with_views(SCORED, then="SELECT round(avg(-ln(prob)), 6) AS cross_entropy, count(*) AS tokens FROM scored WHERE token <> 3330"))
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cross_entropy(_scored(spark, sf)).withColumn("cross_entropy", F.round("cross_entropy", 6))


@R.add("perplexity", with_views(SCORED, then="SELECT song, round(exp(sum(-ln(prob)) / count(*)), 6) AS perplexity FROM scored WHERE token <> 3330 GROUP BY song"))
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.song_perplexity(_scored(spark, sf)).withColumn("perplexity", F.round("perplexity", 6))


@R.add("perplexity_summary", with_views(SCORED, then="SELECT round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std FROM (SELECT exp(sum(-ln(prob)) / count(*)) AS p FROM scored WHERE token <> 3330 GROUP BY song)"))
def perplexity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.perplexity_summary(metrics.song_perplexity(_scored(spark, sf))).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@R.add("softmax_temperature", "SELECT vec_id, dim, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS weight FROM (SELECT vec_id, dim, exp((x - max(x) OVER (PARTITION BY vec_id)) / 0.7) AS e FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings))")
def softmax_temperature(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return metrics.softmax(rows, ["vec_id"], "x", 0.7).select("vec_id", "dim", F.round("weight", 6).alias("weight"))


@R.add("log_sum_exp", "SELECT vec_id, round(ln(sum(exp(CAST(x AS DOUBLE)))), 6) AS lse FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i % 2 = 1 GROUP BY vec_id")
def log_sum_exp(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return metrics.log_sum_exp(rows, ["vec_id"], "x", F.col("dim") % 2 == 0).withColumn("lse", F.round("lse", 6))


@R.add("argmax_token", "SELECT vec_id, CAST(arg_max(i, CAST(x AS DOUBLE)) - 1 AS INTEGER) AS dim FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id")
def argmax_token(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return metrics.arg_max(rows, ["vec_id"], "x", "dim")


@R.add("top10_metric", "SELECT o_orderkey AS step, o_totalprice AS val_loss FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def top10_metric(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_checkpoints(table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("val_loss")))


STOP = """
SELECT run, step, best, CAST(waited AS INTEGER) AS waited, max(CASE WHEN waited >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY step) = 1 AS stop
FROM (SELECT *, nth - max(CASE WHEN better THEN nth END) OVER (PARTITION BY run ORDER BY step) AS waited
      FROM (SELECT o_custkey AS run, o_orderkey AS step, min(o_totalprice) OVER w AS best, row_number() OVER w AS nth,
                   coalesce(o_totalprice < min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
            FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)))
"""


@R.add("early_stop", STOP)
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("val_loss"))
    return metrics.early_stop(log, 5).drop("val_loss")


@R.add("shift_right", "SELECT o_custkey, o_orderkey, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS previous FROM orders")
def shift_right(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return metrics.shifted_right(rows, ["o_custkey"], "o_orderkey", "o_totalprice", F.lit(-1.0)).drop("o_totalprice")


# The weight at (i, j) of a linear map from 64 inputs to 48 outputs.
LINEAR = """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
w AS (SELECT i, j, ((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 48)) AS j))
SELECT vec_id, CAST(j AS INTEGER) AS dim, round(sum(x * w), 5) + 0.0 AS value FROM x JOIN w USING (i) GROUP BY vec_id, j
"""


@R.add("linear_map", LINEAR)
def linear_map(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    weight = matrices.from_array(spark, np.fromfunction(lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 10.0, (64, 48)), 32)
    out = matrices.linear(table(spark, sf, "embeddings"), "vec_id", "embedding", weight, side=32)
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5) + 0.0)


@R.add("gram_matrix", "SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(CAST(embedding[i] AS DOUBLE) * CAST(embedding[j] AS DOUBLE)), 4) + 0.0 AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j")
def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The products of every two dimensions, summed over all vectors: the inner index is the vectors'."""
    blocks = matrices.from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 128).drop("ids")
    cells = matrices.product(matrices.transposed(blocks), blocks).select("i", "j", "cols", F.posexplode("data").alias("at", "value"))
    place = lambda block, at: (F.col(block) * 128 + at).cast("int").alias(block)
    return cells.select(place("i", F.floor(F.col("at") / F.col("cols"))), place("j", F.col("at") % F.col("cols")), (F.round("value", 4) + 0.0).alias("value"))


# The error function by its series of positive terms.
GELU = """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
z AS (SELECT *, abs(x) / sqrt(2.0::DOUBLE) AS z FROM x)
SELECT vec_id, CAST(dim AS INTEGER) AS dim,
       round(x * 0.5 * (1 + CASE WHEN z = 0 THEN 0 ELSE sign(x) * 2 / sqrt(pi()) * exp(-z * z) * z
         * list_sum(list_transform(range(0, 120), lambda n: exp(n * ln(2 * z * z) - ((n + 1) * ln(2.0::DOUBLE) + lgamma(n + 1.5) - 0.5 * ln(pi()))))) END), 6) + 0.0 AS value
FROM z
"""


@R.add("gelu", GELU)
def gelu_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.select("vec_id", "dim", (F.round(gelu(F.col("x").cast("double")), 6) + 0.0).alias("value"))


# A supplier's parts are a layer's heads; returned lines prune theirs, by month.
PRUNED = """
WITH heads AS (SELECT DISTINCT l_suppkey AS layer, l_partkey AS head FROM lineitem),
asked AS (SELECT l_suppkey AS layer, l_partkey AS head, min(month(l_shipdate)) AS pruned_in FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT layer, head, pruned_in IS NULL AS kept, CAST(pruned_in AS INTEGER) AS pruned_in,
       CASE WHEN pruned_in IS NULL THEN count(*) FILTER (WHERE pruned_in IS NULL) OVER (PARTITION BY layer ORDER BY head) - 1 END AS new_index
FROM heads LEFT JOIN asked USING (layer, head)
"""


@R.add("pruned_heads", PRUNED)
def pruned_heads(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("layer"), F.col("l_partkey").alias("head"), F.month("l_shipdate").alias("round"), "l_returnflag")
    return matrices.pruned_indexes(lines.select("layer", "head").distinct(), lines.where("l_returnflag = 'R'").select("layer", "head", "round"))


LOADED = """
SELECT 'v' || vec_id AS name, label % 3 <> 0 AS trainable, CASE WHEN label % 2 = 0 THEN -CAST(embedding[64] AS DOUBLE) ELSE CAST(embedding[64] AS DOUBLE) END AS value FROM embeddings
"""


@R.add("parameter_load", LOADED)
def parameter_load(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as a model's named arrays in blocks of 24; a set with those of even labels, negated, and
    with names that the model lacks is loaded over them."""
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda b: F.struct(b.cast("long").alias("block"), F.slice("values", b * 24 + 1, 24).alias("data"))))
    named = table(spark, sf, "embeddings").withColumn("values", F.col("embedding").cast("array<double>"))
    model = named.select(F.concat(F.lit("v"), "vec_id").alias("name"), F.array(F.lit(64).cast("long")).alias("shape"), (F.col("label") % 3 != 0).alias("trainable"), "label", cut.alias("b")).select("name", "shape", "trainable", "label", "b.*")
    negated = model.where("label % 2 = 0").withColumn("data", F.transform("data", lambda x: -x)).drop("label")
    given = negated.unionByName(negated.withColumn("name", F.concat(F.lit("old."), "name")))
    return parameters.load(model.drop("label"), given).where("block = 2").select("name", "trainable", F.element_at("data", -1).alias("value"))
