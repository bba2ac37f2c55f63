"""Note and event views over the driver's tables, so the operators can be checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.functions.order import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note(song, track, is_drum, program, pitch, velocity, start, end, len, seq) from lineitem, dealt by song."""
    s, ln, q = F.col("song"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    dd = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    odd = F.when(s % 8 == 0, 20).when(s % 8 == 4, 11).when(s % 8 == 2, 17)
    start = (
        F.when(odd.isNotNull(), (2 * (dd % 128) + F.when(dd % 20 < odd, 1).otherwise(0)).cast("double"))
        .when((ln + s) % 3 == 0, (dd % 256 - dd % 4).cast("double"))
        .otherwise(dd % 256 + (q % 16) / F.lit(16.0))
    )
    arrival = Window.partitionBy("song").orderBy("l_linenumber", "l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    # The lines' own columns are dealt and what follows from them is added after that: a reading task
    # holds all that it deals out in memory where there are many tasks to deal to.
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "song")
    return (
        lines.repartition(tasks_for(lines), "song")
        .withColumn("seq", F.row_number().over(arrival).cast("long"))
        .withColumns({"len": q, "start": start})
        .select(
            "song",
            (ln - 1).alias("track"),
            (ln == 7).alias("is_drum"),
            F.when(ln == 7, 127).otherwise((ln * 17) % 127).alias("program"),
            (36 + F.col("l_partkey") % 48).cast("int").alias("pitch"),
            (q + 49).alias("velocity"),
            "start",
            (F.col("start") + F.col("len")).alias("end"),
            "len",
            "seq",
        )
    )


def midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """midi_event(song, track, channel, idx, type, note, program, tempo, tick) from events."""
    kinds = {"click": "note_on", "view": "note_off", "signup": "program_change", "error": "set_tempo", "purchase": "time_signature"}
    kind = F.col("event_type")
    named = F.lit(None).cast("string")
    for source, target in kinds.items():
        named = F.when(kind == source, target).otherwise(named)
    k = F.get_json_object("props", "$.k").cast("int")
    order = Window.partitionBy("song").orderBy("event_id")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("song"), "event_id", "ts", named.alias("type"), k.alias("k"), F.col("value").alias("tempo"))
        .select(
            "song",
            F.lit(0).alias("track"),
            F.lit(0).alias("channel"),
            F.row_number().over(order).alias("idx"),
            "type",
            (F.col("k") % 4).alias("note"),
            F.col("k").alias("program"),
            "tempo",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"),
        )
    )
