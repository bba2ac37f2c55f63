"""Corpus tables: song index, offsets, splits, shift clamps, and their Parquet sinks and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.order import global_index, running_total

#: Transposition limits in training, remainders of the song index by split.
SHIFT_LEAST, SHIFT_MOST = -5, 6
SPLITS = ("train", "val", "test", "all")


def song_index(songs: DataFrame, path_col: str = "relpath") -> DataFrame:
    """Adds i, the song's position from 0 in path order."""
    return global_index(songs, [path_col], "i").withColumn("i", F.col("i").cast("int"))


def song_offsets(lengths: DataFrame) -> DataFrame:
    """(song, length, offset): where a song starts in the concatenated corpus."""
    return running_total(lengths.select("song", "length"), ["song"], F.col("length"), "offset")


def split_of(index: Column) -> Column:
    """train, val or test by the song's original index modulo 10."""
    rest = F.pmod(index, F.lit(10))
    return F.when(rest == 0, "test").when(rest == 1, "val").otherwise("train")


def in_split(songs: DataFrame, split: str, index_col: str = "song") -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"split is one of {SPLITS}")
    return songs if split == "all" else songs.where(split_of(F.col(index_col)) == split)


def long_enough(songs: DataFrame, target_length: int) -> DataFrame:
    return songs.where(F.col("length") >= target_length)


def clamped_shifts(songs: DataFrame, split: Column) -> DataFrame:
    """Limits shifts to what training uses; outside training there are none."""
    train = split == "train"
    return songs.withColumns(
        {
            "shift_min": F.when(train, F.greatest(F.col("shift_min"), F.lit(SHIFT_LEAST))).otherwise(0),
            "shift_max": F.when(train, F.least(F.col("shift_max"), F.lit(SHIFT_MOST))).otherwise(0),
        }
    )


def write_corpus(roll: DataFrame, songs: DataFrame, path: str, preset: str, mode: str = "overwrite") -> None:
    """Writes roll and songs under path, partitioned by preset; rolls are sorted by song, so that a
    song's rows lie together and footers prune."""
    for frame, name, keys in ((roll, "roll", ["song", "part", "step", "slot"]), (songs, "songs", ["song"])):
        frame.repartition("song").sortWithinPartitions(*keys).write.mode(mode).parquet(f"{path}/{name}/preset={preset}")


def read_corpus(spark: SparkSession, path: str, preset: str | None = None) -> tuple[DataFrame, DataFrame]:
    frames = [spark.read.parquet(f"{path}/{name}") for name in ("roll", "songs")]
    if preset is not None:
        frames = [f.where(F.col("preset") == preset) for f in frames]
    return frames[0], frames[1]


def write_index(songs: DataFrame, path: str) -> None:
    """Index files: position, tab, relative path. Each part holds a range of positions, in order."""
    song_index(songs).select("i", "relpath").orderBy("i").write.mode("overwrite").option("sep", "\t").csv(path)


def not_yet_written(wanted: DataFrame, written: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose output does not exist yet."""
    return wanted.join(written.select(key), key, "left_anti")
