"""Song gates: how well onsets sit on the beat, how dense tracks are, which songs stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.music import SUBBEATS, off_beat, on_group, step_of

#: Tracks of at most 20 notes are not scored; bounds of the score and of densities.
SCORED_NOTES = 20
QUANTISED, OFF_BEAT = 0.45, 0.65
LEAST_DENSE, MOST_DENSE = 0.7, 0.8


def onset_histogram(notes: DataFrame, division: int = SUBBEATS) -> DataFrame:
    """(song, track, subbeat, n): onsets of a track by subbeat of the beat."""
    subbeat = F.pmod(step_of(F.col("start")), F.lit(division))
    return notes.groupBy("song", "track", subbeat.alias("subbeat")).agg(F.count("*").alias("n"))


def quantisation_scores(notes: DataFrame, division: int = SUBBEATS) -> DataFrame:
    """(song, score): the least share of off-beat onsets over tracks of more than 20 notes; 1.0
    where a song has no such track."""
    tracks = notes.groupBy("song", "track").agg(
        F.count("*").alias("n"), F.count_if(off_beat(step_of(F.col("start")), division)).alias("off")
    )
    scored = F.min(F.when(F.col("n") > SCORED_NOTES, F.col("off") / F.col("n")))
    return tracks.groupBy("song").agg(F.coalesce(scored, F.lit(1.0)).alias("score"))


def quantisation_gate(notes: DataFrame, division: int = SUBBEATS) -> DataFrame:
    """(song, score) of the songs that stay: well quantised, or wholly off the beat but not 1.0."""
    score = F.col("score")
    return quantisation_scores(notes, division).where((score <= QUANTISED) | ((score > OFF_BEAT) & (score < 1.0)))


def track_density(notes: DataFrame, group: int = 4) -> DataFrame:
    """(song, track, density): the share of a track's onsets on multiples of group."""
    hit = F.when(on_group(step_of(F.col("start")), group), 1.0).otherwise(0.0)
    return notes.groupBy("song", "track").agg(F.avg(hit).alias("density"))


def density_gate(densities: DataFrame) -> DataFrame:
    """(song, least, most) of songs with several tracks, one below 0.7 and one above 0.8."""
    return (
        densities.groupBy("song")
        .agg(F.count("*").alias("tracks"), F.min("density").alias("least"), F.max("density").alias("most"))
        .where((F.col("tracks") > 1) & (F.col("least") < LEAST_DENSE) & (F.col("most") > MOST_DENSE))
        .select("song", "least", "most")
    )


def tempo_drum_gate(tempo_changes: DataFrame, drum_songs: DataFrame, more_than: int = 3) -> DataFrame:
    """(song, changes) of songs with more than so many tempo changes and a drum track."""
    return (
        tempo_changes.groupBy("song")
        .agg(F.count("*").alias("changes"))
        .where(F.col("changes") > more_than)
        .join(drum_songs.select("song"), "song", "left_semi")
    )


def end_steps(notes: DataFrame, fixed_length: int | None = None) -> DataFrame:
    """(song, length): the song's end in whole steps, truncated, or fixed_length; songs of no
    positive length go."""
    length = F.max("end").cast("int") if fixed_length is None else F.lit(fixed_length)
    return notes.groupBy("song").agg(length.alias("length")).where(F.col("length") > 0)
