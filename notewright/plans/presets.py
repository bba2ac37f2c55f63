"""The catalogue of corpus presets, and the pipeline that each drives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.order import settled
from notewright.operators import corpus, events, rolls
from notewright.sources import midi


@dataclass(frozen=True)
class Preset:
    cap: int
    selectors: tuple[str, ...]
    dedup: bool = False
    limit: int | None = None
    subfolders: bool = True
    folder: str = "."


# Cap, selectors, dedup, limit on files, subfolders, folder below the data root.
PRESETS = {
    "rwc": Preset(16, ("all",), folder="AIST.RWC-MDB-P-2001.SMF_SYNC"),
    "la": Preset(16, ("all",), folder="MIDIs"),
    "nottingham": Preset(8, ("track-1", "track-0"), subfolders=False, folder="MIDI"),
    "nottingham_transposed_test": Preset(8, ("track-1", "track-0"), subfolders=False, folder="transposed_midi"),
    "rwc_drums": Preset(16, ("drum", "nondrum"), folder="AIST.RWC-MDB-P-2001.SMF_SYNC"),
    "rwc_drums_fix": Preset(16, ("drum", "nondrum"), folder="RemoveChannel10"),
    "la_drums": Preset(16, ("drum", "nondrum"), dedup=True, limit=50000, folder="MIDIs"),
    "rwc_chords": Preset(16, ("from-2", "upto-1"), subfolders=False, folder="rwc_chord"),
    "rwc_majmin": Preset(16, ("from-1", "upto-0"), subfolders=False, folder="rwc_chord_majmin"),
    "la_random": Preset(16, ("random-0", "random-1"), dedup=True, limit=50000, folder="MIDIs"),
    "la_density": Preset(16, ("dense", "sparse"), limit=50000, folder="MIDIs"),
    "la_med": Preset(16, ("all",), dedup=True, limit=50000, folder="MIDIs"),
}
DEFAULT = "rwc_chords"


def notes_of(files: DataFrame, beat_div: int = 4) -> tuple[DataFrame, DataFrame]:
    """(notes, songs) of (path, content): decoded files keyed by their position in path order.
    Files that do not decode, or whose last tick is beyond the guard, are left out."""
    songs = corpus.song_index(files.select(F.col("path").alias("relpath")).distinct()).withColumnRenamed("i", "song")
    rows = midi.event_rows(midi.read_events(files).join(songs, F.col("path") == F.col("relpath")))
    rows = settled(rows.repartition("song"))  # decoded once, for all that follows
    rows = events.relocated_meta(events.absolute_ticks(rows))
    rows = rows.join(events.corrupt_songs(rows).select("song"), "song", "left_anti")
    resolution = rows.select("song", "resolution").distinct()
    notes = events.note_table(events.paired_notes(rows), 1, beat_div).join(resolution, "song")
    scaled = {c: F.col(c) / F.col("resolution") for c in ("start", "end")}
    return notes.withColumns(scaled).drop("resolution"), songs


def data_root(spark: SparkSession, folder: str) -> str:
    """Where the files of a preset's folder lie: the session's notewright.data.<folder>, for collections
    that are kept apart, else notewright.data.root."""
    root = spark.conf.get(f"notewright.data.{folder}", None) or spark.conf.get("notewright.data.root", None)
    if not root:
        raise ValueError(f"set notewright.data.root, or notewright.data.{folder}, to the folder of the files")
    return root


def build_named(spark: SparkSession, name: str = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """build with the root that the session's settings name."""
    return build(spark, data_root(spark, PRESETS[name].folder), name)


def build(spark: SparkSession, root: str, name: str = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(roll, songs) of a preset over the MIDI files below root."""
    preset = PRESETS[name]
    files = midi.midi_files(spark, f"{root}/{preset.folder}", subfolders=preset.subfolders, limit=preset.limit)
    notes, songs = notes_of(files)
    roll, kept = rolls.build_rolls(notes, selectors=list(preset.selectors), cap=preset.cap, dedup=preset.dedup)
    return roll, kept.join(songs, "song")
