"""A plan as named stages, which can be replaced or tapped before it is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.order import settled
from notewright.operators import corpus, events, rolls
from notewright.plans.presets import DEFAULT, PRESETS
from notewright.sources import midi

Stage = Callable[[dict[str, Any]], Any]
Tap = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stages:
    """Stages by name, in their order. A stage is a function of what the stages before it made (by name);
    a tap is a function put over what a stage made, for all that follows. Graphs are values: replacing
    or tapping gives a new one and leaves the old as it was, and nothing runs before it is built."""

    stages: tuple[tuple[str, Stage], ...] = ()
    taps: tuple[tuple[str, Tap], ...] = field(default=())

    def names(self) -> list[str]:
        return [n for n, _ in self.stages]

    def _known(self, name: str) -> None:
        if name not in self.names():
            raise KeyError(f"no stage {name}; there are {', '.join(self.names())}")

    def then(self, name: str, stage: Stage) -> Stages:
        if name in self.names():
            raise KeyError(f"there is a stage {name} already")
        return replace(self, stages=(*self.stages, (name, stage)))

    def replaced(self, name: str, stage: Stage) -> Stages:
        """With another function in a stage's place, such as a variant of a decoder or a gate."""
        self._known(name)
        return replace(self, stages=tuple((n, stage if n == name else s) for n, s in self.stages))

    def tapped(self, name: str, tap: Tap) -> Stages:
        """With a tap over a stage: taps of one stage apply in the order they were put."""
        self._known(name)
        return replace(self, taps=(*self.taps, (name, tap)))

    def built(self, upto: str | None = None, **given: Any) -> dict[str, Any]:
        """What each stage made, by name, up to a stage; given are values by name that stages may read."""
        if upto is not None:
            self._known(upto)
        made = dict(given)
        for name, stage in self.stages:
            out = stage(made)
            for at, tap in self.taps:
                out = tap(out) if at == name else out
            made[name] = out
            if name == upto:
                break
        return made


def preset_stages(spark: SparkSession, root: str, name: str = DEFAULT) -> Stages:
    """A preset as stages: files, songs, decoded, events, sane, pairs, notes and built (roll, songs)."""
    preset = PRESETS[name]

    def notes_of(made: dict) -> DataFrame:
        resolution = made["sane"].select("song", "resolution").distinct()
        table = events.note_table(made["pairs"], 1).join(resolution, "song")
        return table.withColumns({c: F.col(c) / F.col("resolution") for c in ("start", "end")}).drop("resolution")

    def built(made: dict) -> tuple[DataFrame, DataFrame]:
        roll, kept = rolls.build_rolls(made["notes"], selectors=list(preset.selectors), cap=preset.cap, dedup=preset.dedup)
        return roll, kept.join(made["songs"], "song")

    return (
        Stages()
        .then("files", lambda m: midi.midi_files(spark, f"{root}/{preset.folder}", subfolders=preset.subfolders, limit=preset.limit))
        .then("songs", lambda m: corpus.song_index(m["files"].select(F.col("path").alias("relpath")).distinct()).withColumnRenamed("i", "song"))
        .then("decoded", lambda m: midi.event_rows(midi.read_events(m["files"]).join(m["songs"], F.col("path") == F.col("relpath"))))
        .then("events", lambda m: events.relocated_meta(events.absolute_ticks(settled(m["decoded"].repartition("song")))))
        .then("sane", lambda m: m["events"].join(events.corrupt_songs(m["events"]).select("song"), "song", "left_anti"))
        .then("pairs", lambda m: events.paired_notes(m["sane"]))
        .then("notes", notes_of)
        .then("built", built)
    )
