"""The selector language that picks the notes of a part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.music import keyed_unit
from notewright.operators.gates import density_gate, track_density

#: Fixed value: tracks at most this dense count as ``dense``, denser ones as ``sparse``.
DENSE_UP_TO = 0.75
NUMBERED = ("track", "upto", "from", "notrack", "random")
PLAIN = ("all", "dense", "sparse", "drum", "nondrum", "empty")


@dataclass(frozen=True)
class Selector:
    """One selector: ``all``, ``drum``, ``nondrum``, ``dense``, ``sparse``, ``empty``, or
    ``track-n``, ``upto-n``, ``from-n``, ``notrack-n``, ``random-0``, ``random-1``.

    ``dense`` means few onsets on the beat group: density is the share that lies on it."""

    kind: str
    number: int | None = None

    @classmethod
    def parse(cls, text: str) -> Selector:
        if not isinstance(text, str):
            raise NotImplementedError("selectors by program number are not supported")
        kind, dash, number = text.partition("-")
        if dash and kind in NUMBERED and number.isdigit():
            if kind == "random" and int(number) > 1:
                raise ValueError("random selectors are random-0 and random-1")
            return cls(kind, int(number))
        if not dash and kind in PLAIN:
            return cls(kind)
        raise NotImplementedError(f"unknown selector {text!r}")

    def column(self) -> Column:
        """The predicate over rank, is_drum and, where needed, density and side."""
        rank, n = F.col("rank"), self.number
        return {
            "all": lambda: F.lit(True),
            "empty": lambda: F.lit(False),
            "track": lambda: rank == n,
            "upto": lambda: rank <= n,
            "from": lambda: rank >= n,
            "notrack": lambda: rank != n,
            "random": lambda: F.col("side") == n,
            "dense": lambda: F.col("density") <= DENSE_UP_TO,
            "sparse": lambda: F.col("density") > DENSE_UP_TO,
            "drum": lambda: F.col("is_drum"),
            "nondrum": lambda: ~F.col("is_drum"),
        }[self.kind]()


def parse_parts(selectors: str | list[str]) -> list[Selector]:
    """Selectors of a song's parts. ``dense`` and ``sparse`` need their song gate, which runs only
    if the first selector is ``dense``; ``random`` must come first likewise."""
    parts = [Selector.parse(s) for s in (selectors if isinstance(selectors, list) else [selectors])]
    kinds = [p.kind for p in parts]
    if {"dense", "sparse"} & set(kinds) and kinds[0] != "dense":
        raise ValueError("the first of density selectors must be 'dense'")
    if "random" in kinds and kinds[0] != "random":
        raise ValueError("the first of random selectors must be random")
    return parts


def instrument_ranks(notes: DataFrame) -> DataFrame:
    """Adds rank: tracks of a song from 0 in the order of their first note."""
    first = F.min("seq").over(Window.partitionBy("song", "track"))
    return (
        notes.withColumn("first_seq", first)
        .withColumn("rank", F.dense_rank().over(Window.partitionBy("song").orderBy("first_seq")) - 1)
        .drop("first_seq")
    )


def random_sides(notes: DataFrame, seed: int = 0) -> DataFrame:
    """(song, track, side): a keyed split of a song's tracks in two, neither side empty. Songs of
    one track have no rows."""
    tracks = notes.select("song", "track").distinct()
    shuffled = Window.partitionBy("song").orderBy(keyed_unit(str(seed), F.col("song"), F.col("track")), "track")
    size = F.count("*").over(Window.partitionBy("song"))
    cut = F.floor(keyed_unit(f"split{seed}", F.col("song")) * (size - 1)) + 1
    return (
        tracks.withColumns({"at": F.row_number().over(shuffled), "tracks": size, "cut": cut})
        .where(F.col("tracks") > 1)
        .select("song", "track", F.when(F.col("at") <= F.col("cut"), 1).otherwise(0).alias("side"))
    )


def with_selector_inputs(notes: DataFrame, parts: list[Selector], seed: int = 0) -> DataFrame:
    """Adds what the parts' predicates read, and drops songs that a density or random part rejects."""
    kinds = {p.kind for p in parts}
    out = instrument_ranks(notes)
    if kinds & {"dense", "sparse"}:
        densities = track_density(notes)
        out = out.join(densities, ["song", "track"]).join(density_gate(densities).select("song"), "song", "left_semi")
    if "random" in kinds:
        out = out.join(random_sides(notes, seed), ["song", "track"])
    return out
