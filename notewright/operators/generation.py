"""The generation harness: prompts, a sampler that carries state over steps, condition before target.

The sampler is an object with a state of bounded size; a model with its cache would be one, tests and
queries use deterministic ones."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from notewright.functions.music import EOS, NORMAL_TOKENS, PAD_TOKEN

SAMPLED = "song long, sample int, step int, tokens array<int>"


class Sampler(Protocol):
    """begin gives the state of an empty sequence, feed the state after one more step, draw the tokens of
    the step that comes next. A state holds what later steps need of earlier ones and no more: what it
    holds is what a task holds, however long a song is."""

    def begin(self, song: int, sample: int) -> Any: ...

    def feed(self, state: Any, step: int, tokens: list[int]) -> Any: ...

    def draw(self, state: Any, step: int) -> list[int]: ...


class Windowed:
    """A sampler from a function (song, sample, the last steps' tokens, step) -> tokens, with a state of
    at most so many steps."""

    def __init__(self, draw: Callable[[int, int, list[list[int]], int], list[int]], steps: int) -> None:
        self.function, self.steps = draw, steps

    def begin(self, song: int, sample: int) -> tuple[int, int, deque]:
        return song, sample, deque(maxlen=self.steps)

    def feed(self, state: tuple[int, int, deque], step: int, tokens: list[int]) -> tuple[int, int, deque]:
        state[2].append(tokens)
        return state

    def draw(self, state: tuple[int, int, deque], step: int) -> list[int]:
        return self.function(state[0], state[1], list(state[2]), step)


class Scores(Protocol):
    """A model of a step's tokens: begin and feed as a sampler's, and the scores of all tokens for the
    next place of a step, given those drawn at the places before."""

    def begin(self, song: int, sample: int) -> Any: ...

    def feed(self, state: Any, step: int, tokens: list[int]) -> Any: ...

    def scores(self, state: Any, step: int, drawn: list[int]) -> np.ndarray: ...


class PlaceByPlace:
    """A sampler that draws a step's tokens one place after another from a model's scores.

    hook(step, place, scores) may change the scores before each draw, to bar tokens or to favour some. At
    temperature 0 the largest score wins, of equal ones the smaller token; else a token is drawn in
    proportion to exp(score / temperature) by a number that follows from seed, song, sample, step and
    place alone. An end of step is drawn like any token; pads fill the places after it."""

    def __init__(
        self, model: Scores, *, places: int = 32, temperature: float = 1.0, seed: str = "local",
        hook: Callable[[int, int, np.ndarray], np.ndarray] | None = None, end: int = EOS, pad: int = PAD_TOKEN,
    ) -> None:
        self.model, self.places, self.temperature, self.seed, self.hook, self.end, self.pad = model, places, temperature, seed, hook, end, pad

    def begin(self, song: int, sample: int) -> tuple[tuple[int, int], Any]:
        return (song, sample), self.model.begin(song, sample)

    def feed(self, state: tuple, step: int, tokens: list[int]) -> tuple:
        return state[0], self.model.feed(state[1], step, tokens)

    def draw(self, state: tuple, step: int) -> list[int]:
        drawn: list[int] = []
        while len(drawn) < self.places and self.end not in drawn[-1:]:
            scores = np.asarray(self.model.scores(state[1], step, drawn), float)
            if self.hook is not None:
                scores = self.hook(step, len(drawn), scores)
            drawn.append(self._pick(scores, f"{self.seed}:{state[0][0]}:{state[0][1]}:{step}:{len(drawn)}"))
        return drawn + [self.pad] * (self.places - len(drawn))

    def _pick(self, scores: np.ndarray, key: str) -> int:
        if self.temperature == 0:
            return int(scores.argmax())
        upto = np.cumsum(np.exp((scores - scores.max()) / self.temperature))
        u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2.0**32
        return int(np.searchsorted(upto, u * upto[-1], side="right"))


def only_allowed(
    scores: np.ndarray, step: int, place: int, *, instruments: list[int] | None = None, rhythm: int | None = None, cap: int = 16, rule: str = "consistent"
) -> np.ndarray:
    """The scores with minus infinity for tokens that metrics.sampling_allowed bars: the same rule, for a
    sampler's hook."""
    if rule not in ("consistent", "reference"):
        raise ValueError("rule is 'consistent' or 'reference'")
    open_ = np.zeros(len(scores), bool)
    if rhythm is not None and step % rhythm:
        open_[EOS] = True
    elif place % 2:
        low, high = (256, NORMAL_TOKENS) if rule == "reference" else (128, NORMAL_TOKENS - 128)
        open_[low:high] = True
    else:
        open_[EOS] = True
        if place // 2 < cap:
            open_[slice(0, 128) if instruments is None else instruments] = True
    return np.where(open_, scores, -np.inf)


def condition_then_target(condition: DataFrame, target: DataFrame, lengths: DataFrame) -> DataFrame:
    """One sequence a song: the condition's steps, then the target's, moved behind them."""
    moved = target.join(lengths.select("song", "length"), "song").withColumn("step", F.col("step") + F.col("length")).drop("length")
    return condition.unionByName(moved)


def sampling_function(sampler: Sampler, steps: int):
    """A table function over rows (song, sample, step, tokens) partitioned by song and sample and ordered
    by step: gives back the first steps of each sequence as they come and goes on to steps steps. Register
    it with spark.udtf.register for SQL."""

    class Continue:
        def __init__(self) -> None:
            self.of: tuple[int, int] | None = None
            self.state: Any = None
            self.step = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            if self.of is None:
                self.of = (row["song"], row["sample"])
                self.state = sampler.begin(*self.of)
            if self.step < steps:
                yield self._next(list(row["tokens"] or []))

        def terminate(self) -> Iterator[tuple]:
            while self.of is not None and self.step < steps:
                yield self._next([int(t) for t in sampler.draw(self.state, self.step)])

        def _next(self, tokens: list[int]) -> tuple:
            self.state = sampler.feed(self.state, self.step, tokens)
            self.step += 1
            return (*self.of, self.step - 1, tokens)

    return F.udtf(Continue, returnType=SAMPLED)


def sample_steps(prompts: DataFrame, sampler: Sampler | Callable[[int, int, list[list[int]], int], list[int]], *, steps: int, samples: int = 1) -> DataFrame:
    """(song, sample, step, tokens): continues each prompt (song, step, tokens) to steps steps, samples
    times. A plain function (song, sample, earlier steps' tokens, step) -> tokens is a sampler that sees
    all steps; `Windowed` bounds what it sees.

    A song and sample are a partition of a table function, whose rows stream through it in order of step
    while it holds the sampler's state: no sequence is gathered, and each step is given out as it is
    drawn. Steps count from 0 in the order given; a prompt longer than steps is cut there; null tokens
    are an empty step; a song without rows has no prompt and is not continued."""
    wanted = prompts.select(
        F.col("song").cast("long").alias("song"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"),
        F.col("step").cast("int").alias("step"), F.col("tokens").cast("array<int>").alias("tokens"),
    )
    if not hasattr(sampler, "begin"):
        sampler = Windowed(sampler, steps)
    table = wanted.asTable().partitionBy("song", "sample").orderBy("step")
    return sampling_function(sampler, steps)(table)
