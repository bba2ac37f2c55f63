"""What the query modules share: the registry and the DuckDB views under the counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.functions.music import BOUNDARIES

Query = Callable[[SparkSession, str], DataFrame]

#: Cap used over the surrogate notes, whose steps are less dense than real ones.
CAP = 4


class Registry:
    """Queries by name, each with its DuckDB counterpart where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return put


NOTES = """
notes AS (
  SELECT l_suppkey AS song, l_linenumber - 1 AS track, l_linenumber = 7 AS is_drum,
         CASE WHEN l_linenumber = 7 THEN 127 ELSE (l_linenumber * 17) % 127 END AS program,
         CAST(36 + l_partkey % 48 AS INTEGER) AS pitch, q + 49 AS velocity, start, start + q AS "end", q AS len,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_shipdate, l_quantity) AS seq
  FROM (
    SELECT *, CASE WHEN l_suppkey % 4 = 0 OR l_suppkey % 8 = 2
                   THEN CAST(2 * (dd % 128) + CASE WHEN dd % 20 < CASE l_suppkey % 8 WHEN 0 THEN 20 WHEN 4 THEN 11 ELSE 17 END THEN 1 ELSE 0 END AS DOUBLE)
                   WHEN (l_linenumber + l_suppkey) % 3 = 0 THEN CAST(dd % 256 - dd % 4 AS DOUBLE)
                   ELSE dd % 256 + (q % 16) / 16.0::DOUBLE END AS start
    FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS dd FROM lineitem)))
"""

BOUNDS = "[" + ", ".join(f"{b}::DOUBLE" for b in BOUNDARIES) + "]"

STEPS = f"""
steps AS (
  SELECT *, len(list_filter({BOUNDS}, lambda b: b < end_step - step))::INTEGER AS dur
  FROM (SELECT * REPLACE (CASE WHEN is_drum THEN 127 ELSE program END AS program),
               CAST(round_even(start, 0) AS INTEGER) AS step, CAST(round_even("end", 0) AS INTEGER) AS end_step FROM notes)
  WHERE step >= 0)
"""

#: The roll of all notes: capped with dedup, in canonical order; lengths of songs.
ROLL = f"""
flagged AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY song, step, program, pitch ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fills FROM steps),
counted AS (
  SELECT *, coalesce(sum(fills) OVER (PARTITION BY song, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM flagged),
slots AS (
  SELECT song, step, program, pitch, min(used) FILTER (WHERE fills = 1) AS slot, arg_max(dur, [dur, -seq]) AS dur, arg_max(velocity, [dur, -seq]) AS velocity
  FROM counted WHERE used < {CAP} GROUP BY song, step, program, pitch),
roll AS (
  SELECT song, 0 AS part, step, CAST(row_number() OVER (PARTITION BY song, step ORDER BY velocity, program, pitch, dur, slot) - 1 AS INTEGER) AS slot,
         program, pitch, dur, velocity FROM slots),
lengths AS (SELECT song, CAST(floor(max("end")) AS INTEGER) AS length FROM notes GROUP BY song HAVING floor(max("end")) > 0)
"""

DENSITY = """
tracks AS (
  SELECT song, track, count(*) AS n, count(*) FILTER (WHERE ((s % 4) + 4) % 4 % 2 = 1) AS off,
         avg(CASE WHEN ((s % 4) + 4) % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS density
  FROM (SELECT *, CAST(round_even(start, 0) AS INTEGER) AS s FROM notes) GROUP BY song, track),
scores AS (
  SELECT song, coalesce(min(CASE WHEN n > 20 THEN off / n::DOUBLE END), 1.0::DOUBLE) AS score FROM tracks GROUP BY song)
"""

RANKS = """
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY song ORDER BY first_seq) - 1 AS rank
  FROM (SELECT *, min(seq) OVER (PARTITION BY song, track) AS first_seq FROM steps))
"""


def unit(*parts: str) -> str:
    """The keyed number in [0, 1): parts are SQL expressions."""
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def with_views(*views: str, then: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n" + then


def on_notes(then: str) -> str:
    return with_views(NOTES, then=then)


def on_steps(then: str) -> str:
    return with_views(NOTES, STEPS, then=then)


def on_roll(then: str, *more: str) -> str:
    return with_views(NOTES, STEPS, ROLL, *more, then=then)


def on_tracks(then: str, *more: str) -> str:
    return with_views(NOTES, DENSITY, *more, then=then)
