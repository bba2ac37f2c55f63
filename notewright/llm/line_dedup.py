"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines
over the threshold, reassemble by position. Built-in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import ident, text_of

#: The white space stripped from a line's ends (x20, x09 to x0D).
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; where all is ASCII, the faster general function does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_key(line: Column) -> Column:
    """The normalised line: white space stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drops lines that many documents share, except in the largest identifier holding them.

    Returns one row per input row: ``row`` (the input row as a struct), ``n_lines``,
    ``n_dropped`` and ``kept_text``.

    Null or empty text is one empty line. A null identifier counts as one document below all
    others. Rows that share an identifier count as one document, and each gets its own row;
    among holders of the largest identifier all keep the line. An empty table gives an empty
    result. Extra columns, whatever their names, travel inside ``row`` only.

    Plan: one pass hashes each line to 16 bytes, distinct (hash, document) pairs are counted in
    two shuffles of hashes, so a line in a third of all documents is pre-aggregated. The hot
    hashes are joined back (both sides exchanged, so the adaptive skew join can split a hot hash)
    and leave positions, gathered per document. Texts are shuffled once, to meet their positions.
    """
    source = docs.select(
        F.struct(F.col("*")).alias("row"),
        ident(id_col).alias("did"),
        F.xxhash64(text_of(text_col)).alias("th"),
        text_of(text_col).alias("text"),
    )
    lines = F.split("text", "\n", -1)
    keyed = (
        source.select("did", "th", F.posexplode(lines).alias("pos", "line"))
        # Lower-casing keeps the length, so short lines go before they are lower-cased.
        .where(F.char_length(F.btrim(F.col("line"), F.lit(WHITE))) >= min_chars)
        .select("did", "th", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("h"))
    )
    shared = (
        keyed.groupBy("h")
        .agg(F.count_distinct("did").alias("n"), F.max("did").alias("keeper"))
        .where(F.col("n") >= min_docs)
        # substring hides the grouping's partitioning: the join then exchanges both of its sides,
        # which the adaptive skew join needs to split a hot hash.
        .select(F.substring("h", 1, 16).alias("h"), "keeper")
    )
    dropped = (
        keyed.join(shared, "h")
        .where(F.col("did") != F.col("keeper"))
        .groupBy("did", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    )
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    n_lines = F.size(lines)
    # Between two dropped positions lies one slice of kept lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(n_lines))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))
    return (
        source.join(dropped, ["did", "th"], "left")
        .withColumn("gone", gone)
        .select(
            "row",
            n_lines.cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
            F.when(F.size("gone") == 0, F.col("text"))
            .otherwise(F.array_join(kept, "\n"))
            .alias("kept_text"),
        )
    )
