"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window with
rightmost ties, positions kept. A passage of w + k - 1 code points that two texts share leaves at
least one common hash in both fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import by_bytes, col, ident, rolling, shuffle_partitions, text_of, window_min

#: Window starts handled at once: bounds the memory a very long text takes.
CHUNK = 1 << 20
LOW = np.uint64(0xFFFFFFFF)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def winnow(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the selected k-grams. A text shorter than k is one gram; one
    of fewer than w grams is one window; an empty text has no fingerprint."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    k = min(k, n)
    positions, hashes = [], []
    windows = max(1, n - k + 1 - w + 1)
    for start in range(0, windows, CHUNK):
        part = codes[start : start + min(CHUNK, windows - start) + w - 1 + k - 1]
        grams = rolling(part, k) >> np.uint64(32)
        # Smaller hash first, then the larger position: the rightmost of equal minima.
        packed = (grams << np.uint64(32)) | (LOW - np.arange(len(grams), dtype=np.uint64))
        least = window_min(packed, w)
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        positions.append((LOW - (least & LOW)).astype(np.int64) + start)
        hashes.append((least >> np.uint64(32)).astype(np.uint32))
    at, values = np.concatenate(positions), np.concatenate(hashes)
    fresh = np.concatenate(([True], at[1:] != at[:-1]))
    return at[fresh], values[fresh]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hash sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def encode(positions: np.ndarray, hashes: np.ndarray) -> str:
    """A fingerprint as text: 16 hex digits an entry, the position then the hash, big-endian."""
    out = np.empty((len(positions), 2), ">u4")
    out[:, 0], out[:, 1] = positions & 0xFFFFFFFF, hashes
    return out.tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.uint32)


def fingerprint_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 20, w: int = 40
) -> DataFrame:
    """One row per input row: the identifier, ``n_chars`` and ``fingerprint``.

    Null text counts as empty (empty fingerprint); null identifiers pass through; repeated rows
    get a row each; other columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = [encode(*winnow(code_points(t), k, w)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())],
                names=[id_col, "n_chars", "fingerprint"],
            )

    out = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_chars", T.LongType()),
            T.StructField("fingerprint", T.StringType()),
        ]
    )
    return by_bytes(docs.select(col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, out)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds exceed key, searched in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    above = lambda a: F.size(F.filter(a, lambda x: x > key))
    coarse = above(array([g[-1] for g in groups]))
    fine = F.get(F.array(*[array(g) for g in groups]), coarse)
    whole = F.least(coarse * F.lit(step), F.lit(len(bounds)))  # the last group may be shorter
    return whole + F.coalesce(above(F.coalesce(fine, array([]).cast("array<bigint>"))), F.lit(0))


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
_EDITED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def fingerprint_edits(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 20, w: int = 40
) -> DataFrame:
    """Fingerprints each text and its edited text, whose last floor(n / 2) code points are replaced
    by the first as many (or all) of the next document, descending identifier; after the last
    comes the first.

    Null text counts as empty, a null identifier as the smallest; rows that share an identifier
    are ordered by their text's hash; a lone row is its own successor; an empty table gives an
    empty result; other columns are not read.

    Plan: quantiles of the identifiers (at most as many as shuffle partitions) cut the descending
    order into buckets; one exchange brings each bucket together, sorted, with a copy of the first
    row of the bucket that follows. Each task then streams its bucket holding two texts at a time.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(ident(id_col).alias("id"), col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(cuts or []), reverse=True)
    keyed = rows.withColumn("th", F.xxhash64("text")).withColumn("bucket", _bucket(F.col("id"), bounds))
    # At most one row a bucket comes to the driver: (identifier, hash) of its first document.
    heads = keyed.groupBy("bucket").agg(F.max(F.struct("id", "th")).alias("head")).orderBy("bucket").collect()
    if not heads:
        return docs.sparkSession.createDataFrame([], EDITED)
    order = [h["bucket"] for h in heads]
    follows = list(pairwise([*zip(order, heads, strict=True), (None, heads[0])]))
    ahead = docs.sparkSession.createDataFrame(
        [(before[0], after[1]["head"]["id"], after[1]["head"]["th"]) for before, after in follows],
        "bucket int, id long, th long",
    )
    looks = keyed.drop("bucket").join(F.broadcast(ahead), ["id", "th"])
    dealt = (
        keyed.withColumn("look", F.lit(False))
        .unionByName(looks.withColumn("look", F.lit(True)))
        .repartitionById(len(bounds) + 1, F.col("bucket"))
        .sortWithinPartitions("look", F.desc("id"), F.desc("th"))
        .select("doc_id", "text", "look")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size, done = None, [], 0, False
        for batch in batches:
            for doc_id, text, look in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done:
                    continue
                codes = code_points(text)
                now = (doc_id, text, codes, *winnow(codes, k, w))
                if held is not None:
                    out.append(_compare(held, now, k, w))
                    size += len(out[-1][3]) + len(out[-1][4])
                    if size > 4_000_000:
                        yield _packed(out)
                        out, size = [], 0
                held, done = now, look
        if out:
            yield _packed(out)

    return by_bytes(dealt).mapInArrow(run, EDITED)


def _compare(one: tuple, after: tuple, k: int, w: int) -> tuple:
    doc_id, text, _, at, hashes = one
    half = len(text) // 2
    edited = text[: len(text) - half] + after[1][:half]
    edited_at, edited_hashes = winnow(code_points(edited), k, w)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        encode(at, hashes),
        encode(edited_at, edited_hashes),
        likeness(hashes, edited_hashes),
        likeness(hashes, after[4]),
    )


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _EDITED_ARROW, strict=True)], schema=_EDITED_ARROW
    )
