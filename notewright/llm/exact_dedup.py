"""Exact dedup by a tree-merge of sorted digest runs.

Each partition makes sorted runs of (digest, kept identifier, count). In binomial rounds the
partitions exchange runs along one digit of their number at a time: a block of a run goes to the
partition whose digit equals the digest's, and there a multiway merge combines equal digests and
keeps the smallest (or largest) identifier. After the last round every digest lies in one place,
and no partition ever held more than its share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import col, ident, shuffle_partitions, text_of

#: A digest as four words in native order, a second hash and a length that verify it, the kept
#: identifier and the number of rows.
RECORD = np.dtype(
    [("d0", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("d3", "<u8"), ("check", "<i8"), ("size", "<i8"), ("keep", "<i8"), ("count", "<i8")]
)
#: Records in a block, the unit that runs are exchanged in; at most as many rows wait in a run.
BLOCK = 4096
RUN = 1 << 17
_BLOCKS = pa.schema([("dest", pa.int32()), ("first", pa.binary()), ("block", pa.binary())])
BLOCK_DDL = "dest int, first binary, block binary"
MERGED_DDL = "digest binary, keep_id long, group_size long"


def digest_bytes(records: np.ndarray) -> bytes:
    """The records' digests as they were, 32 bytes each."""
    return np.stack([records[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()


def digest_order(records: np.ndarray) -> np.ndarray:
    return np.lexsort((records["d3"], records["d2"], records["d1"], records["d0"]))


def combine(records: np.ndarray, keep: str) -> np.ndarray:
    """Sorts by digest and folds equal digests to one record; fails if equal digests stand for
    texts whose length or second hash differ."""
    if not len(records):
        return records
    records = records[digest_order(records)]
    differs = np.zeros(len(records), bool)
    differs[0] = True
    for name in ("d0", "d1", "d2", "d3"):
        differs[1:] |= records[name][1:] != records[name][:-1]
    starts = np.flatnonzero(differs)
    group = np.cumsum(differs) - 1
    out = records[starts].copy()
    if (records["check"] != out["check"][group]).any() or (records["size"] != out["size"][group]).any():
        raise ValueError("two different texts have the same digest")
    choose = np.minimum if keep == "min" else np.maximum
    out["keep"] = choose.reduceat(records["keep"], starts)
    out["count"] = np.add.reduceat(records["count"], starts)
    return out


def _digit(values: np.ndarray | int, shift: int, bits: int):
    return (values >> shift) & ((1 << bits) - 1)


def _blocks(run: np.ndarray, me: int, total: int, shift: int, bits: int) -> Iterator[tuple]:
    """Splits a sorted run by the digest's digit and cuts the pieces into blocks. The partition
    numbers are the digest's leading bits, so a piece stays sorted."""
    place = (run["d0"].astype(np.uint64) >> np.uint64(64 - total)).astype(np.int64) if total else np.zeros(len(run), np.int64)
    digit = _digit(place, shift, bits)
    base = me & ~(((1 << bits) - 1) << shift)
    for value in np.unique(digit):
        piece = run[digit == value]
        for at in range(0, len(piece), BLOCK):
            block = piece[at : at + BLOCK]
            yield int(base | (int(value) << shift)), digest_bytes(block[:1]), block.tobytes()


def _rounds(total: int, bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of each round; together they cover the partition number's bits."""
    return [(at, min(bits, total - at)) for at in range(0, total, bits)]


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS
    )


def merge_blocks(blocks: Iterator[bytes], keep: str) -> Iterator[np.ndarray]:
    """Multiway merge of blocks that come ordered by their first digest: whatever lies below the
    next block's first digest is final. Holds about one block of each run."""
    pool = np.empty(0, RECORD)
    waiting: list[np.ndarray] = []
    held = 0
    for raw in blocks:
        block = np.frombuffer(raw, RECORD)
        waiting.append(block)
        held += len(block)
        if held >= 4 * BLOCK + 2 * len(pool):
            pool = combine(np.concatenate([pool, *waiting]), keep)
            waiting, held = [], 0
            # Later blocks begin at this block's first digest or above it.
            limit = block[0]
            below = np.searchsorted(pool["d0"].astype(np.uint64), np.uint64(limit["d0"]), side="left")
            if below:
                yield pool[:below]
                pool = pool[below:]
    pool = combine(np.concatenate([pool, *waiting]), keep)
    if len(pool):
        yield pool


def merged_digests(digests: DataFrame, *, keep: str = "max", fan_bits: int = 1) -> DataFrame:
    """Folds (did, digest, check, size) rows to one (digest, keep_id, group_size) per digest.

    fan_bits: bits of the partition number that one round settles. At 1 the rounds are binomial: in
    round i a partition and the one whose number differs in bit i alone exchange and merge runs. Everything that a partition sends is pre-aggregated, so a digest that a
    third of all rows share is one record a partition."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    total = math.ceil(math.log2(shuffle_partitions(digests.sparkSession)))
    rounds = _rounds(total, fan_bits) or [(0, 0)]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId() & ((1 << total) - 1)
        pool = np.empty(0, RECORD)
        for batch in batches:
            fresh = np.zeros(batch.num_rows, RECORD)
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(-1, 4)
            for i in range(4):
                fresh[f"d{i}"] = raw[:, i]
            for name, i in (("keep", 0), ("check", 2), ("size", 3)):
                fresh[name] = batch.column(i).to_numpy(zero_copy_only=False)
            fresh["count"] = 1
            pool = combine(np.concatenate([pool, fresh]), keep)
            if len(pool) >= RUN:
                yield _pack(list(_blocks(pool, me, total, *rounds[0])))
                pool = pool[:0]
        if len(pool):
            yield _pack(list(_blocks(pool, me, total, *rounds[0])))

    def step(after: tuple[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            me = TaskContext.get().partitionId()
            raw = (x for batch in batches for x in batch.column(0).to_pylist())
            for merged in merge_blocks(raw, keep):
                yield _pack(list(_blocks(merged, me, total, *after)))

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = (x for batch in batches for x in batch.column(0).to_pylist())
        for merged in merge_blocks(raw, keep):
            words = digest_bytes(merged)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([words[i : i + 32] for i in range(0, len(words), 32)], pa.binary()),
                    pa.array(merged["keep"].astype(np.int64)),
                    pa.array(merged["count"].astype(np.int64)),
                ],
                names=["digest", "keep_id", "group_size"],
            )

    runs = digests.select("did", "digest", "check", "size").mapInArrow(start, BLOCK_DDL)
    for i in range(len(rounds)):
        dealt = runs.repartitionById(1 << total, F.col("dest")).sortWithinPartitions("first").select("block")
        last = i + 1 == len(rounds)
        runs = dealt.mapInArrow(finish, MERGED_DDL) if last else dealt.mapInArrow(step(rounds[i + 1]), BLOCK_DDL)
    return runs


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_bits: int = 1
) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id`` (the identifier of the row that stays),
    ``group_size``, ``kept`` and ``text_sha256``. Texts are equal when identical.

    Null text counts as empty; a null identifier counts as the smallest (keep_id is then null if
    it stays). Repeated rows with one identifier count each in group_size and are all marked kept
    if that identifier stays. An empty table gives an empty result; other columns are not read.

    Only digests move: texts are hashed where they are read. The join that brings each group's
    decision back exchanges both sides, so the adaptive skew join can split a hot group.
    """
    rows = docs.select(
        ident(id_col).alias("did"),
        col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
        F.xxhash64(text_of(text_col)).alias("check"),
        F.octet_length(text_of(text_col)).cast("long").alias("size"),
    )
    merged = merged_digests(rows, keep=keep, fan_bits=fan_bits)
    return rows.select("did", "doc_id", "digest").join(merged, "digest").select(
        "doc_id",
        F.when(F.col("keep_id") != F.lit(-(2**63)), F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("did") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
