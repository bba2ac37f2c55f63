"""Suffix-array dedup of long repeated passages.

Every string of ``length`` bytes picks one anchor inside itself by its content: the leftmost least
hash among its half-length grams. Strings that start side by side and pick the same anchor make one
super-window. Equal super-windows fold to their first occurrence; what is left of an anchor's gram
if it has several different super-windows is sorted as suffixes from the anchor on: tasks exchange
front-coded sorted runs, and loser trees that never compare a known prefix again merge them. The
merge yields the common-prefix lengths from which the covered strings are read off."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import POWERS, by_bytes, col, ident, mix64, rolling, shuffle_partitions, text_of, window_min

#: String starts handled at once: bounds the memory of a very long text. Places in a chunk take 20 bits.
CHUNK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
#: Records held by a task before they are sent, and entries of a run.
HELD = 1 << 20
RUN = 1 << 16

#: One super-window: hashes of its anchor's gram and of itself, its document, its first string's
#: start, how many further strings start in it, and the anchor's distance from its start.
SUPER = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("more", "u1"), ("anchor", "u1")])
#: A super-window by document, with what is known of it: 1 covered, 2 to be sorted.
FLAG = np.dtype([("did", "<i8"), ("th", "<i8"), ("start", "<u4"), ("more", "u1"), ("anchor", "u1"), ("kind", "u1")])
NEED = np.dtype([("start", "<u4"), ("more", "u1"), ("anchor", "u1")])
SPAN = np.dtype([("start", "<i8"), ("end", "<i8")])


def super_windows(data: bytes, length: int) -> np.ndarray:
    """The SUPER records of one text (doc left 0)."""
    k = length // 2
    w = length - k + 1
    total = len(data) - length + 1
    codes = np.frombuffer(data, np.uint8)
    out = []
    for at in range(0, max(0, total), CHUNK):
        n = min(CHUNK, total - at)
        part = codes[at : at + n + length - 1]
        grams = rolling(part, k)
        least = window_min((grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64), w)[:n]
        anchor = (least & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:] - 1, n - 1)
        chosen = anchor[first]
        up, down = POWERS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        record = np.zeros(len(first), SUPER)
        record["gram"] = grams[chosen]
        shape = (last - first).astype(np.uint64) << np.uint64(32) | (chosen - first).astype(np.uint64)
        record["whole"] = mix64((sums[last + length] - sums[first]) * down[first] + mix64(shape + np.uint64(1)))
        record["start"], record["more"], record["anchor"] = first + at, last - first, chosen - first
        out.append(record)
    return np.concatenate(out) if out else np.zeros(0, SUPER)


def _flags(records: np.ndarray, did: np.ndarray, th: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(records), FLAG)
    out["did"], out["th"], out["kind"] = did[records["doc"]], th[records["doc"]], kind
    for name in ("start", "more", "anchor"):
        out[name] = records[name]
    return out


def _folded(records: np.ndarray, did: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrences sorted by gram, whether each one's gram has several, the other
    occurrences) of equal super-windows."""
    records = records[np.argsort(records["gram"], kind="stable")]
    same = records["gram"][1:] == records["gram"][:-1]
    again = np.zeros(len(records), bool)
    again[1:] |= same
    again[:-1] |= same
    single, many = records[~again], records[again]
    many = many[np.lexsort((many["start"], th[many["doc"]], did[many["doc"]], many["whole"], many["gram"]))]
    fresh = np.ones(len(many), bool)
    fresh[1:] = (many["gram"][1:] != many["gram"][:-1]) | (many["whole"][1:] != many["whole"][:-1])
    # A row that is repeated is one document: its second record is no other occurrence.
    double = np.zeros(len(many), bool)
    double[1:] = ~fresh[1:] & (many["start"][1:] == many["start"][:-1])
    for ids in (did, th):
        double[1:] &= ids[many["doc"][1:]] == ids[many["doc"][:-1]]
    firsts, others = many[fresh], many[~fresh & ~double]
    several = np.zeros(len(firsts), bool)
    near = firsts["gram"][1:] == firsts["gram"][:-1]
    several[1:] |= near
    several[:-1] |= near
    return np.concatenate([single, firsts]), np.concatenate([np.zeros(len(single), bool), several]), others


def _by_part(flags: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Flags dealt by document: the part is the text's hash modulo parts, as pmod gives it."""
    part = flags["th"] % parts
    order = np.argsort(part, kind="stable")
    flags, part = flags[order], part[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), flags[a:b].tobytes()


ANCHORED = "dest int, kind int, docs binary, payload binary"


def _anchors(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(dest, kind, docs, payload): kind 0 are first super-windows by gram bucket, kind 1 flags by
    document of those that repeat within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            did, th = (np.array([x[i] for x in ids], np.int64) for i in range(2))
            firsts, _, others = _folded(np.concatenate(held), did, th)
            rows = [(dest, 1, b"", raw) for dest, raw in _by_part(_flags(others, did, th, 1), buckets)]
            dest = (firsts["gram"] >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(dest, kind="stable")
            firsts, dest = firsts[order], dest[order]
            edges = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = firsts[a:b].copy()
                used, part["doc"] = np.unique(part["doc"], return_inverse=True)
                rows.append((int(dest[a]), 0, np.stack([did[used], th[used]], axis=1).tobytes(), part.tobytes()))
            held.clear()
            ids.clear()
            size = 0
            return _rows(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), ("dest", "kind", "docs", "payload"))

        for batch in batches:
            for did, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records = super_windows(text.encode(), length)
                if len(records):
                    records["doc"] = len(ids)
                    ids.append((did, th))
                    held.append(records)
                    size += len(records)
                    if size >= HELD:
                        yield flush()
        if held:
            yield flush()

    return by_bytes(texts).mapInArrow(run, ANCHORED)


def _rows(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _judge(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Flags by document from all super-windows of a gram bucket."""
    tables, records, base = [], [], 0
    for batch in batches:
        for docs, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tables.append(np.frombuffer(docs, np.int64).reshape(-1, 2))
            part = np.frombuffer(payload, SUPER).copy()
            part["doc"] += base
            base += len(tables[-1])
            records.append(part)
    if not records:
        return
    ids = np.concatenate(tables)
    did, th = ids[:, 0], ids[:, 1]
    firsts, several, others = _folded(np.concatenate(records), did, th)
    flags = np.concatenate([_flags(others, did, th, 1), _flags(firsts[several], did, th, 2)])
    yield _rows(list(_by_part(flags, buckets)), (pa.int32(), pa.binary()), ("dest", "payload"))


MARKED = "did long, th long, spans binary, needs binary"


def _by_document(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """One row a document of the part: spans that are covered, super-windows to be sorted."""
    flags = [np.frombuffer(x, FLAG) for batch in batches for x in batch.column(0).to_pylist()]
    if not flags:
        return
    every = np.concatenate(flags)
    every = every[np.lexsort((every["start"], every["th"], every["did"]))]
    changed = (every["did"][1:] != every["did"][:-1]) | (every["th"][1:] != every["th"][:-1])
    edges = np.flatnonzero(np.concatenate(([True], changed, [True])))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine = every[a:b]
        covered, needed = mine[mine["kind"] == 1], mine[mine["kind"] == 2]
        spans = np.zeros(len(covered), SPAN)
        spans["start"] = covered["start"]
        spans["end"] = covered["start"].astype(np.int64) + covered["more"] + length
        need = np.zeros(len(needed), NEED)
        for name in NEED.names:
            need[name] = needed[name]
        rows.append((int(mine["did"][0]), int(mine["th"][0]), union(spans).tobytes(), need.tobytes()))
        if len(rows) >= 4096:
            yield _rows(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), ("did", "th", "spans", "needs"))
            rows = []
    if rows:
        yield _rows(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), ("did", "th", "spans", "needs"))


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal spans that cover the same bytes; touching spans join."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans["start"], kind="stable")]
    reach = np.maximum.accumulate(spans["end"])
    fresh = np.concatenate(([True], spans["start"][1:] > reach[:-1]))
    out = np.zeros(int(fresh.sum()), SPAN)
    out["start"] = spans["start"][fresh]
    out["end"] = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)]
    return out


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, known to be at least known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differs = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differs.bit_length() + 7) // 8


def front_coded(run: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (suffix, what precedes it, did, th, place): each suffix as the length of its
    prefix in common with the one before, and the rest."""
    out, before = [], b""
    for suffix, left, did, th, place in run:
        same = common_prefix(before, suffix)
        ids = np.array([did, th, place], "<i8").tobytes()
        out.append(bytes([same & 0xFF, same >> 8, (len(suffix) - same) & 0xFF, (len(suffix) - same) >> 8, len(left) & 0xFF, len(left) >> 8]) + suffix[same:] + left + ids)
        before = suffix
    return b"".join(out)


def decoded_run(raw: bytes) -> Iterator[tuple[int, bytes, bytes, tuple[int, int, int]]]:
    """(common prefix with the one before, suffix, what precedes it, (did, th, place)) of a run."""
    at, before = 0, b""
    while at < len(raw):
        same, rest, left = (raw[at + i] | raw[at + i + 1] << 8 for i in (0, 2, 4))
        at += 6
        before = before[:same] + raw[at : at + rest]
        at += rest
        did, th, place = np.frombuffer(raw, "<i8", 3, at + left).tolist()
        yield same, before, raw[at : at + left], (did, th, place)
        at += left + 24


class LoserTree:
    """Merges sorted runs. Each inner node keeps the loser of its match and the prefix that it has
    in common with the winner; the contender that shares more with the last output is smaller, and
    only where they share equally much are bytes compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        #: Prefix that each run's head shares with the last output.
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        self.winner = self._play(1) if self.size > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner."""
        one, two = self.heads[a], self.heads[b]
        if one is None or two is None:
            return (b, a) if one is None else (a, b)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        same = common_prefix(one[1], two[1], self.shared[a])
        win, lose = (a, b) if (one[1][same:], a) <= (two[1][same:], b) else (b, a)
        self.shared[lose] = same
        return win, lose

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.losers[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, tuple[int, int, int]]]:
        while (head := self.heads[self.winner]) is not None:
            yield self.shared[self.winner], *head[1:]
            after = next(self.runs[self.winner], None)
            self.heads[self.winner] = after
            self.shared[self.winner] = after[0] if after is not None else 0
            node = (self.winner + self.size) >> 1
            while node:
                self.winner, self.losers[node] = self._match(self.winner, self.losers[node])
                node >>= 1


def covered_strings(group: list[tuple[int, bytes, bytes, tuple[int, int, int]]], length: int) -> Iterator[tuple[int, int, int]]:
    """(did, th, start) of every string through an anchor that starts earlier in another member.

    group: suffixes from anchors of one gram, sorted, with common prefixes. A string that starts o
    bytes before its anchor equals another's if their suffixes share length - o bytes, which is a
    stretch of the sorted order, and the o bytes before are the same."""
    for o in range(length - length // 2 + 1):
        right = length - o
        at = 0
        while at < len(group):
            end = at + 1
            while end < len(group) and group[end][0] >= right:
                end += 1
            if end - at > 1:
                first: dict[bytes, tuple[int, int, int]] = {}
                members = [g for g in group[at:end] if len(g[1]) >= right and len(g[2]) >= o]
                for _, _, left, ids in members:
                    key = left[len(left) - o :]
                    if key not in first or ids < first[key]:
                        first[key] = ids
                for _, _, left, ids in members:
                    if first[left[len(left) - o :]] != ids:
                        yield ids[0], ids[1], ids[2] - o
            at = end


def _suffix_runs(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(dest, run): front-coded sorted runs of the suffixes that need sorting, by gram bucket."""
    k = length // 2
    entries: list[tuple[int, bytes, bytes, int, int, int]] = []

    def flush() -> pa.RecordBatch:
        entries.sort(key=lambda e: e[:2])
        rows = [(dest, front_coded([e[1:] for e in part])) for dest, part in groupby(entries, key=lambda e: e[0])]
        entries.clear()
        return _rows(rows, (pa.int32(), pa.binary()), ("dest", "run"))

    for batch in batches:
        for did, th, packed, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = zlib.decompress(packed)
            for start, more, anchor in np.frombuffer(needs, NEED).tolist():
                place = start + anchor
                suffix, left = data[place : start + more + length], data[start:place]
                entries.append((zlib.crc32(suffix[:k]) % buckets, suffix, left, did, th, place))
            if len(entries) >= RUN:
                yield flush()
    if entries:
        yield flush()


def _merge_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(did, th, spans) of what the merged suffixes cover."""
    runs = [decoded_run(x) for batch in batches for x in batch.column(0).to_pylist()]
    if not runs:
        return
    k = length // 2
    found: dict[tuple[int, int], list[int]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for (did, th), starts in found.items():
            spans = np.zeros(len(starts), SPAN)
            spans["start"] = starts
            spans["end"] = spans["start"] + length
            rows.append((did, th, union(spans).tobytes()))
        found.clear()
        return _rows(rows, (pa.int64(), pa.int64(), pa.binary()), ("did", "th", "spans"))

    def groups() -> Iterator[list[tuple]]:
        group: list[tuple] = []
        for entry in LoserTree(runs):
            if group and entry[0] < k:
                yield group
                group = []
            group.append(entry)
        yield group

    for group in groups():
        if len(group) > 1:
            for did, th, start in covered_strings(group, length):
                found.setdefault((did, th), []).append(start)
                size += 1
            if size >= HELD:
                yield flush()
                size = 0
    if found:
        yield flush()


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """Removes every byte covered by a string of length bytes that also starts earlier (in a smaller
    identifier, or earlier in the same text), judged on the input.

    One row per input row: ``doc_id``, ``n_bytes``, ``spans`` (array<struct<start, end>> of removed
    bytes, maximal) and ``kept`` (the bytes that stay).

    Texts are UTF-8 bytes; null counts as empty; texts shorter than length lose nothing. A null
    identifier counts as the smallest. Rows that share an identifier are ordered by their text's
    hash, and repeated rows of one identifier and text are one document: each gets its result. An
    empty table gives an empty result; other columns are not read.

    Plan: super-windows (some 4 in 100 bytes, 26 bytes each) move once by gram, folded within each
    task first, so a passage that a third of all documents hold is one record a task. Flags go back
    by document. Texts move once, compressed, and both joins use that exchange. Only super-windows
    whose gram has several of them are sorted as suffixes.
    """
    if not 16 <= length <= 500:
        raise ValueError("length is from 16 to 500 bytes")
    buckets = shuffle_partitions(docs.sparkSession)
    texts = docs.select(ident(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    anchored = _anchors(texts, length, buckets).repartitionById(buckets, F.col("dest"))
    judged = anchored.where("kind = 0").select("docs", "payload").mapInArrow(lambda b: _judge(b, buckets), "dest int, payload binary")
    local = anchored.where("kind = 1").select("dest", "payload")
    dealt = judged.unionByName(local).repartitionById(buckets, F.col("dest")).select("payload")
    marked = dealt.mapInArrow(lambda b: _by_document(b, length), MARKED)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([zlib.compress(t.encode(), 1) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["did", "th", "packed"])

    moved = by_bytes(texts).mapInArrow(packed, "did long, th long, packed binary")
    needing = marked.where(F.octet_length("needs") > 0).select("did", "th", "needs")
    unique = moved.join(needing, ["did", "th"]).select("did", "th", "packed", "needs")
    runs = unique.mapInArrow(lambda b: _suffix_runs(b, length, buckets), "dest int, run binary")
    merged = runs.repartitionById(buckets, F.col("dest")).select("run").mapInArrow(lambda b: _merge_runs(b, length), "did long, th long, spans binary")
    spans = (
        marked.select("did", "th", "spans").unionByName(merged).where(F.octet_length("spans") > 0)
        .groupBy("did", "th").agg(F.collect_list("spans").alias("spans"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, cuts, kept = [], [], []
                for raw, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = zlib.decompress(raw)
                    gone = union(np.frombuffer(b"".join(parts or []), SPAN)).tolist()
                    sizes.append(len(data))
                    cuts.append([{"start": a, "end": b} for a, b in gone])
                    edges = [0, *(x for pair in gone for x in pair), len(data)]
                    kept.append(b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, kind), pa.array(kept, pa.binary())],
                    names=["did", "n_bytes", "spans", "kept"],
                )

    done = moved.join(spans, ["did", "th"], "left").select("did", "packed", "spans")
    result = by_bytes(done).mapInArrow(finish, "did long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    real = F.when(F.col("did") != F.lit(-(2**63)), F.col("did"))
    return result.select(real.alias("doc_id"), "n_bytes", "spans", "kept")
