"""Near-duplicate detection with DartMinHash signatures and banded joining.

A document is the weighted set of its five-word shingles, weighted by how often each occurs.
Hashed darts fall on every element's strip of weight and rank; those inside the document's weights
and under its rank limit count, and each coordinate keeps its earliest dart. Documents that agree on
a band of coordinates meet, and a link is made only where the weighted Jaccard similarity, counted
over all shingles, reaches the threshold."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import POWERS, by_bytes, cut, fewest, ident, let_go, merging, mix64, text_of, tidy
from notewright.llm.graph import components

#: Bytes of text hashed at once (more only for a single longer word).
PIECE = 1 << 18
#: Rows of texts whose nodes and links a task takes at least.
ROWS = 4_000
#: Bytes of a word (ASCII letters, digits, underscore, and all bytes above 0x7F).
WORD_BYTE = np.array([chr(b).isalnum() or b == 0x5F or b > 0x7F for b in range(256)])
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)
#: Cumulative probabilities of 0, 1, 2, ... darts in a cell of area one (Poisson).
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def _word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words (runs of word bytes) of one piece."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = WORD_BYTE[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def word_hashes(text: str) -> np.ndarray:
    """Hashes of all words, lower-cased; long texts in pieces cut between words."""
    data = text.lower().encode()
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and WORD_BYTE[data[end]]:
            end += 1
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ordered array, and how often each occurs."""
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def weighted_shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's distinct shingles, in order, and their weights: how often each occurs. A
    text of fewer words than size is one shingle; one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words, np.empty(0, np.int64)
    size = min(size, len(words))
    n = len(words) - size + 1
    shingles = np.full(n, np.uint64(size))
    for i in range(size):
        shingles = mix64(shingles * GOLDEN + words[i : i + n])
    shingles.sort()
    return runs(shingles)


def content_key(text: str, shingles: np.ndarray, weights: np.ndarray) -> bytes:
    """128 bits that equal weighted shingle sets share; texts without words go by their bytes."""
    if not len(shingles):
        return hashlib.blake2b(text.encode(), digest_size=16).digest()
    parts = mix64(shingles + weights.astype(np.uint64) * GOLDEN)
    one, two = mix64(parts ^ np.uint64(0x5851F42D4C957F2D)), mix64(parts + np.uint64(0x14057B7EF767814F))
    return np.array([one.sum(dtype=np.uint64), two.sum(dtype=np.uint64)], ">u8").tobytes()


def dart_signature(parts: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """k coordinates of a non-empty weighted set (without weights each element weighs one), each the
    earliest dart that falls on it.

    Element i owns the strip [0, weight) x [0, infinity) of weight and rank. Cells of area one hold
    a Poisson number of darts, hashed from the element and the cell alone. Ranks are searched up to
    a limit that yields about k ln k + 2k darts; while a coordinate has none, the limit doubles.
    """
    weights = np.ones(len(parts)) if weights is None else weights
    limit = (k * math.log(k) + 2 * k) / weights.sum()
    while True:
        best = _throw(parts, weights, limit, k)
        if not (best == EMPTY).any():
            return best
        limit *= 2


def _throw(parts: np.ndarray, weights: np.ndarray, limit: float, k: int) -> np.ndarray:
    best = np.full(k, EMPTY)
    columns = np.ceil(weights).astype(np.int64)
    ends = np.cumsum(columns)
    rows = max(1, math.ceil(limit))
    # Cells are taken in groups, so that a long document, a heavy element or a high limit stays bounded.
    group = max(1, 200_000 // rows)
    for at in range(0, int(ends[-1]), group):
        cells = np.arange(at, min(at + group, ends[-1]))
        owner = np.searchsorted(ends, cells, side="right")
        column = cells - (ends[owner] - columns[owner])
        cell = mix64(parts[owner] + column.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        cell = mix64(cell[:, None] ^ (np.arange(rows, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5) + np.uint64(1))[None, :])
        count = np.searchsorted(POISSON, (cell >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")
        flat = count.ravel()
        hit = np.repeat(np.arange(flat.size), flat)
        number = np.arange(len(hit)) - np.repeat(np.cumsum(flat) - flat, flat)
        dart = mix64(cell.ravel()[hit] + (number.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        rank = hit % rows + (dart >> np.uint64(11)).astype(np.float64) / 2.0**53
        more = mix64(dart + GOLDEN)
        strip = hit // rows
        height = column[strip] + (more >> np.uint64(11)).astype(np.float64) / 2.0**53
        inside = (rank < limit) & (height < weights[owner[strip]])
        dart, rank = dart[inside], rank[inside]
        # Positive doubles order as their bits do; the low bits tell darts of one rank apart.
        packed = (rank.view(np.uint64) & ~np.uint64(0xFFFFF)) | (dart & np.uint64(0xFFFFF))
        np.minimum.at(best, (mix64(dart ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(k)).astype(np.int64), packed)
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) * GOLDEN
    for i in range(rows):
        keys = mix64(keys * GOLDEN + signature.reshape(bands, rows)[:, i])
    return keys.view(np.int64)


def _sketch(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """(did, th, key, bands) of each row of (did, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keys, found = [], []
            for text in batch.column(2).to_pylist():
                parts, weights = weighted_shingles(text, shingle)
                keys.append(content_key(text, parts, weights))
                found.append(band_keys(dart_signature(parts, weights, bands * rows), bands, rows) if len(parts) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["did", "th", "key", "bands"],
            )

    return by_bytes(docs.select("did", "th", "text")).mapInArrow(run, "did long, th long, key binary, bands array<long>")


def _element_lists(docs: DataFrame, shingle: int) -> DataFrame:
    """(did, th, parts) of each row of (did, th, text): its shingles as ordered 32-bit hashes, each as
    often as it occurs, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (weighted_shingles(text, shingle) for text in batch.column(2).to_pylist())
            parts = [np.repeat((shingles >> np.uint64(32)).astype("<u4"), weights).tobytes() for shingles, weights in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["did", "th", "parts"])

    return by_bytes(docs.select("did", "th", "text")).mapInArrow(run, "did long, th long, parts binary")


def signature_bits(signature: np.ndarray) -> list[int]:
    """Two bits of every coordinate, packed into 64-bit words (of 32 coordinates each)."""
    pairs = (mix64(signature + GOLDEN) & np.uint64(3)).astype(np.uint64)
    pairs = np.concatenate([pairs, np.zeros(-len(pairs) % 32, np.uint64)]).reshape(-1, 32)
    return (pairs << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def most_different_bits(threshold: float, coordinates: int, errors: float = 4.5) -> int:
    """How many of the two bits of each coordinate differ at most between two sets of this similarity:
    the expected number and so many standard errors (4.5: one link in 290,000 goes beyond). A
    coordinate differs with probability 1 - similarity, and then each of its bits does with one half."""
    apart = 1 - threshold
    return math.ceil(coordinates * apart + errors * math.sqrt(coordinates * (1.5 * apart - apart**2)))


def _signed(lists: DataFrame, bands: int, rows: int) -> DataFrame:
    """(did, bands, bits) from element lists: the steep bands, and two bits of all their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bits = [], []
            for raw in batch.column(1).to_pylist():
                parts, weights = runs(np.frombuffer(raw, "<u4"))
                signature = dart_signature(mix64(parts.astype(np.uint64)), weights, bands * rows) if len(parts) else None
                found.append([] if signature is None else band_keys(signature, bands, rows))
                bits.append([] if signature is None else signature_bits(signature))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["did", "bands", "bits"]
            )

    return by_bytes(lists.select("did", "parts")).mapInArrow(run, "did long, bands array<long>, bits array<long>")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two element lists: the lesser weights of shared shingles over the greater of all."""
    one, two = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(one) or not len(two):
        return 0.0
    both = np.concatenate([one, two])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    if (same[1:] & same[:-1]).any() or (one[1:] == one[:-1]).any() or (two[1:] == two[:-1]).any():
        (x, wx), (y, wy) = runs(one), runs(two)
        _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = int(np.minimum(wx[at], wy[to]).sum())
    else:
        shared = int(same.sum())
    return shared / (len(both) - shared)


def _similarities(pairs: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) with their similarity, sim, in so many tasks at most."""
    joined = (
        pairs.join(merging(lists.select(F.col("did").alias("a"), F.col("parts").alias("parts_a"))), "a")
        .join(merging(lists.select(F.col("did").alias("b"), F.col("parts").alias("parts_b"))), "b")
        .select("a", "b", "parts_a", "parts_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            sims = [weighted_jaccard(x, y) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return by_bytes(joined.coalesce(parts)).mapInArrow(run, "a long, b long, sim double")


def _hidden(name: str) -> Column:
    """The column, its partitioning hidden: a join then exchanges this side too, which the adaptive
    skew join needs to split a hot key of the other side."""
    return (F.col(name) + F.lit(0)).alias(name) if name != "key" else F.substring(name, 1, 16).alias(name)


def _meeting(members: DataFrame) -> DataFrame:
    """(band, did, n) of the buckets of n > 1 members."""
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return members.join(merging(sizes.select(_hidden("band"), "n")), "band").select("band", "did", "n")


def _mixed(placed: DataFrame) -> DataFrame:
    """(band, main, size) of the buckets that hold several labels and a member that left without leading;
    main is the label of most members, size their number."""
    kinds = placed.groupBy("band", "label").agg(F.count("*").alias("n"), F.min("leads").alias("leads"))
    buckets = kinds.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("size"), F.min("leads").alias("leads"))
    return buckets.where((F.col("kinds") > 1) & ~F.col("leads")).select(_hidden("band"), "main", "size")


def _bridged(
    exits: DataFrame, labels: DataFrame, signed: DataFrame, lists: DataFrame, threshold: float, coordinates: int, errors: float | None, parts: int, first: int = 64
) -> DataFrame:
    """The labels (did, label), joined by the links between members of a bucket that never met there.

    exits(band, did, left, leads, near): the round in which a member left its bucket, whether it led
    then, and its similarity to the bucket's first leader. A leader was compared with all that were
    waiting; so two members are untested where the first to leave did not lead. Each such pair of
    different labels is compared, unless the triangle inequality (1 - similarity is a metric) or more
    different bits in their signatures than similar texts have (see most_different_bits) rule a link
    out: the members outside the bucket's largest label, with about 64, 512, ... of all its members at a
    time, by a hash of the member. The signatures leave few pairs, so a large bucket makes no square of
    rows; without errors they rule nothing out, and every pair that the triangle inequality leaves is
    compared."""
    words, most = -(-coordinates // 32), most_different_bits(threshold, coordinates, errors or 0.0)
    placed = cut(exits.join(merging(labels), "did"), parts)
    share = F.pmod(F.xxhash64("did", F.lit("turn")), F.lit(1 << 32)) / float(1 << 32)
    turn = F.floor(share * F.col("size")).cast("long") + 1
    placed = placed.join(merging(_mixed(placed)), "band").withColumn("outer", F.col("label") != F.col("main")).withColumn("turn", turn).drop("main", "size")
    placed = cut(placed.join(merging(signed.select(_hidden("did"), "bits")), "did"), parts)
    low, high = 0, first
    while not placed.where(F.col("turn") > low).isEmpty():
        others = placed.where((F.col("turn") > low) & (F.col("turn") <= high))
        others = others.select(_hidden("band").alias("band_b"), *[F.col(c).alias(c + "_b") for c in ("did", "label", "left", "leads", "near", "bits")])
        untested = (
            (F.col("left") < F.col("left_b")) & ~F.col("leads")
            | (F.col("left_b") < F.col("left")) & ~F.col("leads_b")
            | (F.col("left") == F.col("left_b")) & ~F.col("leads") & ~F.col("leads_b")
        )
        differ = reduce(Column.__add__, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i)))) for i in range(words)])
        close = F.abs(F.col("near") - F.col("near_b")) <= 1 - threshold + 1e-9
        close = close if errors is None else close & (differ <= most)
        pairs = placed.where("outer").join(merging(others), (F.col("band") == F.col("band_b")) & (F.col("label") != F.col("label_b")) & close & untested)
        pairs = cut(pairs.select(F.least("did", "did_b").alias("a"), F.greatest("did", "did_b").alias("b")).distinct(), parts)
        found = cut(_similarities(pairs, lists, parts).where(F.col("sim") >= threshold).select("a", "b"))
        if not found.isEmpty():
            of = lambda c: labels.select(F.col("did").alias(c), F.col("label").alias("label_" + c))
            joined = found.join(merging(of("a")), "a").join(merging(of("b")), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
            merged = components(joined, parts).select(F.col("node").alias("label"), F.col("label").alias("to"))
            new = lambda df: df.join(merging(merged), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
            labels = cut(new(labels), parts)
            placed = new(placed)
            placed = cut(placed.join(merging(_mixed(placed).drop("main", "size")), "band"), parts)
        low, high = high, high * 8
        tidy(placed.sparkSession)
    return labels


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = 20,
    rows: int = 5,
    steep_bands: int = 100,
    steep_rows: int = 12,
    errors: float | None = 4.5,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (the smallest identifier of its class),
    ``kept`` (whether it is that one, see below) and ``text_hash`` (xxhash64, which with doc_id tells rows that
    share an identifier apart). Classes are the connected components of links between
    documents whose shingles' weighted Jaccard similarity is at least threshold.

    Words are lower-cased runs of letters, digits and underscores. Null text counts as empty;
    documents without words are duplicates only of equal bytes; documents of fewer words than
    shingle are one shingle. A null identifier counts as the smallest (its class_id is null).
    Each class keeps one document, that of its smallest identifier (of several texts under it, the one
    of the smallest text_hash); rows that repeat it are kept with it. Rows that share an identifier, or
    have none, but not a text are documents of their own. An empty table gives an empty result; other
    columns are not read.

    errors says how far (in standard errors) the signatures of two members of a bucket that never met may
    differ for the pair to be compared: at 4.5 one link in 290,000 among those is not; with None every
    such pair is compared, whatever it costs.

    Plan: equal shingle sets fold to one node, so a group of copies of any size is one row of the
    band table. Documents that share a band with any other are candidates (at the defaults a pair
    of similarity 0.8 does with probability 1 - (1 - 0.8^5)^20 = 0.9996). Candidates' element lists
    are made once, and longer signatures of them, in steeper bands (0.9992 at 0.8), put few texts
    together that are far from similar. In each bucket one member leads first, the one that meets
    most others over all its buckets; every other member is compared with it, and those that fail
    go on among themselves with 16, 64, ... leaders until each has been linked to one or has led.
    Members that the first round linked to one leader are not compared again. A member that left when
    it was linked and one that went on, or left with another leader, have not met: then such pairs,
    where their links so far do not connect them, are compared too (see _bridged), so every two members
    of a bucket are connected or known not to be linked. No bucket is capped; a
    group of near copies folds onto its leader in the first round. Joins on leaders exchange both sides, so the
    adaptive skew join can split a leader that many follow.
    """
    source = docs.select(ident(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    sketches = cut(_sketch(source, bands, rows, shingle))
    # Tables of nodes and links are far smaller than the texts, and each round makes several of them.
    parts = fewest(sketches, ROWS)
    # Nodes are numbered: from here on did is a node's number, and least its smallest (did, th).
    nodes = sketches.groupBy("key").agg(F.min(F.struct("did", "th")).alias("least"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("did", F.monotonically_increasing_id()), parts)
    known = _meeting(nodes.select("did", F.explode("bands").alias("band"))).select("did").distinct()
    known = nodes.join(merging(known), "did").select(F.col("did").alias("node"), F.col("least.did").alias("did"), F.col("least.th").alias("th"))
    lists = _element_lists(source, shingle).join(merging(known), ["did", "th"]).select(F.col("node").alias("did"), "parts")
    lists = cut(lists.dropDuplicates(["did"]), parts)
    signed = cut(_signed(lists, steep_bands, steep_rows))
    # One query, in which both uses of the meetings share their exchanges.
    meet = _meeting(signed.select("did", F.explode("bands").alias("band")))
    met = meet.groupBy("did").agg(F.sum("n").alias("met"))
    start = cut(meet.select("band", "did").join(merging(met.select(_hidden("did"), "met")), "did").select("band", "did", "met"), parts)
    met = cut(start.select("did", "met").distinct(), parts)
    waiting = start.select("band", "did", "met", F.col("did").alias("label"), F.lit(1.0).alias("near"))
    del meet, start
    tidy(docs.sparkSession)
    links, lead, exits = None, 1, []
    while not waiting.isEmpty():
        first = Window.partitionBy("band").orderBy(F.desc("met"), "did")
        leaders = cut(waiting.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= lead).drop("rank"), parts)
        heads = leaders.select(_hidden("band"), F.col("did").alias("b"), F.col("met").alias("met_b"), F.col("label").alias("label_b"))
        after = (F.col("met_b") > F.col("met")) | (F.col("met_b") == F.col("met")) & (F.col("b") < F.col("did"))
        led = waiting.join(merging(heads.withColumnRenamed("band", "band_b")), (F.col("band") == F.col("band_b")) & after & (F.col("label") != F.col("label_b")))
        led = cut(led.select("band", F.col("did").alias("a"), "b", "met_b"), parts)
        scored = cut(_similarities(led.select("a", "b").distinct(), lists, parts))
        found = scored.where(F.col("sim") >= threshold).select("a", "b")
        # The first round's similarities to the one leader stay with the members that go on.
        tried = led.join(merging(scored if links is None else scored.where(F.col("sim") >= threshold)), ["a", "b"])
        outcome = tried.select("band", F.col("a").alias("did"), "sim", F.lit(False).alias("leads")).unionByName(
            leaders.select("band", "did", F.lit(1.0).alias("sim"), F.lit(True).alias("leads"))
        )
        outcome = outcome.groupBy("band", "did").agg(F.max("sim").alias("sim"), F.max("leads").alias("leads"))
        marked = waiting.join(merging(outcome), ["band", "did"], "left").withColumn("leaves", F.coalesce(F.col("leads") | (F.col("sim") >= threshold), F.lit(False)))
        if links is None:
            # A member linked to a leader takes its label, so that links it need not be tested for again.
            linked = tried.where(F.col("sim") >= threshold)
            stars = linked.groupBy(F.col("a").alias("did")).agg(F.max_by("b", F.struct("met_b", "b")).alias("star"))
            marked = marked.join(merging(stars), "did", "left").withColumn("label", F.coalesce("star", "label")).withColumn("near", F.col("sim"))
            del linked, stars
        marked = cut(marked.select("band", "did", "met", "label", "near", "leads", "leaves"), parts)
        exits.append(marked.where("leaves").select("band", "did", F.lit(len(exits)).alias("left"), "leads", "near"))
        waiting = marked.where(~F.col("leaves")).select("band", "did", "met", "label", "near")
        links = found if links is None else links.unionByName(found)
        lead = max(16, lead * 4)
        del leaders, heads, led, scored, tried, outcome, marked
        tidy(docs.sparkSession)
    reps = nodes.select("key", "did", "least")
    if links is None:
        classes = reps.select("key", F.col("least").alias("class"))
    else:
        labels = met.select("did").join(merging(components(links, parts).withColumnRenamed("node", "did")), "did", "left")
        labels = cut(labels.select("did", F.coalesce("label", "did").alias("label")), parts)
        labels = _bridged(reduce(DataFrame.unionByName, exits), labels, signed, lists, threshold, steep_bands * steep_rows, errors, parts)
        reps = cut(reps.join(merging(labels), "did", "left").select("key", "least", F.coalesce("label", "did").alias("label")), parts)
        leasts = reps.groupBy("label").agg(F.min("least").alias("class")).select(_hidden("label"), "class")
        classes = reps.join(merging(leasts), "label").select("key", "class")
    result = sketches.select("did", "th", "key").join(merging(classes.select(_hidden("key"), "class")), "key")
    real = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    kept = (F.col("did") == F.col("class.did")) & (F.col("th") == F.col("class.th"))
    return result.select(real("did").alias("doc_id"), real("class.did").alias("class_id"), kept.alias("kept"), F.col("th").alias("text_hash"))
