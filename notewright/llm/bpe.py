"""Byte-level BPE with DuckDB recursive queries in each partition.

Texts are split by the tokenizer's pattern. Words not met before become token-position rows; a
recursive query joins their neighbouring pairs with the merge table and contracts each word's
leftmost pair of minimum rank until none is left. Ordered aggregation decodes the ids."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import by_bytes, col, held, text_of

#: Words of at most so many bytes contract together; longer ones have a query that takes all places
#: of a pair at once and keeps one state, as their rows would otherwise pile up merge by merge.
SHORT_BYTES = 64
#: Words of more bytes are cut into pieces of PIECE_BYTES, whose ids are joined (see Codec._joined), over
#: so many tokens to either side of a cut at first.
LONGEST_BYTES = 1024
PIECE_BYTES = 60
SEAM = 3
#: Rows that the states of a query's short words add up to, about; bytes of words and ids that a worker
#: remembers, words encoded and ids decoded by one query, bytes of long words in one query, bytes of
#: text taken at once: bounds on memory (a single longer text goes alone).
STATE_ROWS = 2_000_000
REMEMBERED = 96 << 20
WORDS_AT_ONCE = 20_000
IDS_AT_ONCE = 200_000
LONG_AT_ONCE = 100_000
TEXT_AT_ONCE = 1 << 20
#: What an entry of the worker's memory takes besides its bytes.
ENTRY = 200

#: A pair of tokens is packed as left << 20 | right, a place as word << 20 | position, a candidate
#: merge as rank << 20 | position. Words that no pair contracts leave the recursion as done.
ENCODE = """
WITH RECURSIVE state AS (
  SELECT place, tok, false AS done FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT place, place >> 20 AS word, tok, lead(tok) OVER w AS after, lead(place) OVER w AS further, lag(place) OVER w AS before
     FROM state WHERE NOT done WINDOW w AS (ORDER BY place)),
   best AS (
     SELECT word, min((merged::BIGINT << 20) | (place & 1048575)) AS hit
     FROM pairs JOIN merges ON pair = ((tok::BIGINT << 20) | after)
     WHERE further >> 20 = word GROUP BY word)
   SELECT place, CASE WHEN (place & 1048575) = (hit & 1048575) THEN (hit >> 20)::INTEGER ELSE tok END, hit IS NULL
   FROM pairs p LEFT JOIN best b ON p.word = b.word
   WHERE hit IS NULL OR before IS NULL OR before <> ((p.word << 20) | (hit & 1048575))))
SELECT place >> 20 AS word, list(tok ORDER BY place) AS ids FROM state WHERE done GROUP BY word ORDER BY word
"""
#: As above with places packed as word << 32 | position. A step contracts the word's pair of minimum
#: rank at all its places from the left (of overlapping ones every other), as one step after another
#: would: up to the first place that gives rise to a pair of lower rank. Places that a merge took have
#: the token -1; a word that no pair contracts is left out of the next step.
ENCODE_LONG = """
WITH RECURSIVE state(place, tok) USING KEY (place) AS (
  SELECT place, tok FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT place, place >> 32 AS word, tok, lead(tok) OVER w AS after, lead(place) OVER w AS further, lag(tok) OVER w AS prior,
            lead(tok, 2) OVER w AS beyond, row_number() OVER w AS nr
     FROM state WHERE tok >= 0 WINDOW w AS (PARTITION BY place >> 32 ORDER BY place)),
   met AS (SELECT p.*, merged FROM pairs p JOIN merges ON pair = ((tok::BIGINT << 20) | after)),
   best AS (SELECT word, min(merged) AS low FROM met GROUP BY word),
   hits AS (
     SELECT met.*, low, nr - row_number() OVER (PARTITION BY met.word ORDER BY nr) AS run FROM met JOIN best ON met.word = best.word WHERE merged = low),
   taken AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY nr) % 2 = 1),
   sides AS (
     SELECT *, CASE WHEN lag(nr) OVER v = nr - 2 THEN low ELSE prior END AS left_tok FROM taken WINDOW v AS (PARTITION BY word ORDER BY nr)),
   stops AS (
     SELECT word, min(nr) AS stop FROM sides
     LEFT JOIN merges l ON l.pair = ((left_tok::BIGINT << 20) | low) LEFT JOIN merges r ON r.pair = ((low::BIGINT << 20) | beyond)
     WHERE l.merged < low OR r.merged < low GROUP BY word),
   gone AS (SELECT place, further FROM sides s LEFT JOIN stops ON s.word = stops.word WHERE stop IS NULL OR nr <= stop)
   SELECT p.place, CASE WHEN a.place IS NOT NULL THEN low WHEN g.further IS NOT NULL THEN -1 ELSE tok END
   FROM pairs p JOIN best ON p.word = best.word LEFT JOIN gone a ON p.place = a.place LEFT JOIN gone g ON p.place = g.further))
SELECT place >> 32 AS word, list(tok ORDER BY place) AS ids FROM state WHERE tok >= 0 GROUP BY word ORDER BY word
"""
DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN vocabulary USING (tok) GROUP BY doc
"""


class Codec:
    """Encoder and decoder of one rank file; one per Python worker and file."""

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        return held(("bpe", ranks_path, pattern), lambda: cls(ranks_path, pattern))

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [
            ((left << 20) | right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        table = pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "merged": pa.array([m[1] for m in merges], pa.int32())})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        table = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.words: dict[str, bytes] = {}
        self.size = 0

    def _contract(self, parts: list[bytes], query: str, shift: int) -> list[bytes]:
        """The ids of each part, by one recursive query."""
        sizes = np.array([len(e) for e in parts])
        flat = self.single[np.frombuffer(b"".join(parts), np.uint8)]
        position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = pa.table({"place": (np.repeat(np.arange(len(parts)), sizes) << shift) | position, "tok": flat})
        self.db.register("start", start)
        ids = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("start")
        values, offsets = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(parts))]

    def _ids(self, parts: list[bytes], cut: bool = True) -> list[bytes]:
        """The ids of each part, by queries of bounded size; with cut, very long parts by pieces."""
        out: list[bytes] = [b""] * len(parts)
        kinds: dict[str, list[int]] = {ENCODE: [], ENCODE_LONG: []}
        held = {ENCODE: 0, ENCODE_LONG: 0}
        limits = {ENCODE: STATE_ROWS, ENCODE_LONG: LONG_AT_ONCE}

        def settle(query: str) -> None:
            if kinds[query]:
                found = self._contract([parts[i] for i in kinds[query]], query, 20 if query is ENCODE else 32)
                for i, ids in zip(kinds[query], found, strict=True):
                    out[i] = ids
                kinds[query], held[query] = [], 0

        for i, part in enumerate(parts):
            if cut and len(part) > LONGEST_BYTES:
                out[i] = self._joined(part)
                continue
            query = ENCODE if len(part) <= SHORT_BYTES else ENCODE_LONG
            cost = len(part) ** 2 // 2 if query is ENCODE else len(part)
            if held[query] + cost > limits[query] or len(kinds[query]) >= WORDS_AT_ONCE:
                settle(query)
            kinds[query].append(i)
            held[query] += cost
        settle(ENCODE)
        settle(ENCODE_LONG)
        return out

    def _joined(self, data: bytes) -> bytes:
        """The ids of a very long word, from those of its pieces.

        A sequence of ids is the encoding of its bytes if every two neighbours are the encoding of
        theirs: whether a pair merges depends on what stands next to it alone. So the ids on both sides
        of a cut are made anew over a few tokens to the left and right, and stay where the new ones go
        with their neighbours; else the stretch doubles. What the cuts need is asked for all at once
        first, then settled from the left; no query sees more than a stretch."""
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        known: dict[bytes, list[int]] = {}

        def learn(parts: list[bytes]) -> None:
            fresh = [p for p in dict.fromkeys(parts) if p not in known]
            for p, ids in zip(fresh, self._ids(fresh, cut=False), strict=True):
                known[p] = np.frombuffer(ids, "<u4").tolist()

        def of(part: bytes) -> list[int]:
            if part not in known:
                learn([part])
            return known[part]

        spelt = lambda ids: b"".join([self.tokens[i] for i in ids])
        stay = lambda a, b: of(self.tokens[a] + self.tokens[b]) == [a, b]
        learn(pieces)
        beside = [(known[a], known[b]) for a, b in zip(pieces, pieces[1:], strict=False)]
        learn([spelt(a[-SEAM:]) + spelt(b[:SEAM]) for a, b in beside])
        middles = [known[spelt(a[-SEAM:]) + spelt(b[:SEAM])] for a, b in beside]
        ends = [(a[-SEAM - 1], m[0]) for (a, _), m in zip(beside, middles, strict=True) if len(a) > SEAM]
        ends += [(m[-1], b[SEAM]) for (_, b), m in zip(beside, middles, strict=True) if len(b) > SEAM]
        learn([self.tokens[x] + self.tokens[y] for x, y in dict.fromkeys(ends)])
        out = list(known[pieces[0]])
        for piece in pieces[1:]:
            right, reach = known[piece], SEAM
            while True:
                kept = max(0, len(out) - reach)
                middle = of(spelt(out[kept:]) + spelt(right[:reach]))
                if (kept == 0 or stay(out[kept - 1], middle[0])) and (len(right) <= reach or stay(middle[-1], right[reach])):
                    break
                reach *= 2
            out[kept:] = middle
            out += right[reach:]
        return np.array(out, "<u4").tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Encodes words not met before."""
        parts = [w.encode() for w in fresh]
        for word, part, ids in zip(fresh, parts, self._ids(parts), strict=True):
            self.words[word] = ids
            self.size += len(part) + len(ids) + ENTRY

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The text's words, in lists of bounded length."""
        if len(text) <= WORDS_AT_ONCE * 10:
            yield self.split(text)
            return
        words: list[str] = []
        for m in self.pattern.finditer(text):
            words.append(m.group())
            if len(words) >= WORDS_AT_ONCE:
                yield words
                words = []
        yield words

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [bytearray() for _ in texts]
        pending: list[tuple[int, list[str]]] = []
        fresh: dict[str, None] = {}

        def settle() -> None:
            if self.size > REMEMBERED:
                self.words.clear()
                self.size = 0
                for _, words in pending:
                    fresh.update(dict.fromkeys(words))
            self._learn(list(fresh))
            known = self.words
            for i, words in pending:
                out[i] += b"".join([known[w] for w in words])
            pending.clear()
            fresh.clear()

        size = 0
        for i, text in enumerate(texts):
            for words in self._pieces(text):
                pending.append((i, words))
                size += len(words)
                fresh.update((w, None) for w in words if w not in self.words)
                if len(fresh) >= WORDS_AT_ONCE or size >= 200_000:
                    settle()
                    size = 0
        settle()
        return [bytes(x) for x in out]

    def decode(self, documents: list[bytes]) -> list[bytes]:
        """The bytes that each document's ids stand for; long documents in several queries."""
        out = [bytearray() for _ in documents]
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if waiting:
                flat = np.concatenate([x for _, x in waiting])
                doc = np.repeat([i for i, _ in waiting], [len(x) for _, x in waiting])
                self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(flat)), "tok": flat}))
                for i, raw in self.db.sql(DECODE).fetchall():
                    out[i] += raw
                waiting.clear()

        size = 0
        for i, raw in enumerate(documents):
            ids = np.frombuffer(raw, "<u4").astype(np.int32)
            for at in range(0, len(ids), IDS_AT_ONCE):
                piece = ids[at : at + IDS_AT_ONCE]
                if size + len(piece) > IDS_AT_ONCE:
                    settle()
                    size = 0
                waiting.append((i, piece))
                size += len(piece)
        settle()
        return [bytes(x) for x in out]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts (column 1) take about TEXT_AT_ONCE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + TEXT_AT_ONCE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode_documents(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_digests: bool = False,
) -> DataFrame:
    """One row per input row: the identifier, ``n_tokens``, with with_ids ``ids`` (array<int>), and
    with with_digests ``ids_sha256`` (of little-endian unsigned 32-bit ids) and ``decoded_sha256``
    (of the bytes that the ids decode to).

    Null text counts as empty (no ids); null identifiers pass through; repeated rows are encoded
    each; an empty table gives an empty result; other columns are not read. ranks_path must be
    readable on every executor. One pass, no shuffle. A word of any length is encoded in whole, in
    queries of bounded size: what a task holds of it are its bytes, its pieces and its ids.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for whole in batches:
            for batch in _portions(whole):
                ids = codec.encode(batch.column(1).to_pylist())
                columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                if with_digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return by_bytes(docs.select(col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, T.StructType(fields))


def decode_documents(
    tokens: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """One row per input row: the identifier and ``bytes``. Null ids decode to no bytes."""
    fields = [T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codec.decode(ids), pa.binary())], names=[id_col, "bytes"]
            )

    ids = F.coalesce(col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return by_bytes(tokens.select(col(id_col), ids.alias("ids"))).mapInArrow(run, T.StructType(fields))
