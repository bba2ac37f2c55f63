"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks. For each term of a block the index holds which documents have it and,
for every bit of the impact, a bitmap of the documents whose impact has that bit. A query's scores are
the sums of its terms' weighted impacts, made for all documents of a block at once by full adders over
bitmaps; the best are found by going down the sum's slices from the most significant one."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.llm.common import NULL_ID, by_bytes, col, cut, ident, let_go, shared_folder, text_of

#: Bytes that terms are made of: ASCII letters and digits, and all bytes above 0x7F.
TERM_BYTE = [chr(b).isalnum() if b < 128 else True for b in range(256)]
#: Each byte as a term has it (A-Z in lower case), a space for those between terms.
AS_TERM = bytes((ord(chr(b).lower()) if b < 128 else b) if TERM_BYTE[b] else 0x20 for b in range(256))
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block ends at so many documents or so many postings; both bound a task's memory, not a result.
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 21
#: Items whose sums a task holds at once.
ITEMS_AT_ONCE = 1 << 11
#: Fixed values of the score: the impact's scale, its saturation, the share of a document's length.
SCALE, SATURATION, SLOPE = 10**9, 8, 90

#: Pairs of a term and an item (about 20 bytes each) up to which terms, with their weights and items,
#: are broadcast; beyond, postings move to them.
BROADCAST_PAIRS = 1 << 17

#: kind 0: a block's documents, places holding their identifiers (64 bits each); kind 1: a term's
#: postings, places holding their numbers in the block (16 bits each) and slices the bitmaps over them,
#: one after another, lowest bit first, each of (df + 7) div 8 bytes.
INDEX_DDL = "kind int, block long, term string, df int, places binary, slices binary"
INDEX = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.binary()), ("slices", pa.binary())])


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int


def terms_of(text: Column) -> Column:
    """The terms of a text in their order, with repeats."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda t: t != "")


def corpus_counts(docs: DataFrame, text_col: str = "text") -> Corpus:
    n = F.size(F.filter(F.split(text_of(text_col), BETWEEN), lambda t: t != "")).cast("long")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Corpus(row["documents"], row["terms"])


def impacts(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Impacts of terms that occur tf times in documents of n terms, before the term's weight."""
    m = 100 - SLOPE + (SLOPE * n * corpus.documents) // corpus.terms
    return (SCALE * tf) // (1000 * tf + SATURATION * m)


def sliced(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of each bit of values, one a row, lowest first, and where each run's bytes begin: runs of
    the given sizes start on bytes of their own, so a run's bitmaps are a slice of columns."""
    starts = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 8 * np.repeat(starts[:-1], sizes)
    out = np.empty((int(values.max()).bit_length(), starts[-1]), np.uint8)
    room = np.zeros(8 * starts[-1], np.uint8)
    for bit in range(len(out)):
        room[at] = (values >> bit) & 1
        out[bit] = np.packbits(room, bitorder="little")
    return out, starts


class Block:
    """Documents of one partition, until they are enough for a block."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.occurrences: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}
        self.postings = 0

    def add(self, doc: int, text: bytes) -> None:
        words = text.translate(AS_TERM).split()
        if words:
            counts, number_of, known = Counter(words), self.vocabulary.setdefault, self.vocabulary
            self.ids.append(doc)
            self.lengths.append(len(words))
            self.terms.append(np.fromiter((number_of(t, len(known)) for t in counts), np.int32, len(counts)))
            self.occurrences.append(np.fromiter(counts.values(), np.int32, len(counts)))
            self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def rows(self, number: int, corpus: Corpus) -> Iterator[pa.RecordBatch]:
        """The block's rows; its documents are numbered by ascending identifier."""
        if not self.ids:
            return
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        place_of = np.empty(len(ids), np.uint16)
        place_of[order] = np.arange(len(ids))
        held = [len(t) for t in self.terms]
        term, place = np.concatenate(self.terms), np.repeat(place_of, held)
        tf, n = np.concatenate(self.occurrences).astype(np.int64), np.repeat(np.array(self.lengths, np.int64), held)
        by_term = np.lexsort((place, term))
        sizes = np.bincount(term, minlength=len(self.vocabulary))
        slices, starts = sliced(impacts(tf[by_term], n[by_term], corpus), sizes)
        places, ends = place[by_term], np.concatenate([[0], np.cumsum(sizes)])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((0, number, None, len(ids), ids[order].tobytes(), None), INDEX, strict=True)], schema=INDEX)
        words = [t.decode() for t in self.vocabulary]
        for at in range(0, len(words), 4096):
            some = range(at, min(at + 4096, len(words)))
            columns = (
                [1] * len(some), [number] * len(some), words[at : at + 4096], sizes[at : at + 4096],
                [places[ends[t] : ends[t + 1]].tobytes() for t in some], [slices[:, starts[t] : starts[t + 1]].tobytes() for t in some],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)


def build_index(docs: DataFrame, corpus: Corpus, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index (INDEX_DDL) of every whole text. Each task makes blocks of the documents it reads, so
    nothing moves; the rows of the index are few to a block, whatever a text's length. Write it to a
    table before it is searched (write_index): blocks follow the partitions of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        let_go()
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.add(doc, text)
                if block.full():
                    yield from block.rows(number, corpus)
                    number, block = number + 1, Block()
        yield from block.rows(number, corpus)

    return by_bytes(docs.select(ident(id_col).alias("did"), text_of(text_col).cast("binary").alias("text"))).mapInArrow(run, INDEX_DDL)


def write_index(docs: DataFrame, corpus: Corpus, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index to a Parquet table in a folder that all executors share, and opens it."""
    build_index(docs, corpus, id_col=id_col, text_col=text_col).write.parquet(folder)
    return open_index(docs.sparkSession, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_DDL).parquet(folder)


# Numbers of all documents of a block are lists of bitmaps, lowest bit first; a bitmap is an integer
# whose bit i belongs to document i.


def added(a: list[int], b: list[int]) -> list[int]:
    """The sum of two sliced numbers, by a full adder a slice with the carry passed on."""
    if len(a) < len(b):
        a, b = b, a
    out, carry = [], 0
    for i, x in enumerate(a):
        y = b[i] if i < len(b) else 0
        if y or carry:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
        else:
            out.append(x)
    if carry:
        out.append(carry)
    return out


def times(slices: list[int], weight: int) -> list[int]:
    """The sliced number times a weight: shifted copies, added."""
    out: list[int] = []
    for bit in range(weight.bit_length()):
        if weight >> bit & 1:
            out = added(out, [0] * bit + slices)
    return out


def widened(places: bytes, slices: bytes, size: int) -> list[int]:
    """A term's bitmaps over its own documents, spread over those of the block."""
    at = np.frombuffer(places, np.uint16)
    own = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(-1, (len(at) + 7) // 8), axis=1, count=len(at), bitorder="little")
    room = np.zeros((len(own), size), np.uint8)
    room[:, at] = own
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(room, axis=1, bitorder="little")]


def positions(bitmap: int) -> Iterator[int]:
    """The documents of a bitmap, ascending."""
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def best(slices: list[int], k: int) -> list[int]:
    """The k documents of largest value above 0 (all, if fewer), in no order; of equal values those of
    lower number. From the most significant slice down, sure holds documents that are among the best
    whatever follows, tied those that are equal so far."""
    some = 0
    for s in slices:
        some |= s
    if some.bit_count() <= k:
        return list(positions(some))
    sure, tied = 0, some
    for s in reversed(slices):
        ahead = tied & s
        count = (sure | ahead).bit_count()
        if count > k:
            tied = ahead
        else:
            sure, tied = sure | ahead, tied & ~s
            if count == k:
                return list(positions(sure))
    chosen = list(positions(sure))
    for place in positions(tied):
        if len(chosen) == k:
            break
        chosen.append(place)
    return chosen


def value(slices: list[int], place: int) -> int:
    return sum((s >> place & 1) << bit for bit, s in enumerate(slices))


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each term once an item."""
    words = items.select(col(id_col).alias("item"), F.explode(terms_of(text_of(text_col))).alias("term"))
    return words.distinct()


def search(index: DataFrame, items: DataFrame, corpus: Corpus, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score``: the k best documents of each item, by
    descending score above 0, then ascending doc_id (null first).

    A term's weight follows from its document frequency, which the index sums up. Where the items have
    few terms (counted before), their weights go to the postings, else postings of the items' terms move. Items are dealt into
    parts of about ITEMS_AT_ONCE. A block's postings meet the weights and items of their terms (one row
    a term and part, however many items have it) and come together by block and part, of bounded size.
    A block yields at most k documents an item; the ranking prunes by task before it moves them. Items
    without a term, or whose terms no document has, have no row; rows that share an identifier are one
    item; repeated documents are ranked each."""
    words = query_terms(items, id_col, text_col)
    parts = -(-words.select("item").distinct().count() // ITEMS_AT_ONCE)
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, parts))).cast("int").alias("part")
    asked = words.groupBy("term", part).agg(F.collect_set(F.struct("item")).alias("items"))
    postings = index.where("kind = 1")
    found = postings.join(words.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * corpus.documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = cut(asked.join(found, "term").select("term", "part", "items", weight.alias("weight")).where("weight > 0"))
    pairs = weights.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    met = postings.join(F.broadcast(weights) if pairs <= BROADCAST_PAIRS else weights, "term").select("block", "part", "kind", "places", "slices", "weight", "items")
    none = F.lit(None)
    every = F.explode(F.sequence(F.lit(0), F.lit(max(1, parts) - 1))).alias("part")
    heads = index.where("kind = 0").select("block", every, "kind", "places", "slices", none.cast("long").alias("weight"), none.cast(weights.schema["items"].dataType).alias("items"))
    item_type = items.schema[id_col].dataType

    def run(table: pa.Table) -> pa.Table:
        let_go()
        kinds = table.column("kind").to_pylist()
        ids = np.frombuffer(table.column("places")[kinds.index(0)].as_py(), np.int64)
        sums: dict[object, list[int]] = {}
        for row in range(table.num_rows):
            if kinds[row]:
                terms = times(widened(table.column("places")[row].as_py(), table.column("slices")[row].as_py(), len(ids)), table.column("weight")[row].as_py())
                for item in table.column("items")[row].as_py():
                    sums[item["item"]] = added(sums.get(item["item"], []), terms)
        out = [(item, int(ids[p]), value(slices, p)) for item, slices in sums.items() for p in best(slices, k)]
        fields = [table.schema.field("items").type.value_type.field("item").type, pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=["item", "doc_id", "score"])

    by_block = met.unionByName(heads).groupBy("block", "part").applyInArrow(run, f"item {item_type.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = by_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    doc = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    return ranked.select(F.col("item").alias("item_id"), "rank", doc.alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """Indexes docs(doc_id, text) and ranks them for items(item_id, text): see search.

    Null or empty texts have no terms and are left out of the counts; null identifiers sort first;
    very long texts are read in whole; an empty table gives an empty result; other columns are not
    read. Texts are read twice, once to count and once to index, and never move."""
    corpus = corpus_counts(docs)
    index = write_index(docs, corpus, f"{shared_folder(docs.sparkSession)}/impact-index-{uuid.uuid4().hex}")
    return search(index, items, corpus, k=k)
