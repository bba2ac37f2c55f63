"""Token counts with a digest cache.

A text's normal form and the tokenizer's version have digests, and a cache (a Parquet table) holds
the count of each pair. Only distinct texts that the cache lacks are encoded; their counts are
appended, and every row takes its count from the cache."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.common import by_bytes, col, cut, held, ident, shared_folder, text_of

#: The mark that the piece library writes for a space; a word is a run of marks and what follows.
MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of a text that are cut into words at once; bytes of words that a worker remembers, what
#: an entry takes besides, and the longest word that it remembers: bounds on memory, not on results.
PIECE = 1 << 20
REMEMBERED = 64 << 20
ENTRY = 120
LONGEST = 64
#: Missing keys (40 bytes each) up to which they are broadcast instead of moving the texts.
BROADCAST_KEYS = 4096

CACHE_DDL = "digest binary, n_bytes long, n_tokens long"


def tokenizer_version(model_path: str) -> str:
    """Hex digest of what decides a count: the library, its version and the vocabulary file."""
    kind = "sentencepiece" if model_path.endswith(".model") else "tokenizers"
    with open(model_path, "rb") as file:
        return hashlib.sha256(f"{kind} {__import__(kind).__version__}\n".encode() + file.read()).hexdigest()


class PieceCounter:
    """Counts of a .model file. A text is cut where a run of spaces begins, provided that no piece of
    the vocabulary goes on with a space after anything else: merges then never cross such a cut, so
    the words' counts add up to the text's, and a worker remembers them. A text that the library
    normalises otherwise than by marking its spaces is encoded in one go."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.model.normalize("a") == f"{MARK}a"
        self.lone = self._whole("a ") - self._whole("a")  # a single space at the end
        self.words: dict[str, int] = {}
        self.size = 0

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def _learn(self, words: set[str]) -> dict[str, int]:
        """Counts of words not met before; the first mark of each is the one the library adds."""
        fresh = list(words)
        ids = self.model.encode([w[1:].replace(MARK, " ") for w in fresh], num_threads=1)
        found = {w: len(x) if w != MARK else self.lone for w, x in zip(fresh, ids, strict=True)}
        if self.size > REMEMBERED:
            self.words.clear()
            self.size = 0
        kept = {w: n for w, n in found.items() if len(w) <= LONGEST}
        self.words.update(kept)
        self.size += sum(4 * len(w) + ENTRY for w in kept)
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts or self.model.normalize(text) != MARK + text.replace(" ", MARK):
            return self._whole(text)
        marked, total, at = MARK + text.replace(" ", MARK), 0, 0
        while at < len(marked):
            end = at + PIECE
            while end < len(marked) and not (marked[end] == MARK and marked[end - 1] != MARK):
                after = marked.find(MARK, end + 1)
                end = after if after >= 0 else len(marked)
            words = WORD.findall(marked, at, end)
            known = self.words
            fresh = {w for w in words if w not in known}
            found = {w: known[w] for w in set(words) - fresh} | self._learn(fresh) if fresh else known
            total += sum(map(found.__getitem__, words))
            at = end
        return total

    def counts(self, texts: list[str]) -> list[int]:
        return [self.count(t) for t in texts]


class FileCounter:
    """Counts of a .json file, as its library encodes by default, without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for t in texts for e in self.model.encode_batch([t], add_special_tokens=False)]


def counter(model_path: str) -> PieceCounter | FileCounter:
    kind = PieceCounter if model_path.endswith(".model") else FileCounter
    return held(("token_counts", model_path), lambda: kind(model_path))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_bytes, n_tokens) that the cache holds for the tokenizer version, one row a digest;
    without a folder yet, none. Rows that two runs have both appended count once."""
    try:
        found = spark.read.schema(CACHE_DDL).parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_DDL)
    return found.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def encode_missing(docs: DataFrame, missing: DataFrame, *, model_path: str, id_col: str, text_col: str) -> DataFrame:
    """(digest, n_bytes, n_tokens) of the texts that missing (digest, did) names, one row of each.

    The texts move once, dealt by digest and identifier together, so copies spread; where only few
    keys are missing (counted before), the keys go to the texts instead."""
    text = text_of(text_col)
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), ident(id_col).alias("did"), text.alias("text"))
    keys = F.broadcast(missing) if missing.count() <= BROADCAST_KEYS else missing.hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(model.counts(texts), pa.int64())], names=["digest", "n_bytes", "n_tokens"]
            )

    wanted = texts.join(keys, ["digest", "did"], "left_semi").select("digest", "text")
    return by_bytes(wanted).mapInArrow(run, CACHE_DDL)


def token_counts(
    docs: DataFrame, *, model_path: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more
    tokens than limit), as the library of model_path (.model or .json, readable on every executor)
    counts the whole text without added special tokens.

    cache is a folder that the driver and all executors share; it holds a Parquet table for each
    tokenizer version and may serve many corpora. Without one, the call has a cache of its own in the
    checkpoint folder. The normal form that a count is stored by differs from the text in one way,
    that null is empty: any other change could change a count.

    Null text counts as empty (no tokens); null identifiers pass through; repeated rows each have a
    row, and their text is encoded once a digest and identifier at most; very long texts are cut as
    PieceCounter says; an empty table gives an empty result; other columns are not read.

    Plan: texts are hashed where they are read, digests of 40 bytes are settled by a checkpoint and
    folded before they move; a digest's row of least identifier alone is encoded. A group of copies
    with a third of all rows is one row there, and the last join is one that Spark can split. A run
    that fails after its counts were appended finds them when it runs again."""
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    cache = cache or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    text = text_of(text_col)
    rows = cut(
        docs.select(
            ident(id_col).alias("did"), col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
        )
    )
    known = read_cache(spark, cache, version).select("digest")
    missing = cut(rows.groupBy("digest").agg(F.min("did").alias("did")).join(known, "digest", "left_anti"))
    fresh = encode_missing(docs, missing, model_path=model_path, id_col=id_col, text_col=text_col)
    fresh.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    counts = read_cache(spark, cache, version).select("digest", "n_tokens")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
