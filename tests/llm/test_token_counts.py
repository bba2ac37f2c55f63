import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from notewright.llm import token_counts as T

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return lambda text: len(model.encode(text or "", num_threads=1))


HOSTILE = [
    "", " ", "  ", "   a", "a ", "a  ", "a \n b", "▁", "a▁b", "▁▁ ▁x", " ▁", "x ▁ ", "</s><s> <unk>", "\x00 nul \x00", "\t\t tab", "é漢字🎵 ﬁ①Ａ", "é   　 x",
    "​ zero", "﻿bom", "  line", "퟿ ", "a" * 3000, " " * 500, "ab " * 2000, "▁" * 300,
]


def test_counter_matches_the_library(library, monkeypatch):
    rng = random.Random(3)
    texts = HOSTILE + ["".join(rng.choice("ab ▁ \n\té漢<s>1") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    counter = T.PieceCounter(MODEL)
    assert counter.cuts
    assert counter.counts(texts) == [library(t) for t in texts]
    monkeypatch.setattr(T, "PIECE", 7)
    monkeypatch.setattr(T, "REMEMBERED", 500)
    assert T.PieceCounter(MODEL).counts(texts) == [library(t) for t in texts]


def test_a_model_whose_pieces_go_on_after_spaces_is_not_cut(library):
    counter = T.PieceCounter(MODEL)
    counter.cuts = False
    assert counter.counts(HOSTILE) == [library(t) for t in HOSTILE]


def test_very_long_texts(library):
    text = " ".join(f"word{i % 5000} und{i}" for i in range(250_000))
    assert T.PieceCounter(MODEL).count(text) == library(text)
    assert T.PieceCounter(MODEL).count("etaoin" * 100_000) == library("etaoin" * 100_000)


def test_json_models(make, edge):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in T.token_counts(make(edge), model_path=path).collect()}
    assert got == {d: len(model.encode(t or "", add_special_tokens=False).ids) for d, t in edge}


def test_edges(make, edge, library):
    rows = T.token_counts(make([*edge, edge[3], edge[-1]]), model_path=MODEL, limit=20).collect()
    assert len(rows) == len(edge) + 2
    texts = dict(edge)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 20)
    assert T.token_counts(make([]), model_path=MODEL).collect() == []


def test_only_distinct_misses_are_encoded(spark, make, library, tmp_path):
    cache = str(tmp_path / "cache")
    version = T.tokenizer_version(MODEL)
    count = lambda docs: {r.doc_id: r.n_tokens for r in T.token_counts(docs, model_path=MODEL, cache=cache).collect()}
    stored = lambda: spark.read.parquet(f"{cache}/tokenizer={version}").count()
    first = [(i, f"text number {i % 7}") for i in range(70)]
    assert count(make(first)) == {i: library(t) for i, t in first} and stored() == 7
    assert count(make(first[::-1])) == {i: library(t) for i, t in first} and stored() == 7
    more = [*first, (100, "a new text"), (101, "a new text"), (102, None), (103, "")]
    assert count(make(more)) == {i: library(t) for i, t in more} and stored() == 9
    # Counts come from the cache: one that was changed there shows.
    kept = T.read_cache(spark, cache, version).withColumn("n_tokens", F.lit(-1).cast("long")).collect()
    spark.createDataFrame(kept, T.CACHE_DDL).write.parquet(f"{cache}/other")
    spark.read.parquet(f"{cache}/other").write.mode("overwrite").parquet(f"{cache}/tokenizer={version}")
    assert set(count(make(first)).values()) == {-1}


def test_rows_appended_twice_count_once(spark, make, library, tmp_path):
    cache, version = str(tmp_path / "cache"), T.tokenizer_version(MODEL)
    T.token_counts(make([(1, "said once")]), model_path=MODEL, cache=cache).collect()
    found = spark.createDataFrame(spark.read.parquet(f"{cache}/tokenizer={version}").collect(), T.CACHE_DDL)
    found.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    assert [r.n_tokens for r in T.token_counts(make([(1, "said once")]), model_path=MODEL, cache=cache).collect()] == [library("said once")]


def test_versions_differ(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(open(MODEL, "rb").read() + b"\n")
    assert T.tokenizer_version(MODEL) != T.tokenizer_version(str(other))


def test_many_misses_move_by_digest(make, library, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_KEYS", 0)
    rows = [(i, f"text number {i % 50} " * (i % 9)) for i in range(300)] + [(None, "no name"), (None, "no name")]
    got = T.token_counts(make(rows), model_path=MODEL).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t), library(t)) for _, t in rows)
