"""Every operator on a text of five million characters, twice, beside a short one."""

import hashlib

import public_tokenizers as P
import pytest

from notewright.llm import bpe, exact_dedup, impact_index, line_dedup, merkle, mixing, near_dedup, secrets, suffix_dedup, token_counts, toxicity, winnow

LONG = "\n".join(f"line {i} of word{i % 9973} and é{i % 77} said in a text that goes on" for i in range(90_000))
LONG += "z" * (5_000_000 - len(LONG))


@pytest.fixture(scope="module")
def docs(make):
    return make([(1, LONG), (2, LONG), (3, "short and to the point"), (4, None)]).cache()


def by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


def test_lines(docs):
    got = {r.row.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].n_lines == got[2].n_lines == LONG.count("\n") + 1 and got[1].kept_text == got[2].kept_text == LONG


def test_secrets(docs):
    got = by_id(secrets.find_secrets(docs))
    assert got[1].spans == got[2].spans and got[4].spans == []


def test_fingerprints(docs):
    rows = by_id(winnow.fingerprint_edits(docs))
    assert rows[1].n_chars == len(LONG) and rows[1].fingerprint == rows[2].fingerprint and rows[2].near_next == 1.0


def test_suffixes(docs):
    got = by_id(suffix_dedup.suffix_dedup(docs, length=100))
    size = len(LONG.encode())
    gone = {d: sum(s.end - s.start for s in got[d].spans) for d in got}
    assert got[2].n_bytes == size and gone[2] == size and gone[1] < 6 * size / 10 and gone[3] == gone[4] == 0


def test_copies(docs):
    got = by_id(exact_dedup.exact_dedup(docs))
    assert (got[1].keep_id, got[1].group_size, got[1].text_sha256) == (2, 2, hashlib.sha256(LONG.encode()).hexdigest())


def test_encoding(docs):
    got = by_id(bpe.encode_documents(docs, ranks_path=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, with_ids=False, with_digests=True))
    assert got[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[1].n_tokens == got[2].n_tokens


def test_near_copies(docs):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[1].class_id == got[2].class_id == 1 and got[3].class_id == 3


def test_toxicity(docs, spark):
    model = toxicity.Model({"moron": 1.0, "blockhead": 1.0}, {}, frozenset())
    got = {r.row.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert got[1] == got[2] == got[4] < 0.5


def test_mixing(docs):
    assert sorted(r.row.doc_id for r in mixing.mix_sources(docs).collect()) == [1, 2, 3, 4]


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = by_id(token_counts.token_counts(docs, model_path=P.path("piece_bpe_32k.model")))
    assert got[1].n_tokens == got[2].n_tokens == len(model.encode(LONG, num_threads=1)) and got[1].over_limit


def test_manifest(docs):
    from test_merkle import leaf

    got = by_id(merkle.dataset_manifest(docs))
    assert got[1].leaf == leaf((1, "source", "lang", len(LONG), LONG)) and all(r.verified for r in got.values())


def test_search(docs, spark):
    items = spark.createDataFrame([(7, "WORD9972 is here")], "item_id long, text string")
    got = [(r["rank"], r.doc_id) for r in impact_index.ranked_search(docs, items).orderBy("rank").collect()]
    assert got[:2] == [(1, 1), (2, 2)] or got == []
