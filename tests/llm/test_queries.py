"""Each query against a brute-force version over a whole small table."""

import hashlib
import re

import pytest

import __spark_entry__
from notewright.llm import winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in __spark_entry__.queries()[name](spark, SF).collect()}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


def test_secret_scan(spark, texts):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = rows(spark, "op2_secret_scan")
    for doc, text in texts.items():
        spans = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        order = {"assign": 0, "access": 1, "hex": 2}
        spans.sort(key=lambda s: (s[1].start(), order[s[0]]))
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
        r = got[doc]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _ in spans) for x in order)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert {s for s in joined.split(",") if s} <= set(r.spans.split(","))


def test_winnowing(spark, texts):
    got = rows(spark, "op3_winnowing")
    order = sorted(texts, reverse=True)
    prints = lambda t: winnow.encode(*winnow.winnow(winnow.code_points(t), 20, 40))
    hashes = lambda p: set(winnow.decode(p)[1].tolist())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints(text), prints(edited))
        assert r.near_edited == pytest.approx(like(hashes(r.fingerprint), hashes(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(like(hashes(r.fingerprint), hashes(prints(after))))


def test_suffix_dedup(spark, texts):
    got, seen = rows(spark, "op4_suffix_dedup"), set()
    for doc in sorted(texts):
        data = texts[doc].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            string = data[s : s + 100]
            if string in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(string)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_byte_bpe(spark, texts):
    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from notewright.llm.bpe import Codec

    ranks = Codec.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc, r in rows(spark, "op6_byte_bpe").items():
        ids = known.encode_ordinary(texts[doc])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[doc].encode()).hexdigest()


def test_near_dedup(spark, texts):
    from test_near_dedup import brute

    want = brute(sorted(texts.items()))
    assert {d: r.class_id for d, r in rows(spark, "op7_near_dedup").items()} == want


def brute_scores(model, texts):
    """Every word of every text against every term by its edit distance, without an automaton."""
    import math
    from collections import Counter

    from test_toxicity import distance

    from notewright.llm import toxicity as X

    terms = [(t, X.edits_allowed(t), Counter(t)) for t in model.words]

    def hit(word):
        if word in model.clean:
            return None
        letters = Counter(word)
        near = [(0, True, b) for b in model.beginnings if word.startswith(b)]
        for term, allowed, own in terms:
            if abs(len(term) - len(word)) <= allowed and max((own - letters).total(), (letters - own).total()) <= allowed:
                errors = distance(word, term)
                near += [(errors, False, term)] if errors <= allowed else []
        if not near:
            return None
        errors, beginning, term = min(near)
        return (model.beginnings if beginning else model.words)[term] / (1 + errors), term

    known, out = {}, {}
    for doc, text in texts.items():
        low = text.lower()
        base = text if len(low) == len(text) else low
        total, found, words = 0.0, set(), 0
        for m in re.finditer(r"\w+", low):
            words += 1
            if m[0] not in known:
                known[m[0]] = hit(m[0])
            if known[m[0]]:
                total += known[m[0]][0] * X.context(base, m.start(), m.end())
                found.add(known[m[0]][1])
        x = (math.log1p(total), math.log1p(len(found)), math.log1p(200 * total / (words + 50))) if found else (0, 0, 0)
        out[doc] = 1 / (1 + math.exp(-(model.bias + sum(a * b for a, b in zip(model.slopes, x, strict=True)))))
    return out


def test_toxicity(spark, texts):
    import zlib

    from notewright.llm import toxicity as X

    got = rows(spark, "op8_toxicity")
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    want = brute_scores(X.fit_toxicity(read("documents"), read("labels")), texts)
    assert set(got) == set(texts)
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert r.score == pytest.approx(want[doc], abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_token_counts(spark, texts):
    import public_tokenizers as P
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = rows(spark, "op11_token_counts")
    assert set(got) == set(texts)
    for doc, text in texts.items():
        n = len(model.encode(text))
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len(text.encode()), n, n > 4096)


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_ranked_search"])
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_merkle_manifest(spark):
    from test_merkle import COLUMNS, brute, even

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = __spark_entry__.queries()["op12_merkle_manifest"](spark, SF).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs, 3, even), key=str)


def test_ranked_search(spark, texts):
    from test_impact_index import brute

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = __spark_entry__.queries()["op13_ranked_search"](spark, SF).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(list(texts.items()), items)
