import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import winnow as W


def brute(text, k, w):
    if not text:
        return [], []
    k = min(k, len(text))
    grams = (W.rolling(W.code_points(text), k) >> np.uint64(32)).tolist()
    picked = []
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s : s + w]
        at = s + max(i for i, g in enumerate(window) if g == min(window))
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked, [grams[i] for i in picked]


def test_winnow_matches_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abé漢") for _ in range(rng.randint(0, 200)))
        at, hashes = W.winnow(W.code_points(text), 5, 8)
        assert (at.tolist(), hashes.tolist()) == brute(text, 5, 8)


def test_chunks_do_not_show(monkeypatch):
    text = "".join(random.Random(2).choices("abcdef ", k=5000))
    whole = W.winnow(W.code_points(text), 20, 40)
    monkeypatch.setattr(W, "CHUNK", 300)
    parts = W.winnow(W.code_points(text), 20, 40)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_shared_passage_is_found():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for _ in range(50):
        shared = word(20 + 40 - 1)
        a, b = word(100) + shared + word(70), word(33) + shared + word(90)
        assert set(W.winnow(W.code_points(a), 20, 40)[1]) & set(W.winnow(W.code_points(b), 20, 40)[1])


def edited(rows):
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_operator(make, edge):
    rows = W.fingerprint_edits(make(edge)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == edited(edge)
    by = {r.doc_id: r for r in rows}
    assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    at, hashes = W.decode(by[6].fingerprint)
    assert W.encode(at, hashes) == by[6].fingerprint
    assert W.fingerprint_documents(make(edge)).count() == len(edge)


def test_many_documents_one_document_none(make):
    rng = random.Random(4)
    rows = [(i * 7 % 501, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))) for i in range(300)]
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in W.fingerprint_edits(make(rows)).collect()}
    assert got == edited(rows)
    assert [r.edited_sha256 for r in W.fingerprint_edits(make([(1, "abcd")])).collect()] == [hashlib.sha256(b"abab").hexdigest()]
    assert W.fingerprint_edits(make([])).count() == 0
    assert W.fingerprint_edits(make([(1, "abcd")] * 4)).count() == 4


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 10, 50])
def test_buckets_count_the_bounds_above(spark, n):
    bounds = [3 * i for i in range(n, 0, -1)]
    rows = spark.range(0, 3 * n + 5).select("id", W._bucket(F.col("id"), bounds).alias("bucket")).collect()
    assert all(r.bucket == sum(b > r.id for b in bounds) for r in rows)
