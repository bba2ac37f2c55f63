import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notewright.llm import impact_index as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc, c in found:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def ranked(out):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("term", F.lit("clash"))


def test_sliced_arithmetic():
    rng = random.Random(4)
    size = 300
    numbers = lambda top: [rng.randrange(top) if rng.random() < 0.6 else 0 for _ in range(size)]
    slices = lambda values: [sum((v >> b & 1) << i for i, v in enumerate(values)) for b in range(max(values).bit_length())]
    back = lambda s: [X.value(s, i) for i in range(size)]
    for _ in range(20):
        a, b, w = numbers(1 << rng.randint(1, 30)), numbers(1 << rng.randint(1, 30)), rng.randrange(1 << 14)
        assert back(X.added(slices(a), slices(b))) == [x + y for x, y in zip(a, b, strict=True)]
        assert back(X.times(slices(a), w)) == [x * w for x in a]
        for k in (1, 3, 10, 299, 400):
            small = [x % 6 for x in a]
            want = sorted((-v, i) for i, v in enumerate(small) if v)[:k]
            assert sorted((-small[i], i) for i in X.best(slices(small), k)) == want


def test_postings_read_back(spark, make):
    rows = [(i, f"alpha {'beta ' * (i % 3)} gamma{i % 2}") for i in range(40)]
    docs = make(rows)
    corpus = X.corpus_counts(docs)
    index = X.build_index(docs, corpus).collect()
    assert sum(r.df for r in index if r.kind == 0) == 40
    assert sum(r.df for r in index if r.term == "beta") == sum(i % 3 > 0 for i, _ in rows)


@pytest.mark.parametrize("partitions", [1, 6])
def test_against_brute_force(spark, make, partitions, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(0, 80)))) for i in range(400)]
    docs += [(1000 + i, "W5 w7, w9") for i in range(30)]  # ties beyond the limit
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(99, "unknown words"), (98, ""), (97, None), (5, "W59! extra w3")]
    got = X.ranked_search(make(docs).repartition(partitions), items_of(spark, items))
    assert ranked(got) == brute(docs, items)


def test_blocks_and_parts_do_not_show(spark, make, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 30)))) for i in range(200)]
    items = [(i, " ".join(rng.choices("abcdefgh", k=3))) for i in range(20)]
    monkeypatch.setattr(X, "ITEMS_AT_ONCE", 3)
    assert ranked(X.ranked_search(make(docs), items_of(spark, items), k=4)) == brute(docs, items, 4)
    block = X.Block()
    for doc, text in docs:
        block.add(doc, text.encode())
    monkeypatch.setattr(X, "BLOCK_POSTINGS", 50)
    assert block.full()


def test_edges(spark, make, edge):
    """Nulls, empty and very long texts, repeated rows, letters of other scripts, a null item."""
    docs = [*edge, edge[3], edge[3], (20, "ÀÉ àé STRASSE straße"), (21, "x1 " * 200_000), (22, "漢" * 100_000)]
    items = [(1, "same text here, TWICE!"), (2, "àé strasse Straße"), (3, "x1 line"), (None, "漢 identifier words"), (4, "é漢🎵"), (5, "...")]
    assert ranked(X.ranked_search(make(docs), items_of(spark, items))) == brute(docs, items)
    assert ranked(X.ranked_search(make([]), items_of(spark, items))) == []
    assert ranked(X.ranked_search(make(edge), items_of(spark, []))) == []
    assert ranked(X.ranked_search(make([(1, None), (2, " ")]), items_of(spark, items))) == []
