import random
import re
from collections import Counter

import numpy as np
import pytest

from notewright.llm import near_dedup as N
from notewright.llm.graph import components


def shingles(text, size=5):
    words = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return Counter()
    size = min(size, len(words))
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            shared = sum((a & b).values())
            both = sum(a.values()) + sum(b.values()) - shared
            if (rows[i][1] or "") == (rows[j][1] or "") or (both and shared / both >= threshold):
                parent[root(i)] = root(j)
    ids = [r[0] if r[0] is not None else -(2**63) for r in rows]
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    real = lambda x: None if x == -(2**63) else x
    return {real(ids[i]): real(least[root(i)]) for i in range(len(rows))}


def run(df):
    return {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}


def test_random_copies(make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for c in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 100 + c, " ".join(text)))
    rng.shuffle(rows)
    assert run(make(rows)) == brute(rows)


def test_edges(make, edge):
    rows = [*edge, (30, ""), (31, "Short!"), (32, "!!! ..."), (33, "... !!!")]
    assert run(make(rows)) == brute(rows)
    assert run(make([])) == {}
    kept = [r.kept for r in N.near_duplicates(make([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")])).orderBy("doc_id").collect()]
    assert kept == [True, True, True, False]


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    parts = rng.integers(0, 2**63, 400).astype(np.uint64)
    one, two = rng.random(400) * 3, rng.random(400) * 3
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    k = 2000
    same = (N.dart_signature(parts, one, k) == N.dart_signature(parts, two, k)).mean()
    assert abs(same - true) < 4 * (true * (1 - true) / k) ** 0.5
    assert not (N.dart_signature(parts[:1], None, 100) == N.EMPTY).any()


def test_lists_and_shingles_are_weighted():
    """The similarity of two texts' lists is that of their shingles weighted by occurrence."""
    rng = random.Random(2)
    for letters in ("ab", "abcdefghijkl"):
        for _ in range(40):
            texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2)]
            found = [N.weighted_shingles(t, 3) for t in texts]
            lists = [np.repeat((x >> np.uint64(32)).astype("<u4"), w).tobytes() for x, w in found]
            one, two = (shingles(t, 3) for t in texts)
            assert [sorted(w) for _, w in found] == [sorted(one.values()), sorted(two.values())]
            union = sum((one | two).values())
            assert N.weighted_jaccard(*lists) == pytest.approx(sum((one & two).values()) / union if one and two else 0)


def test_bits_of_similar_sets_differ_little():
    """Sets of similarity 0.8 stay within the bound, those well below it do not."""
    rng = np.random.default_rng(4)
    most = N.most_different_bits(0.8, 1200)
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))
    for shared, total, inside in ((800, 1000, True), (650, 1000, False)):
        for _ in range(20):
            both = rng.integers(0, 2**63, total).astype(np.uint64)
            one, two = both[: (total + shared) // 2], np.concatenate([both[:shared], both[(total + shared) // 2 :]])
            bits = [N.signature_bits(N.dart_signature(x, None, 1200)) for x in (one, two)]
            assert len(bits[0]) == 38 and (differ(*bits) <= most) == inside


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole = N.word_hashes(text)
    monkeypatch.setattr(N, "PIECE", 100)
    assert (N.word_hashes(text) == whole).all() and len(whole) == 3000


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (None, 3)]])
def test_components(spark, links):
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for link in links if None not in link for x in link}
    for _ in parent:
        for a, b in links:
            if a is not None and b is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_bridge_in_a_group_of_copies(make):
    """In each group some hundred copies, one edited member (id 900) and an outlier (999), whose only
    link is to that member, while copies lead the buckets in which the two meet."""
    rng = random.Random(5)

    def edited(text, places, tag):
        out = list(text)
        for i in places:
            out[i] = f"{tag}{i}"
        return out

    rows = []
    for g in range(4):
        core = [f"g{g}w{rng.randrange(10**6)}" for _ in range(1004)]
        bridge = edited(core, [500], "b")
        outlier = edited(bridge, [10 + 20 * i for i in range(22)], "c")
        texts = {0: core, 900: bridge, 999: outlier} | {i: edited(core, [rng.randrange(510, 1000)], f"x{i}y") for i in range(1, 151)}
        rows += [(1000 * g + i, " ".join(t)) for i, t in texts.items()]
        near = {i: brute([(0, " ".join(t)), (1, " ".join(outlier))])[1] == 0 for i, t in texts.items()}
        assert [i for i in near if near[i]] == [900, 999]
    rng.shuffle(rows)
    assert run(make(rows)) == {d: d // 1000 * 1000 for d, _ in rows}


def test_texts_that_share_an_identifier(spark, make):
    """Texts under one identifier, or none, are judged apart."""
    import corpus_pipeline

    one, two, three = (" ".join(f"{t}{i}" for i in range(120)) for t in "abc")
    rows = [(3, one), (7, one + " more"), (7, two), (9, two + " more"), (None, three), (None, three + " more"), (None, "alone")]
    docs = make(rows + rows[4:5])
    got = N.near_duplicates(docs).join(docs.selectExpr("text", "xxhash64(text) AS text_hash").distinct(), "text_hash").collect()
    assert {(r.doc_id, r.text): r.class_id for r in got} == dict(zip(rows, [3, 3, 7, 7, None, None, None], strict=True))
    kept = [(r.doc_id, r.text) for r in got if r.kept]
    assert set(kept) >= {rows[0], rows[2], rows[6]} and len({t for _, t in kept if t.startswith(three)}) == 1 and len(set(kept)) == 4
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == set(kept)


def test_heavy_elements_take_bounded_memory():
    """A text of six words said two million times over: cells are counted, not elements."""
    import tracemalloc

    parts = np.arange(6, dtype=np.uint64) + np.uint64(99)
    weights = np.full(6, 350_000)
    tracemalloc.start()
    heavy = N.dart_signature(parts, weights, 100)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert len(heavy) == 100 and (heavy != N.EMPTY).all()
    light = N.dart_signature(parts, np.full(6, 7.5), 100)
    assert light.tolist() == N.dart_signature(parts, np.full(6, 7.5), 100).tolist() and light.tolist() != heavy.tolist()


def test_the_exact_setting_compares_every_pair(make):
    """Without the signatures' filter the classes are the same, and those of brute force."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(80), rng.randrange(0, 6)):
            words[at] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    for errors in (None, 4.5):
        out = N.near_duplicates(make(rows), steep_bands=8, steep_rows=2, errors=errors)
        assert {r.doc_id: r.class_id for r in out.collect()} == want


def test_joins_leave_the_driver_alone(spark, capsys):
    """No side of a join goes to the driver, however small, and small tables take few tasks."""
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "band long, did long")
    lists = spark.createDataFrame([(1, bytearray(b"abcd")), (2, bytearray(b"abcd"))], "did long, parts binary")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    N._meeting(members).explain()
    N._similarities(pairs, lists, 2).explain()
    plans = capsys.readouterr().out
    assert plans.count("SortMergeJoin") == 3 and "Broadcast" not in plans
    labels = components(pairs.repartition(9), 2)
    assert labels.rdd.getNumPartitions() <= 2 and {tuple(r) for r in labels.collect()} == {(1, 1), (2, 1)}
