import random
import zlib

import pytest
from pyspark.sql import functions as F

from notewright.llm import toxicity as X


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = row[:]
        row[0] = i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_matches_distances():
    rng = random.Random(1)
    word = lambda low, high, letters="abc": "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    for _ in range(60):
        words, starts = {word(3, 10) for _ in range(6)}, {word(4, 4) for _ in range(2)}
        automaton = X.Automaton(X.trie(sorted(words), sorted(starts)))
        for _ in range(100):
            w = word(0, 11, "abcd")
            near = [(distance(w, t), False, t) for t in words if distance(w, t) <= X.edits_allowed(t)]
            near += [(0, True, b) for b in starts if w.startswith(b)]
            best = min(near, default=None)
            assert automaton.match(w) == ((best[2], best[1], best[0]) if best else None)


def test_context_separates_quotation():
    plain = X.context("he is a moron indeed", 8, 13)
    assert X.context('she read "a moron" aloud', 12, 17) < plain
    assert X.context("they said a moron came", 12, 17) < plain
    assert X.context("you are a moron friend", 10, 15) > plain


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    clean = [f"{a}{b}" for a in ("lo", "ma", "ti", "re", "so") for b in ("nd", "ster", "vin", "ka", "mel", "por")]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbler", "blockheads", "nitwit"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, "we met a gruumbler and a nitwitt today"), (1001, None), (1002, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    model = X.fit_toxicity(docs, labels)
    rows = X.score_documents(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    scores = {r.row.doc_id: r.score for r in rows}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((scores[d] >= 0.5) == bool(truth[d]) for d in held) / len(held) > 0.98
    assert scores[1000] >= 0.5 and scores[1001] == scores[1002] < 0.5
    assert all(0 <= s <= 1 for s in scores.values())


def test_held_out_labels_are_not_read(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit_toxicity(docs, flipped) == X.fit_toxicity(docs, labels)


def test_edges(spark, make, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit_toxicity(make(edge), none)
    rows = X.score_documents(make([*edge, edge[0]]), model).collect()
    assert len(rows) == len(edge) + 1 and all(r.score < 0.5 for r in rows)
    assert X.score_documents(make([]), model).count() == 0
    odd = spark.createDataFrame([(4, 1), (4, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert X.score_documents(make(edge), X.fit_toxicity(make(edge), odd)).count() == len(edge)


def brute_fit(rows):
    """The lexicon of (text, toxic) rows, from the definitions: weights of groups, evidence, odds."""
    import math
    from collections import Counter, defaultdict

    from notewright.llm.near_dedup import weighted_shingles

    least = [int(s.min().view("int64")) if len(s := weighted_shingles(t, 3)[0]) else 0 for t, _ in rows]
    group = Counter(least)
    weight = [1 / group[x] for x in least]
    n = [round(sum(w for w, (_, t) in zip(weight, rows, strict=True) if bool(t) == kind), 6) for kind in (True, False)]
    share = n[0] / (n[0] + n[1])
    held = defaultdict(lambda: [0.0, 0.0])
    for w, (text, toxic) in zip(weight, rows, strict=True):
        words = set(X.WORD.findall(text.lower()))
        for term in {(x, False) for x in words} | {(x[:i], True) for x in words for i in X.BEGINNINGS if len(x) > i}:
            held[term][0 if toxic else 1] += w
    found = []
    for (term, beginning), (a, b) in held.items():
        a, b = round(a, 6), round(b, 6)
        part = lambda o, e: o * math.log(o / e) if o > 0 else 0.0
        g = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share))) if a > (a + b) * share else 0.0
        odds = math.log(((a + 0.5) / n[0]) / ((b + 0.5) / n[1]))
        if g >= 2 * math.log(5 * sum(n)) and odds >= 2:
            found.append((term, beginning, a, odds, math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))))
    top = max(f[3] for f in found)
    starts = {}
    for term, beginning, a, odds, error in sorted(found, key=lambda f: (2 * f[4] - f[3], -len(f[0]), f[0])):
        alone = max((f[2] for f in found if not f[1] and f[0].startswith(term)), default=0.0)
        if beginning and a >= 1.5 * alone and not any(term.startswith(s) or s.startswith(term) for s in starts):
            starts[term] = odds / top
    words = {f[0]: f[3] / top for f in found if not f[1] and not any(f[0].startswith(s) for s in starts)}
    clean = set()
    for (term, beginning), (_, b) in held.items():
        if not beginning and b > 0 and term not in words and any(distance(term, w) <= X.edits_allowed(w) for w in words):
            clean.add(term)
    return words, starts, clean


def learned(docs, labels):
    truth = {}
    for r in labels.collect():
        if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.toxic)
    return [(r.text or "", truth[r.doc_id]) for r in docs.collect() if r.doc_id in truth]


def agrees(model, rows):
    words, starts, clean = brute_fit(rows)
    assert model.words == pytest.approx(words) and model.beginnings == pytest.approx(starts) and model.clean == clean
    assert words or starts
    # The score's bias and slopes: no step lowers the penalised loss.
    import numpy as np

    scorer = X.Scorer(model)
    x, y = np.array([scorer.features(t) for t, _ in rows]), np.array([t for _, t in rows], float)

    def loss(w):
        z = w[0] + x @ w[1:]
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * (1e-6 * w[0] ** 2 + 0.05 * np.sum(w[1:] ** 2))

    w = np.array([model.bias, *model.slopes])
    for i in range(4):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += step
            if i == 0 or moved[i] >= 0:
                assert loss(moved) >= loss(w) - 1e-9


def test_the_fit_is_that_of_brute_force(labelled):
    docs, labels = labelled
    agrees(X.fit_toxicity(docs, labels), learned(docs, labels))


def test_the_fit_over_a_whole_table(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    agrees(X.fit_toxicity(read("documents"), read("labels")), learned(read("documents"), read("labels")))


def test_rows_that_share_an_identifier_are_learned_from_once(spark, labelled):
    docs, labels = labelled
    copies = docs.where("doc_id = 5").crossJoin(spark.range(500)).drop("id")
    assert X.fit_toxicity(docs.union(copies), labels) == X.fit_toxicity(docs, labels)
