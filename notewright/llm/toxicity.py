"""Toxicity scores from a learned lexicon with Levenshtein automata.

Words and word beginnings that mark toxic labels become a trie. Each word of a text is compiled to
a Levenshtein automaton that walks the trie, so misspelled terms are caught in one descent.
Each hit is weighed by its context window: quotation marks and words of reporting make it count
less, the second person makes it count more."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import by_bytes, col, cut, held, let_go, text_of
from notewright.llm.near_dedup import weighted_shingles

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(3, 8)
#: Characters on either side of a hit that make its context window.
WINDOW = 60
#: Factors of a hit in quotation marks, near a word of reporting, near the second person.
QUOTED, REPORTED, ADDRESSED = 0.3, 0.5, 1.5
REPORTING = frozenset("said says wrote writes quote quoted quotes called dijo dice sagte sagt dit écrit".split())
SECOND_PERSON = frozenset("you your yours du dich dein tu te vous usted tus".split())
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
#: Words whose match each worker remembers.
REMEMBERED = 200_000


def edits_allowed(term: str) -> int:
    """Spelling errors that a term tolerates: none in short ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Node:
    """A trie node; most: errors that some term below it tolerates."""

    next: dict[str, Node] = field(default_factory=dict)
    number: int = 0
    most: int = 0
    word: str | None = None
    beginning: str | None = None


def trie(words: Iterable[str], beginnings: Iterable[str] = ()) -> Node:
    root, made = Node(), 1
    for kind, terms in (("word", words), ("beginning", beginnings)):
        for term in terms:
            node, most = root, edits_allowed(term) if kind == "word" else 0
            for c in term:
                node.most = max(node.most, most)
                if c not in node.next:
                    node.next[c] = Node(number=made)
                    made += 1
                node = node.next[c]
            node.most = max(node.most, most)
            setattr(node, kind, term)
    return root


class Automaton:
    """The Levenshtein automaton of a trie's terms, made deterministic as it is used.

    A state holds, for each trie node that the letters read so far may have led to, the fewest
    errors on the way; nodes below which no term tolerates that many are left out. A beginning that
    was read without errors stays. Transitions are remembered, up to a bound on states, so most
    words take a few lookups."""

    LIMIT = 100_000

    def __init__(self, root: Node) -> None:
        self.root = root
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.members: list[tuple[dict[int, tuple[Node, int]], str | None]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, bool, int] | None] = []
        self.start = self._state({0: (self.root, 0)}, None)

    def _close(self, nodes: dict[int, tuple[Node, int]]) -> dict[int, tuple[Node, int]]:
        """Adds what leaving out letters of terms reaches."""
        stack = list(nodes.values())
        while stack:
            node, errors = stack.pop()
            for below in node.next.values():
                if errors + 1 <= below.most and (below.number not in nodes or nodes[below.number][1] > errors + 1):
                    nodes[below.number] = (below, errors + 1)
                    stack.append((below, errors + 1))
        return nodes

    def _state(self, nodes: dict[int, tuple[Node, int]], held: str | None) -> int:
        nodes = self._close(nodes)
        key = (held, *sorted((n, e) for n, (_, e) in nodes.items()))
        if key in self.ids:
            return self.ids[key]
        ends = [(e, False, n.word) for n, e in nodes.values() if n.word is not None and e <= edits_allowed(n.word)]
        best = min([*ends, *([(0, True, held)] if held else [])], default=None)
        self.ids[key] = len(self.members)
        self.members.append((nodes, held))
        self.moves.append({})
        self.found.append((best[2], best[1], best[0]) if best else None)
        return self.ids[key]

    def _move(self, state: int, letter: str) -> int:
        nodes, held = self.members[state]
        after: dict[int, tuple[Node, int]] = {}

        def reach(node: Node, errors: int) -> None:
            if errors <= node.most and (node.number not in after or after[node.number][1] > errors):
                after[node.number] = (node, errors)

        for node, errors in nodes.values():
            reach(node, errors + 1)  # the word has a letter more
            for c, below in node.next.items():
                reach(below, errors if c == letter else errors + 1)
                if c == letter and errors == 0 and below.beginning is not None and held is None:
                    held = below.beginning
        return self._state(after, held) if after or held else -1

    def match(self, word: str) -> tuple[str, bool, int] | None:
        """The closest term: (term, whether it is a beginning, errors), or None. Ties go to fewer
        errors, whole words, then the smaller term."""
        if len(self.members) > self.LIMIT:
            self._clear()
        state = self.start
        for c in word:
            moves = self.moves[state]
            after = moves.get(c)
            if after is None:
                after = moves[c] = self._move(state, c)
            if after < 0:
                return None
            state = after
        return self.found[state]


@dataclass
class Model:
    """A fitted scorer. words and beginnings: term to weight (0 to 1); clean: words that resemble a
    term but occur in clean texts; bias and slopes: of the logistic score."""

    words: dict[str, float]
    beginnings: dict[str, float]
    clean: frozenset[str]
    bias: float = -4.0
    slopes: tuple[float, ...] = (4.0, 0.0, 0.0)


class Scorer:
    """Applies a model; remembers the matches of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.automaton = Automaton(trie(model.words, model.beginnings))
        self.known: dict[str, tuple[float, str] | None] = {}

    def lookup(self, word: str) -> tuple[float, str] | None:
        """(weight, term) of the word's hit, or None."""
        try:
            return self.known[word]
        except KeyError:
            pass
        found = None if word in self.model.clean else self.automaton.match(word)
        hit = None
        if found:
            term, beginning, errors = found
            weight = (self.model.beginnings if beginning else self.model.words)[term]
            hit = (weight / (1 + errors), term)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = hit
        return hit

    def features(self, text: str) -> tuple[float, float, float]:
        """Logs of the weight of hits in their contexts, of distinct terms, and of the weight of
        hits per 200 words."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift the positions
            text = low
        words = WORD.findall(low)
        hits = {w for w in set(words) if self.lookup(w)}
        if not hits:
            return 0.0, 0.0, 0.0
        total, terms = 0.0, set()
        for m in WORD.finditer(low):
            if m.group() in hits:
                weight, term = self.lookup(m.group())
                total += weight * context(text, m.start(), m.end())
                terms.add(term)
        return math.log1p(total), math.log1p(len(terms)), math.log1p(200 * total / (len(words) + 50))

    def score(self, text: str) -> float:
        z = self.model.bias + sum(a * x for a, x in zip(self.model.slopes, self.features(text), strict=True))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def context(text: str, start: int, end: int) -> float:
    """The factor of a hit: below 1 for quotation, above for abuse of a person addressed."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    factor = 1.0
    for opening, closing in QUOTES.items():
        inside = before.count(opening) % 2 == 1 if opening == closing else before.rfind(opening) > before.rfind(closing)
        if inside and closing in after:
            factor = QUOTED
    near = set(WORD.findall(before.lower())) | set(WORD.findall(after.lower()))
    if near & REPORTING:
        factor *= REPORTED
    elif factor == 1.0 and near & SECOND_PERSON:
        factor = ADDRESSED
    return factor


def held_out(id_column: Column) -> Column:
    """Rows never learned from: crc32 of the identifier as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _weighed(train: DataFrame) -> DataFrame:
    """Adds weight: rows whose least shingle hash is the same, which copies and near copies share,
    weigh one together, so that a group of copies doesn't make terms of its rare words. train is
    bounded, and so is the table of its groups."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = [weighted_shingles(t, 3)[0] for t in batch.column(0).to_pylist()]
            sketch = pa.array([int(x.min().view(np.int64)) if len(x) else 0 for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sketch], names=["text", "toxic", "least"])

    train = cut(by_bytes(train).mapInArrow(least, "text string, toxic int, least long"))
    sizes = train.groupBy("least").agg((1.0 / F.count("*")).alias("weight"))
    return train.join(F.broadcast(sizes), "least").select("text", "toxic", "weight")


def _counts(train: DataFrame) -> DataFrame:
    """(term, beginning, toxic, clean): weight of the documents of either label that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts: dict[tuple[str, bool], list[float]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([v[0] for v in values], pa.float64()),
                    pa.array([v[1] for v in values], pa.float64()),
                ],
                names=["term", "beginning", "toxic", "clean"],
            )

        for batch in batches:
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = set(WORD.findall(text.lower()))
                terms = {(w, False) for w in words}
                terms.update((w[:n], True) for w in words for n in BEGINNINGS if len(w) > n)
                for term in terms:
                    counts.setdefault(term, [0.0, 0.0])[0 if toxic else 1] += weight
                if len(counts) > 200_000:
                    yield flush()
        if counts:
            yield flush()

    rows = by_bytes(train.select("text", "toxic", "weight")).mapInArrow(run, "term string, beginning boolean, toxic double, clean double")
    # Rounded, as the order in which parts are summed must not decide between terms.
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    return rows.groupBy("term", "beginning").agg(total("toxic"), total("clean"))


def _evidence(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> Column:
    """Log-likelihood ratio (G squared) of a term that is commoner in toxic texts, else 0."""
    share = n_toxic / (n_toxic + n_clean)
    n = toxic + clean
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))
    return F.when(toxic > n * share, g).otherwise(0.0)


def _lexicon(found: list[tuple[str, bool, float, float, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings from (term, whether a beginning, toxic weight, log odds, their error).

    Of nested beginnings the one whose odds are surest stays; one that a single word accounts for
    goes, and so do words that a beginning covers. Weights are odds over the largest."""
    top = max((odds for *_, odds, _ in found), default=1.0)
    most: dict[str, float] = {}  # toxic weight of the commonest word with each beginning
    for term, beginning, toxic, _, _ in found:
        if not beginning:
            for i in BEGINNINGS:
                most[term[:i]] = max(most.get(term[:i], 0), toxic)
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for term, beginning, toxic, odds, _ in sorted(found, key=lambda f: (2 * f[4] - f[3], -len(f[0]), f[0])):
        if beginning and toxic >= 1.5 * most.get(term, 0):
            if not any(term.startswith(b) or b.startswith(term) for b in beginnings):
                beginnings[term] = odds / top
    for term, beginning, _, odds, _ in found:
        if not beginning and not any(term.startswith(b) for b in beginnings):
            words[term] = odds / top
    return words, beginnings


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
) -> Model:
    """Learns from at most max_rows labelled rows that are not held out (those whose identifiers
    hash lowest): the one bound, from which all that follows is counted in whole. The lexicon's terms,
    the clean words that resemble one and the training rows' three features each come to the driver.

    Null labels and null identifiers are not learned from; a document labelled twice is toxic if
    any label says so; of several texts under one identifier one is learned from, that of the least hash,
    so rows are bounded as identifiers are. Without labels of both kinds the model has no terms and
    scores all texts low.
    """
    picked = (
        labels.where(col(id_col).isNotNull() & col(label_col).isNotNull() & ~held_out(col(id_col)))
        .groupBy(col(id_col).cast("long").alias("did"))
        .agg(F.max(col(label_col).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("did"), "did")
        .limit(max_rows)
    )
    texts = docs.select(col(id_col).cast("long").alias("did"), text_of(text_col).alias("text"))
    # picked has max_rows rows at most.
    known = texts.join(F.broadcast(picked), "did").groupBy("did", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    train = cut(_weighed(known.select("text", "toxic")))
    n = {bool(r["toxic"]): r["n"] for r in train.groupBy("toxic").agg(F.round(F.sum("weight"), 6).alias("n")).collect()}
    if len(n) < 2:
        return Model({}, {}, frozenset())
    counts = cut(_counts(train))
    # A term must be rarer than chance would make any of all terms.
    least = 2 * math.log(5 * sum(n.values()))
    scored = counts.withColumn("g", _evidence(F.col("toxic"), F.col("clean"), n[True], n[False]))
    odds = F.log(((F.col("toxic") + 0.5) / n[True]) / ((F.col("clean") + 0.5) / n[False]))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = (
        scored.withColumns({"odds": odds, "error": error})
        .where((F.col("g") >= least) & (F.col("odds") >= 2))
        .collect()
    )
    words, beginnings = _lexicon(sorted((r["term"], r["beginning"], r["toxic"], r["odds"], r["error"]) for r in found))

    def resembles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(trie(words))
        for batch in batches:
            near = [w not in words and automaton.match(w) is not None for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    clean = (
        counts.where(~F.col("beginning") & (F.col("clean") > 0))
        .select("term", "clean")
        .mapInArrow(resembles, "term string, clean double")
        .collect()
    )
    model = Model(words, beginnings, frozenset(r["term"] for r in clean))
    examples = train.mapInArrow(_feature_rows(model), "x0 double, x1 double, x2 double, toxic int").toPandas()
    model.bias, model.slopes = _logistic(examples[["x0", "x1", "x2"]].to_numpy(), examples["toxic"].to_numpy())
    return model


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)] + [batch.column(1)], names=["x0", "x1", "x2", "toxic"]
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, tuple[float, ...]]:
    """Ridge logistic regression by Newton steps; slopes below zero are left out."""
    order = np.lexsort((y, *x.T))  # sums do not depend on how the rows were dealt
    x, y = x[order], y[order].astype(float)
    use = np.ones(x.shape[1], bool)
    while True:
        design = np.column_stack([np.ones(len(x)), x[:, use]])
        ridge = np.diag([1e-6] + [penalty] * int(use.sum()))
        w = np.zeros(design.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            break
        use[np.flatnonzero(use)[w[1:] < 0]] = False
    slopes = np.zeros(x.shape[1])
    slopes[use] = w[1:]
    return float(w[0]), tuple(map(float, slopes))


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``row`` (a struct of the columns in carry, all by default) and
    ``score`` (0 to 1, higher: likelier toxic). Null text counts as empty and scores as a text
    without hits; nulls elsewhere and repeated rows pass through; an empty table gives an empty
    result. One pass, no shuffle; whole texts are read."""
    row = F.struct(*[col(c) for c in (carry or docs.columns)]).alias("row")
    source = docs.select(row, text_of(text_col).alias("text"))
    key = hash((tuple(sorted(model.words.items())), tuple(sorted(model.beginnings.items())), model.bias, model.slopes, tuple(sorted(model.clean))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", key), lambda: Scorer(model))
        for batch in batches:
            scores = pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["row", "score"])

    return by_bytes(source).mapInArrow(run, T.StructType([source.schema["row"], T.StructField("score", T.DoubleType())]))
