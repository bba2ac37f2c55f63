import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from notewright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(hashes, arity):
    """Levels of a tree, and of each position the siblings before and after, by level."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + arity]) for i in range(0, len(last), arity)])
    proofs = []
    for pos in range(len(hashes)):
        steps = []
        for level in levels[:-1]:
            first = pos - pos % arity
            run = level[first : first + arity]
            steps.append((run[: pos - first], run[pos - first + 1 :]))
            pos //= arity
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows, arity=3, tampers=lambda doc: False):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[name] = (own, *climb([leaf(r) for r in own], arity))
    if not names:
        return []
    root, above = climb([below[n][1] for n in names], arity)
    out = []
    for name, top in zip(names, above, strict=True):
        own, subroot, proofs = below[name]
        for row, proof in zip(own, proofs, strict=True):
            steps = proof + top
            shown = row[:4] + (row[4].replace("\n", "") if row[4] is not None else None,) if tampers(row[0]) else row
            h = leaf(shown)
            for before, after in steps:
                h = H(*before, h, *after)
            siblings = H(*[x for before, after in steps for x in before + after])
            out.append((row[0], leaf(row), subroot, root, siblings, h, h == root))
    return out


def even(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0


def seen():
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(got, want):
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_against_brute_force(spark, arity):
    rows = [(i * 7 % 211, f"s{min(i % 5, i % 3)}" if i % 11 else None, "en", 10 * i, f"text\n{i}\n") for i in range(200)]
    rows += [(500, "alone", None, None, None), (501, "pair", "é", 0, ""), (502, "pair", "é", 0, "x" * 5000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    check(merkle.dataset_manifest(docs, shown=seen(), arity=arity).collect(), brute(rows, arity, even))


def test_edges(spark):
    """Nulls in every column, a null identifier, repeated rows, empty and very long texts, extra columns."""
    rows = [(None, None, None, None, None), (None, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "other"), (2, "", "", 0, ""), (3, "-", "-", 1, "-")]
    rows += [(4, "n", "en", 5_000_000, "ab\n" * 1_700_000), (5, "é", "漢", -3, "🎵\n")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("tree", "pos", "leaf", "root", "path", "level", "kids", "run", "range")})
    check(merkle.dataset_manifest(docs, shown=seen()).collect(), brute(rows, 3, even))


def test_small_tables(spark):
    one = [(1, "a", "en", 1, "x")]
    check(merkle.dataset_manifest(spark.createDataFrame(one, SCHEMA)).collect(), brute(one))
    assert merkle.dataset_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_partitioning_does_not_matter(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"t{i}") for i in range(300)]
    roots = {merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA).repartition(n)).first()["root"] for n in (1, 5)}
    assert roots == {brute(rows)[0][3]}


def test_the_store_proves_again(spark, tmp_path):
    """The store on disk has a table a level; proofs of some leaves come from it alone."""
    rows = [(i, f"s{i % 2}", "en", i, f"t{i}") for i in range(60)]
    folder = str(tmp_path / "store")
    merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA), folder=folder).collect()
    store = merkle.Store(f"{folder}/sources", 2, 3)
    inner = [store.level(spark, 0).select(F.sum(F.size(F.get("levels", F.lit(i))))).first()[0] for i in range(3)]
    assert inner == [60, 20, 8] and [store.level(spark, k).count() for k in range(2)] == [4, 2]
    tops = merkle.roots(spark, store).collect()
    assert {r.tree: r.root.hex() for r in tops} == {f"ss{i}": brute([r for r in rows if r[1] == f"s{i}"])[0][2] for i in range(2)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 30, 81, 82, 84, 730, 731])
def test_sizes_about_the_edges_of_runs(spark, n):
    rows = [(i, "a", "en", i, f"t{i}") for i in range(n)] + [(n + i, f"b{i}", "en", 0, "x") for i in range(n % 31)]
    check(merkle.dataset_manifest(spark.createDataFrame(rows, SCHEMA), shown=seen()).collect(), brute(rows, 3, even))
