import re

import pytest

import corpus_pipeline as C
from notewright.llm import toxicity
from notewright.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input."""
    docs = read(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert stages["byte_bpe"].count() == stages["mixing"].count() > 0


def test_each_stage_judges_its_own_input(spark, stages):
    docs = stages["documents"]
    from test_near_dedup import brute
    from test_queries import brute_scores

    model = toxicity.fit_toxicity(docs, read(spark, SF, "labels"))
    scores = brute_scores(model, {r.doc_id: r.text or "" for r in docs.collect()})
    assert {r.doc_id for r in stages["toxicity"].collect()} == {d for d, s in scores.items() if s < 0.5}

    before = {r.doc_id: r.text for r in stages["toxicity"].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in stages["line_dedup"].collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = {}
    for d, t in before.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(d)
    for d, t in before.items():
        text = "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d)
        assert after[d] == (text, len(text))

    classes = brute([(d, t) for d, (t, _) in after.items()])
    assert {r.doc_id for r in stages["near_dedup"].collect()} == set(classes.values())
    mixed = [r.doc_id for r in stages["mixing"].orderBy("doc_id").collect()]
    assert mixed == sorted(set(classes.values()))


def test_mixing_and_encoding_by_brute_force(spark, stages):
    """Blocks follow the schedule filled slot by slot; ids are those of the library."""
    import hashlib
    from collections import Counter

    import numpy as np
    import public_tokenizers as P
    import tiktoken
    from test_mixing import brute

    from notewright.llm.bpe import Codec

    docs = stages["near_dedup"]
    counts = Counter(r.source for r in docs.collect())
    want = brute(counts, 8, 0.7)
    order = sorted(want, key=lambda b: want[b][0])
    sources = [s for s, j in order for _ in range(min(8, counts[s] - 8 * j))]
    assert [r.source for r in C.mix_to_weights(spark, docs, SF).collect()] == sources
    ranks = Codec.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).ranks
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in stages["mixing"].collect()}
    for r in stages["byte_bpe"].collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_equals_stages(spark, stages):
    got = {(r.doc_id, r.ids_sha256) for r in C.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in stages["byte_bpe"].collect()}


def test_oracles(spark):
    import duckdb

    import __spark_entry__

    names = [n for n in __spark_entry__.oracle_sql() if re.match(r"op\d+_", n)]
    assert {"op1_line_dedup", "op5_exact_dedup", "op9_chat_format"} <= set(names)
    for table in ("documents", "conversations", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name in names:
        got = __spark_entry__.queries()[name](spark, SF)
        want = duckdb.sql(__spark_entry__.oracle_sql()[name])
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        rows = want.project(", ".join(order)).fetchall()
        assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(rows, key=str), name


def test_stages_take_edge_cases(spark, make, edge):
    """Nulls in any column, empty and long texts, repeated rows, no rows, clashing names."""
    from pyspark.sql import functions as F

    rows = [*edge, edge[3], (4, None)]
    docs = make(rows).withColumn("gone", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even"))
    for table in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, table, SF)
            if name != "byte_bpe":
                assert out.columns == table.columns
            if name in ("line_dedup", "byte_bpe"):
                assert out.count() == table.count()
    kept = {r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == {d for d, _ in edge} - {2, 5}  # the empty text again, and a copy


def test_mixing_keeps_every_row(spark):
    """A tiny source and a null one neither end the mix nor lose rows; rows come in its order."""
    counts = {"hot": 3000, "warm": 400, "tiny": 5, None: 3}
    data = [(i, f"text {i}", s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(7)
    got = [r.doc_id for r in C.mix_to_weights(spark, docs, SF).collect()]
    order = C.mix_order(docs).collect()
    assert len(got) == len(order) == sum(counts.values())
    assert got == [r.doc_id for r in sorted(order, key=lambda r: r.position)]


def test_near_duplicates_leave_without_the_driver(spark, make, edge):
    """The rows that go grow with the input: however few they are, they aren't broadcast."""
    out = C.drop_near_duplicates(spark, make(edge), SF)
    assert {r.doc_id for r in out.collect()} == {d for d, _ in edge} - {2, 5}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
