import hashlib
import random

import numpy as np
import pytest

from notewright.llm import exact_dedup as E


def brute(rows, keep):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc if doc is not None else -(2**63))
    pick = max if keep == "max" else min
    real = lambda x: None if x == -(2**63) else x
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        did = doc if doc is not None else -(2**63)
        out.append((doc, real(pick(ids)), len(ids), did == pick(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in E.exact_dedup(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_edges(make, edge, keep):
    rows = [*edge, edge[3], (4, "another text under the same identifier")]
    assert run(make(rows), keep=keep) == brute(rows, keep)
    assert run(make([])) == []


@pytest.mark.parametrize("partitions,fan_bits", [(1, 3), (8, 1), (53, 3), (20, 2)])
def test_rounds(spark, make, partitions, fan_bits):
    rng = random.Random(partitions)
    rows = [(i, f"text {rng.randint(0, 150)}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run(make(rows), fan_bits=fan_bits) == brute(rows, "max")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_digests_of_different_texts_fail():
    records = np.zeros(2, E.RECORD)
    records["size"] = [1, 2]
    with pytest.raises(ValueError):
        E.combine(records, "max")
