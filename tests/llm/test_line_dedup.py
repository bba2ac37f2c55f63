import hashlib
import random
import re

import pytest

from notewright.llm.line_dedup import dedup_lines


def brute(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m.group().lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(doc if doc is not None else -(2**63))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        did = doc if doc is not None else -(2**63)
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == did]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(df).collect()), key=str)


def test_edges(make, edge):
    assert run(make(edge)) == brute(edge)


def test_random(make):
    rng = random.Random(5)
    pool = ["A shared line of enough letters %d" % i for i in range(8)] + ["short", "", "\tPadded shared line of enough letters  "]
    rows = [(i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    assert run(make(rows)) == brute(rows)


def test_repeated_rows_and_empty_table(make):
    rows = [(1, "one line that is long enough to count")] * 3 + [(2, "one line that is long enough to count"), (3, "one line that is long enough to count")]
    assert run(make(rows)) == brute(rows)
    assert run(make([])) == []


def test_native_plan(make, edge):
    plan = dedup_lines(make(edge))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query_digest(spark):
    import __spark_entry__

    row = __spark_entry__.queries()["op1_line_dedup"](spark, "/root/testdata/sf0.001").first()
    assert len(row.kept_sha256) == len(hashlib.sha256().hexdigest())


if __name__ == "__main__":
    pytest.main([__file__])
