import random

import pytest

from notewright.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    key = lambda r: (r[0] if r[0] is not None else -(2**63))
    for doc, text in sorted(rows, key=key):
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            string = data[s : s + length]
            if string in seen:
                gone[s : s + length] = [True] * length
            seen.add(string)
        spans = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else False) != (gone[i - 1] if i else False)]
        out[doc] = (len(data), list(zip(spans[::2], spans[1::2], strict=True)), bytes(c for c, g in zip(data, gone, strict=True) if not g))
    return out


def run(df, length):
    return {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in S.suffix_dedup(df, length=length).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_edits(make, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(30, 300))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(base)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 3)))
        chars = list(text)
        for _ in range(rng.randint(0, 6)):
            if chars:
                chars[rng.randrange(len(chars))] = rng.choice("abcdxyz")
        rows.append((i, "".join(chars)))
    assert run(make(rows), 24) == brute(rows, 24)


def test_edges(make, edge):
    assert run(make(edge), 100) == brute(edge, 100)
    assert run(make(edge), 16) == brute(edge, 16)
    assert run(make([]), 100) == {}


def test_periodic_and_chunked(make, monkeypatch):
    rows = [(1, "ab" * 400), (2, "abc" * 300), (3, "b" + "ab" * 100 + "x" + "abc" * 60)]
    assert run(make(rows), 100) == brute(rows, 100)
    text = "".join(random.Random(9).choices("abcdefg", k=900)).encode()
    whole = S.super_windows(text, 100)
    monkeypatch.setattr(S, "CHUNK", 128)
    cut = S.super_windows(text, 100)
    starts = lambda r: [s for a, m in zip(r["start"].tolist(), r["more"].tolist(), strict=True) for s in range(a, a + m + 1)]
    assert starts(whole) == starts(cut) == list(range(801))
    assert set((whole["start"] + whole["anchor"]).tolist()) == set((cut["start"] + cut["anchor"]).tolist())


def test_repeated_rows_are_one_document(make):
    text = "".join(random.Random(7).choices("abcdefgh ", k=200))
    rows = S.suffix_dedup(make([(1, text)] * 3 + [(2, text)]), length=100).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in rows) == [(1, 200)] * 3 + [(2, 0)]


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(8)
    for n in (1, 2, 3, 5, 8):
        runs, every = [], []
        for r in range(n):
            run_ = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"l", r, 0, i) for i in range(rng.randint(0, 30)))
            every += [e[0] for e in run_]
            runs.append(S.decoded_run(S.front_coded(run_)))
        merged = list(S.LoserTree(runs))
        assert [m[1] for m in merged] == sorted(every)
        for before, after in zip(merged, merged[1:], strict=False):
            assert after[0] == S.common_prefix(before[1], after[1])
