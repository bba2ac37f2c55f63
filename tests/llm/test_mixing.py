import heapq
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notewright.llm import mixing as M


def pfair_slots(weights, blocks):
    """The source of each slot, one slot after another, and the horizon: the first slot that falls to a
    source without a block left. What is left from there on follows by deadline."""
    total = sum(weights)
    coming, ready, placed, order = [(0, s) for s in range(len(weights))], [], [0] * len(weights), []
    due = lambda s: (-(-(placed[s] + 1) * total // weights[s]), s)
    while True:
        while coming and coming[0][0] <= len(order):
            heapq.heappush(ready, due(heapq.heappop(coming)[1]))
        s = heapq.heappop(ready)[1]
        if placed[s] == blocks[s]:
            break
        order.append(s)
        placed[s] += 1
        heapq.heappush(coming, (placed[s] * total // weights[s], s))
    horizon = len(order)
    while left := [due(s) for s in range(len(weights)) if placed[s] < blocks[s]]:
        order.append(min(left)[1])
        placed[order[-1]] += 1
    return order, horizon


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 1.0), min_size=1, max_size=25))
def test_schedule_keeps_every_window_and_lag(weights):
    """Every block within its window, and less than one block from the target throughout."""
    whole = M.whole_weights(weights)
    total = sum(whole)
    slots, horizon = pfair_slots(whole, [2000 * w // total + 1 for w in whole])
    placed = [0] * len(whole)
    for slot, source in enumerate(slots[:horizon]):
        j, w = placed[source], whole[source]
        assert j * total // w <= slot < -(-(j + 1) * total // w)
        placed[source] += 1
        assert all(abs(n * total - p * (slot + 1)) < total for n, p in zip(placed, whole, strict=True))
    assert horizon and Counter(slots) == Counter({i: 2000 * w // total + 1 for i, w in enumerate(whole)})


def test_deviation_from_the_target_does_not_grow():
    """Six sources weighted by count to the power of 0.7, over 200,000 slots."""
    counts = [2_000_000, 170_000, 90_000, 33_000, 5_000, 1_111]
    target = [n**0.7 / sum(m**0.7 for m in counts) for n in counts]
    slots, horizon = pfair_slots(M.whole_weights([n**0.7 for n in counts]), [200_000] * 6)
    placed, worst = [0] * 6, 0.0
    for slot, source in enumerate(slots[:200_000]):
        placed[source] += 1
        worst = max(worst, *(abs(n - w * (slot + 1)) for n, w in zip(placed, target, strict=True)))
    assert horizon >= 200_000 and worst < 1


def rows(spark, counts, seed=1):
    rng = random.Random(seed)
    data = [(rng.randrange(10**6), s) for s, n in counts.items() for _ in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "doc_id long, source string").repartition(5)


def brute(counts, block_rows, exponent):
    """Slot, release, deadline and in_mix of each source's blocks, by filling slots one at a time."""
    sources = sorted(counts, key=lambda s: (s is not None, s))
    whole = [max(1, round(counts[s] ** exponent * 10**6)) for s in sources]
    total = sum(whole)
    left = [-(-counts[s] // block_rows) for s in sources]
    placed, out, mixed = [0] * len(whole), {}, True
    while any(left):
        at = len(out)
        waiting = [i for i in range(len(whole)) if (placed[i] * total // whole[i] <= at if mixed else left[i])]
        due, i = min((-(-(placed[i] + 1) * total // whole[i]), i) for i in waiting)
        if not left[i]:
            mixed = False
            continue
        out[sources[i], placed[i]] = (at, placed[i] * total // whole[i], due, mixed)
        left[i] -= 1
        placed[i] += 1
    return out


@pytest.mark.parametrize("counts", [{"a": 1000, "b": 90, None: 37, "c": 8}, {"only": 70}, {"x": 3, "y": 3}, {"big": 5000, "small": 300}])
def test_matches_slot_by_slot(spark, counts):
    got = M.mix_sources(rows(spark, counts), block_rows=8).collect()
    want = brute(counts, 8, 0.7)
    assert len(got) == sum(counts.values())
    for r in got:
        assert want[r.source, r.block] == (r.slot, r.release, r.deadline, r.in_mix)
        assert r.position == r.slot * 8 + r.place
    assert len({r.position for r in got}) == len(got)
    slots = len({r.slot for r in got if r.in_mix})
    total = sum(n**0.7 for n in counts.values())
    for s, n in counts.items():
        assert abs(len({r.block for r in got if r.source == s and r.in_mix}) - slots * n**0.7 / total) < 1


@pytest.mark.parametrize("seed", range(6))
def test_chunks_make_the_one_schedule(spark, seed, monkeypatch):
    """Slots filled in chunks side by side are those filled one after another, whatever was supposed."""
    rng = random.Random(seed)
    k = rng.choice([1, 2, 5, 20])
    weights = [rng.choice([1, 7, 10**3, 10**6, 10**9, rng.randrange(1, 10**7)]) for _ in range(k)]
    if seed % 2:
        monkeypatch.setattr(M, "WARM", 0)
        monkeypatch.setattr(M, "CHUNK", 16)
    blocks = [min(2000, 3000 * w // sum(weights)) + rng.randrange(3) for w in weights]
    blocks = [max(1, b) for b in blocks]
    plan = M.Plan([str(i) for i in range(k)], weights, blocks, 8, 0)
    order, horizon = pfair_slots(weights, blocks)
    got = {r.slot: (r.number, r.block) for r in M.schedule(spark, plan).collect()}
    placed = Counter()
    for slot, source in enumerate(order[:horizon]):
        assert got[slot] == (source, placed[source])
        placed[source] += 1
    number, block = got[horizon]  # the first slot whose source has no block left
    assert block == blocks[number] == placed[number]


def test_blocks_stay_as_they_are_at_any_size(spark):
    """Large whole numbers: sums beyond 64 bits, and a source of the least weight."""
    plan = M.Plan(["a", "b", "c"], [10**15, 10**15 + 1, 1], [3 * 10**3, 10, 1], 8, 0)
    order, horizon = pfair_slots(plan.weights, plan.blocks)
    got = sorted((r.slot, r.number) for r in M.schedule(spark, plan).where(f"slot < {horizon}").collect())
    assert [n for _, n in got] == order[:horizon]


def test_order_does_not_depend_on_partitions(spark):
    df = rows(spark, {"a": 300, "b": 50})
    one = {(r.row.doc_id, r.position) for r in M.mix_sources(df).collect()}
    assert one == {(r.row.doc_id, r.position) for r in M.mix_sources(df.repartition(13)).collect()}


def test_edges(spark, make, edge):
    assert M.mix_sources(make([])).count() == 0
    assert M.mix_sources(make([*edge, edge[3], edge[3]])).count() == len(edge) + 2
    given_weights = M.mix_sources(rows(spark, {"a": 40, "b": 40}), weights={"a": 3.0, "b": 1.0}, block_rows=1)
    first = [r.source for r in given_weights.orderBy("position").limit(40).collect()]
    assert Counter(first) == {"a": 30, "b": 10}
    with pytest.raises(ValueError):
        M.plan_mix(rows(spark, {"a": 4}), weights={"b": 1.0})
    assert not re.search("Python|Pandas|Arrow", M.mix_sources(make(edge))._jdf.queryExecution().toString())
