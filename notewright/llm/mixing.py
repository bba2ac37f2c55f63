"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks. Block j (from 0) of a source of weight w (a share of 1) is
released at slot floor(j / w) and due by slot ceil((j + 1) / w); earliest deadline first fills the
slots, one block each. Weights are whole numbers over their sum and never rounded to a period, so
the deviation from the target does not grow. The schedule is made in chunks of slots side by side, and
no part of it passes through the driver. Built-in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import col, cut, ident, shuffle_partitions

#: Weights count to so many parts of 1.
GRAIN = 10**6
#: Slots of a chunk, and slots before it over which its first state is found.
CHUNK = 256
WARM = 256
WIDE = "decimal(38,0)"


def whole_weights(weights: list[float]) -> list[int]:
    """The weights as whole numbers of millionths, one at least: their ratios are the target."""
    return [max(1, round(w * GRAIN)) for w in weights]


@dataclass(frozen=True)
class Plan:
    """A mixing plan: sources, their whole weights and numbers of blocks, the rows of a block and how
    finely each source is ranked."""

    sources: list[str | None]
    weights: list[int]
    blocks: list[int]
    block_rows: int
    buckets_log2: int

    @property
    def total(self) -> int:
        return sum(self.weights)

    @property
    def last_slot(self) -> int:
        """No source has a block for all slots up to this one: the first that lacks a block lacks it by
        its deadline."""
        return min(-(-(b + 1) * self.total // w) for b, w in zip(self.blocks, self.weights, strict=True))


def plan_mix(
    docs: DataFrame,
    *,
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.7,
    block_rows: int = 8,
) -> Plan:
    """Counts the rows of every source (one row a source comes to the driver). Without given weights, a
    source weighs its count to the exponent. Blocks hold block_rows rows, however many there are."""
    counts = docs.groupBy(col(source_col).cast("string").alias("source")).count().collect()
    n = {r["source"]: r["count"] for r in counts}
    if weights is not None and (missing := set(n) - set(weights)):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    sources = sorted(n, key=lambda s: (s is not None, s))
    if not sources:
        return Plan([], [], [], block_rows, 0)
    given = [weights[s] if weights else n[s] ** exponent for s in sources]
    if min(given) <= 0:
        raise ValueError("weights must be above 0")
    return Plan(sources, whole_weights(given), [-(-n[s] // block_rows) for s in sources], block_rows, max(0, (max(n.values()) // 1000).bit_length()))


def _sources(spark: SparkSession, plan: Plan) -> DataFrame:
    """(of_source, number, w, blocks): a row a source."""
    names = F.array(*[F.lit(s).cast("string") for s in plan.sources]).cast("array<string>")
    whole = lambda values, name: F.array(*[F.lit(v) for v in values]).cast("array<bigint>").alias(name)
    zipped = F.arrays_zip(names.alias("name"), whole(plan.weights, "w"), whole(plan.blocks, "blocks"))
    rows = spark.range(1).select(F.posexplode(zipped).alias("number", "of"))
    return rows.select(F.col("of.name").alias("of_source"), F.col("number").cast("long").alias("number"), F.col("of.w").alias("w"), F.col("of.blocks").alias("blocks"))


# A source's standing is a struct: its number, weight w, total div w, total % w, the block j that comes
# next, that block's release q, and nq and nr, the quotient and remainder of (j + 1) total / w, which
# give its deadline and the next release.


def _standing(number: Column, w: Column, j: Column, total: int) -> Column:
    whole = F.lit(total).cast(WIDE)
    wide, w_wide = j.cast(WIDE) * whole, w.cast(WIDE)
    after = (j.cast(WIDE) + 1) * whole
    div = lambda a, b: F.call_function("div", a, b)
    return F.struct(
        number.alias("number"), w.alias("w"), div(whole, w_wide).alias("tq"), (whole % w_wide).cast("long").alias("tr"), j.alias("j"),
        div(wide, w_wide).alias("q"), div(after, w_wide).alias("nq"), (after % w_wide).cast("long").alias("nr"),
    )


def _advanced(x: Column) -> Column:
    """The standing once the block is placed, by whole numbers alone."""
    over = x["nr"] + x["tr"] >= x["w"]
    return F.struct(
        x["number"].alias("number"), x["w"].alias("w"), x["tq"].alias("tq"), x["tr"].alias("tr"), (x["j"] + 1).alias("j"), x["nq"].alias("q"),
        (x["nq"] + x["tq"] + over.cast("long")).alias("nq"), (x["nr"] + x["tr"] - F.when(over, x["w"]).otherwise(0)).alias("nr"),
    )


def _urgency(x: Column) -> Column:
    """Deadline, then the earlier source."""
    return F.struct((x["nq"] + (x["nr"] > 0).cast("long")).alias("due"), x["number"].alias("number"))


def _supposed(at: Column, weights: Column, total: int) -> Column:
    """Standings at a slot as they may well be: every block due by then is placed, and of those released
    before and due after, the most urgent, so that as many are placed as there are slots."""
    due = F.transform(weights, lambda w, i: _standing(i.cast("long"), w, F.call_function("div", at.cast(WIDE) * w.cast(WIDE), F.lit(total).cast(WIDE)), total))

    def with_more(states: Column) -> Column:
        more = at - F.aggregate(states, F.lit(0).cast("long"), lambda n, x: n + x["j"])
        open_ = F.array_sort(F.transform(F.filter(states, lambda x: x["q"] < at), _urgency))
        chosen = F.transform(F.slice(open_, F.lit(1), more.cast("int")), lambda u: u["number"])
        return _bound(chosen, lambda c: F.transform(states, lambda x: F.when(F.array_contains(c, x["number"]), _advanced(x)).otherwise(x)))

    return _bound(due, with_more)


def _bound(value: Column, use) -> Column:
    """use(value) with value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _filled(first: Column, last: Column, states: Column) -> Column:
    """(states, picks) after filling the slots from first to before last: each goes to the released block
    of the earliest deadline. A pick is the source's number and its block."""
    picks = F.array().cast("array<struct<number:bigint,block:bigint>>")
    start = F.struct(states.alias("states"), picks.alias("picks"))

    def fill(acc: Column, t: Column) -> Column:
        ready = F.transform(F.filter(acc["states"], lambda x: x["q"] <= t), _urgency)

        def place(a: Column, p: Column) -> Column:
            block = F.get(a["states"], p.cast("int"))["j"]
            moved = F.transform(a["states"], lambda x: F.when(x["number"] == p, _advanced(x)).otherwise(x))
            return F.struct(moved.alias("states"), F.concat(a["picks"], F.array(F.struct(p.alias("number"), block.alias("block")))).alias("picks"))

        return F.aggregate(F.array(F.array_min(ready)["number"]), acc, place)

    slots = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(slots, start, fill)


def _placed(states: Column) -> Column:
    return F.transform(states, lambda x: x["j"])


def schedule(spark: SparkSession, plan: Plan) -> DataFrame:
    """(number, block, slot) of every slot up to plan.last_slot, as if no source ran out of blocks: each
    slot goes to the released block with the earliest deadline, ties to the earlier source. The weights'
    shares add up to one, so a block is always ready, every block meets its deadline, and at every slot
    each source has had its share of the slots to within less than one block.

    The slots are filled in chunks side by side. Since a source's blocks placed by a slot are its share
    rounded down or up, a chunk's first state is nearly known; it is supposed WARM slots earlier, and
    what the slots up to the chunk make of it is taken. Where the chunk before ends otherwise than
    supposed, a chunk is filled again from that end, until all agree: then the chunks are the one
    schedule, and what was supposed has left no trace."""
    total, chunks = plan.total, plan.last_slot // CHUNK + 1
    weights = F.array(*[F.lit(w) for w in plan.weights]).cast("array<bigint>")
    first = F.col("chunk") * CHUNK
    parts = min(chunks, 4 * shuffle_partitions(spark))
    before = F.greatest(F.lit(0).cast("long"), first - WARM)
    supposed = _bound(_supposed(before, weights, total), lambda s: _placed(_filled(before, first, s)["states"]))
    asked = spark.range(0, chunks, 1, parts).select(F.col("id").alias("chunk"), supposed.alias("begin"))

    def run(asked: DataFrame) -> DataFrame:
        states = F.transform(F.arrays_zip(weights.alias("w"), F.col("begin").alias("j")), lambda x, i: _standing(i.cast("long"), x["w"], x["j"], total))
        out = asked.withColumn("out", _filled(first, first + CHUNK, states))
        return cut(out.select("chunk", "begin", _placed(F.col("out.states")).alias("end"), F.col("out.picks").alias("picks")))

    done = run(asked)
    while True:
        ends = done.select((F.col("chunk") + 1).alias("chunk"), F.col("end").alias("is"))
        wrong = cut(done.select("chunk", "begin").join(ends, "chunk").where(F.col("begin") != F.col("is")).select("chunk", F.col("is").alias("begin")))
        if wrong.isEmpty():
            break
        done = cut(done.join(wrong.select("chunk"), "chunk", "left_anti").unionByName(run(wrong)))
    picked = done.select("chunk", F.posexplode("picks").alias("at", "pick"))
    return picked.select("pick.number", "pick.block", (F.col("chunk") * CHUNK + F.col("at")).alias("slot"))


def _late(plan: Plan, horizon: Column, placed: Column, number: Column, deadline: Column) -> Column:
    """The slot of a block that is left at the horizon: what is left follows by deadline, ties to the
    earlier source. How many blocks of a source come before is a quotient: none is enumerated."""
    slot = horizon
    for i, (w, n) in enumerate(zip(plan.weights, plan.blocks, strict=True)):
        upto = deadline - F.when(F.lit(i) < number, 0).otherwise(1)  # deadlines that come before
        due = F.call_function("div", upto.cast(WIDE) * F.lit(w).cast(WIDE), F.lit(plan.total).cast(WIDE))
        ahead = F.greatest(F.lit(0).cast("long"), F.least(due, F.lit(n).cast("long")) - F.get(placed, F.lit(i)))
        slot = slot + F.when(number == i, F.lit(0)).otherwise(ahead)
    return slot


def _key(number: Column, block: Column) -> Column:
    return F.shiftleft(number.cast("long"), 32).bitwiseOR(block.cast("long"))


def _order_key(docs: DataFrame, seed: int) -> Column:
    """MD5 of the seed and of every column in turn (as text; others than scalars as JSON)."""
    simple = lambda f: not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    parts = [col(f.name).cast("string") if simple(f) else F.to_json(F.struct(col(f.name))) for f in docs.schema]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    exponent: float = 0.7,
    block_rows: int = 8,
    seed: int = 0,
) -> DataFrame:
    """One row per input row: ``row`` (the input row), ``source``, ``block``, ``place`` (in its
    block), ``slot``, ``release``, ``deadline``, ``position`` (slot times block_rows + place:
    the order of the mix) and ``in_mix``: whether the slot lies before the horizon, the first slot that
    falls to a source without a block left. Up to there every source has its target weight to within
    less than one block; the slots that follow hold what is left, by deadline, ties to the earlier
    source. A source's last block may be short.

    Weights count to a millionth, one at least; the default is the number of rows to the exponent. Blocks
    hold block_rows rows at any size of the table.

    A source's rows are ordered by a seeded hash of all their columns, then by identifier. A null
    source is a source of its own; null identifiers sort first; repeated rows keep separate
    places. An empty table gives an empty result; extra columns travel inside ``row`` only.

    Plan: a source is ranked in buckets of its hash, about 1000 rows of the largest source each,
    so a source with a third of all rows spreads over many tasks; bucket counts, summed per
    source, shift the ranks. Slots up to the horizon are made in parallel (see schedule) and joined by
    source and block together; the driver has a row a source, and those go into the plan. What is left
    after the horizon has its slot by a formula.
    """
    spark = docs.sparkSession
    plan = plan_mix(docs, source_col=source_col, weights=weights, exponent=exponent, block_rows=block_rows)
    leading = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    top = F.shiftright(leading, 32 - min(32, plan.buckets_log2))
    rows = docs.select(
        F.struct(F.col("*")).alias("row"),
        ident(id_col).alias("did"),
        col(source_col).cast("string").alias("source"),
        _order_key(docs, seed).alias("hash"),
    ).withColumn("bucket", top)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("source", "bucket").orderBy("hash", "did")
    ranked = (
        rows.withColumn("rank", F.row_number().over(within) - 1)
        .join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", F.col("rank") + F.col("shift"))
        .withColumn("block", F.expr(f"rank div {block_rows}"))
    )
    known = ranked.join(F.broadcast(_sources(spark, plan)), F.col("source").eqNullSafe(F.col("of_source")))  # one row a source
    if plan.sources:
        slots = cut(schedule(spark, plan))
        limits = F.array(*[F.lit(b) for b in plan.blocks]).cast("array<bigint>")
        horizon = slots.where(F.col("block") == F.get(limits, F.col("number").cast("int"))).agg(F.min("slot")).first()[0]
        mixed = slots.where(F.col("slot") < horizon)
        placed = mixed.groupBy("number").agg(F.max("block").alias("block")).collect()  # one row a source
        done = {r["number"]: r["block"] + 1 for r in placed}
        counts = F.array(*[F.lit(done.get(i, 0)) for i in range(len(plan.sources))]).cast("array<bigint>")
        keyed = mixed.select(_key(F.col("number"), F.col("block")).alias("key"), "slot")
    else:
        horizon, counts = 0, F.array().cast("array<bigint>")
        keyed = spark.range(0).select(F.col("id").alias("key"), F.col("id").alias("slot"))
    wide = lambda block: block.cast(WIDE) * F.lit(plan.total).cast(WIDE)
    div = lambda a: F.call_function("div", a, F.col("w").cast(WIDE))
    due = div(wide(F.col("block") + 1)) + (wide(F.col("block") + 1) % F.col("w").cast(WIDE) > 0).cast("long")
    met = known.withColumn("key", _key(F.col("number"), F.col("block"))).withColumn("deadline", due).join(keyed, "key", "left")
    late = _late(plan, F.lit(horizon).cast("long"), counts, F.col("number"), F.col("deadline")) + F.col("block") - F.get(counts, F.col("number").cast("int"))
    place = F.col("rank") % block_rows
    slot = F.coalesce("slot", late)
    return met.select(
        "row",
        "source",
        "block",
        place.alias("place"),
        slot.alias("slot"),
        div(wide(F.col("block"))).alias("release"),
        "deadline",
        (slot * block_rows + place).alias("position"),
        F.col("slot").isNotNull().alias("in_mix"),
    )
