"""A Merkle manifest of a dataset, with its nodes in an external store.

Leaves are sorted by source and identifier and numbered; runs of consecutive nodes are the rows of a
store, one Parquet table partitioned by level. Each written level is made from the one before, read in
order of its coordinates (source and position), and a second tree over the sources' roots closes the
manifest. Proofs are extracted from the top down: a level's runs meet the paths of their parents in a
merge join by coordinate, so a path that many leaves share is built once."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.llm.common import cut, ident, shared_folder

#: The columns that a leaf covers, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
#: The single tree over the sources' roots.
TOP = "top"
#: A node's siblings in its run, as bytes of their digests, before and after it.
STEP = "struct<left:binary,right:binary>"
#: Levels that a row of the store holds: the reads, writes and joins of a manifest are so many fewer.
HEIGHT = 3
RUN = "tree string, run long, n long, levels array<array<binary>>, steps int, top binary, kids array<struct<leaf:binary,shown:binary,doc_id:long>>, level int"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """A value as a leaf holds it: its length in UTF-8 bytes, a colon and itself; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[c]) for c in LEAF])


def tree_key(source: Column) -> Column:
    """A source's tree: null has one of its own, which sorts first (as bytes) among all names."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, the row's place from 0 in its tree by the order, and n, the rows of its tree.

    Rows are dealt by ranges of tree and order, so a tree with a third of all rows spreads over many
    ranges. A range numbers its own rows; the counts of a tree's earlier ranges, one row a range and
    tree, shift them. The dealt rows are settled, so both uses see the same ranges."""
    dealt = cut(leaves.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()))
    by_range = Window.partitionBy("tree").orderBy("range")
    counts = dealt.groupBy("tree", "range").agg(F.count("*").alias("own"))
    shifts = counts.select(
        "tree", "range",
        F.coalesce(F.sum("own").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.sum("own").over(Window.partitionBy("tree")).alias("n"),
    )
    own = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(shifts, ["tree", "range"]).withColumn("pos", F.col("own") + F.col("shift")).drop("own", "shift", "range")


@dataclass(frozen=True)
class Store:
    """The nodes of trees, in a Parquet table partitioned by level. A row of the table is a run of
    arity^HEIGHT consecutive nodes with the HEIGHT levels above them that it holds alone: levels[0] are
    the digests of its nodes, levels[1] of their parents, and so on below the run's own top. n is the
    number of nodes that the tree has at the run's level; kids is what the leaves carry. The parents of
    a level's runs are the nodes HEIGHT levels further up, so level counts by HEIGHT."""

    folder: str
    levels: int
    arity: int

    def level(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(RUN).parquet(self.folder).where(F.col("level") == level)


def _above(nodes: Column, arity: int) -> Column:
    """The digests of the parents of consecutive nodes."""
    number = F.ceil(F.size(nodes) / arity).cast("int")
    members = lambda i: F.aggregate(F.slice(nodes, i * arity + 1, arity), F.lit(""), lambda s, h: F.concat(s, hex_of(h)))
    return F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.unhex(digest(members(i))))


def _steps(n: Column, arity: int) -> Column:
    """How many levels a run of a tree of n nodes has above it, HEIGHT at most, before one node is left."""
    out = F.lit(HEIGHT)
    for steps in reversed(range(HEIGHT)):
        out = F.when(n <= arity**steps, steps).otherwise(out)
    return out


def write_store(nodes: DataFrame, folder: str, arity: int) -> Store:
    """Writes runs level by level until every tree has a single node.

    nodes: tree, pos, n, hash, leaf, shown, doc_id. A run's members are next to each other in the order
    that the level below was read in, so the exchange by run folds a fixed number of rows and no tree is
    ever gathered. A written level has a 27th of the rows of the one before (at arity 3), and what the
    driver learns of it is whether it has a run with a parent."""
    spark, level, members = nodes.sparkSession, 0, arity**HEIGHT
    while True:
        kid = F.struct("pos", "hash", "leaf", "shown", "doc_id")
        runs = nodes.groupBy("tree", F.expr(f"pos div {members}").alias("run"), "n").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        runs = runs.withColumn("h0", F.transform("kids", lambda k: k["hash"]))
        for i in range(HEIGHT):
            runs = runs.withColumn(f"h{i + 1}", _above(F.col(f"h{i}"), arity))
        steps = _steps(F.col("n"), arity)
        levels = F.slice(F.array(*[f"h{i}" for i in range(HEIGHT)]), F.lit(1), F.greatest(steps, F.lit(1)))
        top = F.element_at(F.array(*[f"h{i}" for i in range(HEIGHT + 1)]), steps + 1)[0]
        carried = F.transform("kids", lambda k: F.struct(k["leaf"].alias("leaf"), k["shown"].alias("shown"), k["doc_id"].alias("doc_id")))
        runs = runs.select("tree", "run", "n", levels.alias("levels"), steps.alias("steps"), top.alias("top"), carried.alias("kids"))
        runs.sortWithinPartitions("tree", "run").write.parquet(f"{folder}/level={level}")
        store = Store(folder, level + 1, arity)
        below = store.level(spark, level).where(F.col("n") > members)
        if below.isEmpty():
            return store
        none = F.lit(None)
        nodes = below.select(
            "tree", F.col("run").alias("pos"), F.ceil(F.col("n") / members).cast("long").alias("n"), F.col("top").alias("hash"),
            none.cast("binary").alias("leaf"), none.cast("binary").alias("shown"), none.cast("long").alias("doc_id"),
        )
        level += 1


def roots(spark: SparkSession, store: Store) -> DataFrame:
    """(tree, root) of every tree, from its single run, at whichever level that is."""
    single = spark.read.schema(RUN).parquet(store.folder).where(F.col("n") <= store.arity**HEIGHT)
    return single.select("tree", F.col("top").alias("root"))


def _own_path(at: Column, arity: int) -> Column:
    """The siblings that the node at a place of a run has, by level, up to the run's top."""
    joined = lambda hashes: F.aggregate(hashes, F.lit(b""), lambda s, h: F.concat(s, h))

    def step(nodes: Column, level: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(arity)), level)).cast("int")
        rank = place % arity
        before, after = F.slice(nodes, place - rank + 1, rank), F.slice(nodes, place + 2, arity - 1 - rank)
        return F.struct(joined(before).alias("left"), joined(after).alias("right"))

    return F.transform(F.slice("levels", F.lit(1), F.col("steps")), step)


def paths(spark: SparkSession, store: Store, above: DataFrame) -> DataFrame:
    """The leaves (tree, leaf, shown, doc_id) with path, the steps from leaf to root, and the columns
    of above (tree, path, ...), whose path each tree's own goes on with."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    members, parents = store.arity**HEIGHT, None
    for level in reversed(range(store.levels)):
        runs = store.level(spark, level).drop("level")
        met = runs.where(F.col("n") <= members).join(above, "tree")
        if parents is not None:
            met = met.unionByName(runs.where(F.col("n") > members).join(parents, ["tree", "run"]))
        whole = met.select("tree", "run", "levels", "steps", "path", *carried, F.posexplode("kids").alias("at", "kid"))
        whole = whole.withColumn("path", F.concat(_own_path(F.col("at"), store.arity), F.col("path")))
        parents = whole.select("tree", (F.col("run") * members + F.col("at")).alias("run"), "path", *carried)
    return whole.select("tree", "kid.leaf", "kid.shown", "kid.doc_id", "path", *carried)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: digest(hex_of(step["left"]), h, hex_of(step["right"])))


def dataset_manifest(docs: DataFrame, *, shown: dict[str, Column] | None = None, arity: int = 3, folder: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``leaf``, ``subroot`` (of its source's tree), ``root``,
    ``proof_sha256`` (digest of the siblings from leaf to root), ``path`` (the siblings by level, as
    bytes before and after), ``folded_root`` (recomputed from the row as shown and its path) and
    ``verified`` (whether that is the root).

    shown gives columns of a row as a verifier sees them, where they differ from docs; the store is
    written below folder, which all executors share (else to one of its own in the checkpoint folder),
    and stays there for later proofs.

    Sources ascend by their names' UTF-8 bytes, null first; in a source rows ascend by doc_id, null
    first, then by leaf, so repeated rows have equal leaves side by side and the result does not depend
    on partitioning. Null fields are hyphens in a leaf; empty texts have length 0; texts are hashed in
    whole where they are read and never move. An empty table gives an empty result; other columns are
    not read.

    Nodes are 32 bytes; levels are joined from the top by coordinate, so the paths moved add up to
    half a path a leaf, and no task gathers a source."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}"
    own = {c: F.col(c) for c in LEAF}
    leaves = docs.select(
        tree_key(F.col("source").cast("string")).alias("tree"), ident("doc_id").alias("did"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(leaf_digest(own)).alias("leaf"), F.unhex(leaf_digest(own | (shown or {}))).alias("shown"),
    )
    nodes = numbered(cut(leaves), ["did", "leaf"]).withColumn("hash", F.col("leaf"))
    store = write_store(nodes, f"{folder}/sources", arity)
    tops = roots(spark, store)
    tops = numbered(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "root"), ["name"])
    named = cut(tops)
    none = F.lit(None)
    top_nodes = named.select("tree", "pos", "n", F.col("root").alias("hash"), F.col("root").alias("leaf"), none.cast("binary").alias("shown"), F.col("pos").alias("doc_id"))
    top = write_store(top_nodes, f"{folder}/top", arity)
    no_path = F.array().cast(f"array<{STEP}>")
    whole = roots(spark, top).select("tree", "root", no_path.alias("path"))
    of_source = paths(spark, top, whole).select(F.col("doc_id").alias("pos"), "path", "root")
    above = named.select(F.col("name").alias("tree"), "pos", F.col("root").alias("subroot")).join(of_source, "pos").drop("pos")
    out = paths(spark, store, above)
    siblings = F.aggregate("path", F.lit(b""), lambda s, step: F.concat(s, step["left"], step["right"]))
    again = folded(hex_of(F.col("shown")), F.col("path"))
    return out.select(
        "doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"),
        F.sha2(hex_of(siblings).cast("binary"), 256).alias("proof_sha256"), "path", again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
