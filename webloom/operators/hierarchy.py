"""Parent links to full hierarchies, with loops told apart.

The classic way joins the frontier of one level to its children, a job for each level; chains
of some hundred levels then cost some hundred jobs.  Here the level-wise frontier join covers
a block of levels that doubles: after round k every entry within ``2**k`` links of its root is
reached and the others hold their ancestor ``2**k`` links up, so depth D takes ``log2 D`` rounds.
Ancestor pairs (entry, ancestor ``2**k`` up) are summed by ancestor as they arise, which counts
descendants without ever expanding all pairs.  Entries never reached lie on loops or lead into
them: doubling goes on until the set of pointers no longer shrinks, and that set is the loops.

Hot parents: sums are pre-aggregated before their shuffle, and the pointer join is a plain
sort-merge join that adaptive execution splits.  Once reached, an entry is written and never moves again: each round
joins the active entries to what they point at, and the sums of all rounds are added up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.scratch import Scratch

_RESULT = ["tree", "node", "root", "hops", "n_below"]


def latest_links(df: DataFrame, tree: str, node: str, parent: str, updated: str, order: str) -> DataFrame:
    """(tree, node, parent) of the newest row per entry; missing ``updated`` is oldest, ties go to the largest ``order``."""
    best = F.max(F.struct(F.col(updated), F.col(order), F.col(parent))).alias("best")
    return (
        df.where(F.col(tree).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("tree"), F.col(node).cast("long").alias("node"))
        .agg(best)
        .select("tree", "node", F.col(f"best.{parent}").cast("long").alias("parent"))
    )


def _jump(active: DataFrame, target: DataFrame, cols: list) -> DataFrame:
    """Each active entry with what its pointer's entry knows."""
    return active.join(target.select("tree", F.col("node").alias("ptr"), *cols), ["tree", "ptr"])


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """Root, hops and number of descendants of every entry of ``links`` (tree, node, parent; one row per entry).

    hops: links up to the root; -1 on a loop, -2 leading into one; there root is the loop's smallest node.
    A parent that is null or not among the entries makes a root; a parent equal to the node is a loop of one.
    ``with_path`` adds the array of nodes from the root down to the entry, null for loops and what leads into
    them.  No entries give no rows; other columns of ``links`` are ignored.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.cut(links.select("tree", "node", "parent"), "links")
    known = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    ptr = F.when(F.col("known"), F.col("parent"))
    path = ["path"] if with_path else []
    null = lambda kind: F.lit(None).cast(kind)
    root, size = F.when(ptr.isNull(), F.col("node")), F.lit(1).cast("long")
    start = links.join(known, ["tree", "parent"], "left").select("tree", "node", ptr.alias("ptr"), ptr.alias("parent"), size.alias("size"), root.alias("root"), F.when(root.isNotNull(), 0).alias("hops"), *([F.array("node").alias("path")] if with_path else []))
    start, step = scratch.cut(start, "start"), 1
    # finished entries are written once, a table a round, and only looked up from then on; active ones move
    rounds, sums, active = [start], [], start.where("root is null").select("tree", "node", "ptr", "parent", "size", *path)
    left = active.count()
    done = lambda: scratch.together(*rounds).where("root is not null")
    while left:
        reached = done().select("tree", F.col("node").alias("ptr"), null("long").alias("ptr2"), F.col("root").alias("root2"), F.col("hops").alias("hops2"), *([F.col("path").alias("path2")] if with_path else []))
        still = active.select("tree", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), null("long").alias("root2"), null("int").alias("hops2"), *([F.col("path").alias("path2")] if with_path else []))
        met = active.join(reached.unionByName(still), ["tree", "ptr"])
        met = scratch.cut(met.select("tree", "node", F.col("ptr2").alias("ptr"), "parent", "size", F.col("root2").alias("root"), (F.col("hops2") + step).alias("hops"), *([F.concat("path2", "path").alias("path")] if with_path else [])), "met")
        gained = scratch.cut(active.groupBy("tree", F.col("ptr").alias("node")).agg(F.sum("size").alias("gain")), "gained")
        rounds.append(met)
        sums.append(gained)
        more = met.where("root is null").join(gained, ["tree", "node"], "left")
        old, active, step = active, scratch.cut(more.select("tree", "node", "ptr", "parent", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), *path), "active"), step * 2
        scratch.drop(old)
        now = active.count()
        if now == left:
            break  # nobody was reached: a nearer entry would have been first
        left = now
    reached, below = done(), F.lit(0).cast("long")
    if sums:
        total = scratch.together(*sums).groupBy("tree", "node").agg(F.sum("gain").alias("gain"))
        reached, below = reached.join(total, ["tree", "node"], "left"), F.coalesce("gain", F.lit(0))
    reached = reached.select("tree", "node", "root", "hops", below.alias("n_below"), *path)
    if not left:
        return reached
    loops = _loops(scratch, active.select("tree", "node", "ptr", "parent", "size"))
    return reached.unionByName(loops, allowMissingColumns=True)


def _loops(scratch: Scratch, rest: DataFrame) -> DataFrame:
    """The same columns for entries no root was found for."""
    rest, ends = scratch.cut(rest, "rest"), -1
    while True:
        now = rest.select("tree", "ptr").distinct().count()
        if now == ends:
            break
        ends = now
        moved = _jump(rest.select("tree", "node", "ptr", "parent"), rest, [F.col("ptr").alias("ptr2")]).select("tree", "node", F.col("ptr2").alias("ptr"), "parent", F.lit(0).cast("long").alias("size"))
        own = rest.select("tree", "node", F.lit(None).cast("long").alias("ptr"), F.lit(None).cast("long").alias("parent"), "size")
        pairs = rest.groupBy("tree", F.col("ptr").alias("node")).agg(F.sum("size").alias("size"))
        pairs = pairs.select("tree", "node", F.lit(None).cast("long").alias("ptr"), F.lit(None).cast("long").alias("parent"), "size")
        merged = own.unionByName(moved).unionByName(pairs).groupBy("tree", "node").agg(F.max("ptr").alias("ptr"), F.max("parent").alias("parent"), F.sum("size").alias("size"))
        old, rest = rest, scratch.cut(merged, "rest")
        scratch.drop(old)
    on = rest.select("tree", F.col("ptr").alias("node")).distinct()
    ring = scratch.cut(rest.join(on, ["tree", "node"], "left_semi").select("tree", "node", F.col("parent").alias("ptr"), F.col("node").alias("low")), "ring")
    while True:
        met = _jump(ring, ring, [F.col("ptr").alias("ptr2"), F.col("low").alias("low2")])
        met = met.select("tree", "node", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell"))
        old, ring = ring, scratch.cut(met, "ring")
        scratch.drop(old)
        if not ring.where("fell").limit(1).count():
            break
    label = ring.select("tree", F.col("node").alias("ptr"), F.col("low").alias("root"))
    on = ring.select("tree", "node", F.lit(True).alias("on_loop"))
    named = rest.join(label, ["tree", "ptr"]).join(on, ["tree", "node"], "left")
    total = named.groupBy("tree", "root").agg(F.count("*").alias("total"))
    return named.join(total, ["tree", "root"]).select(
        "tree", "node", "root", F.when(F.col("on_loop"), -1).otherwise(-2).alias("hops"),
        (F.when(F.col("on_loop"), F.col("total")).otherwise(F.col("size")) - 1).alias("n_below"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(tree, ancestor, node, distance) for each entry below each ancestor, from ``hierarchy(..., with_path=True)``."""
    at = paths.select("tree", "node", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return at.where("ancestor <> node").select("tree", "ancestor", "node", (F.col("n") - 1 - F.col("pos")).alias("distance"))
