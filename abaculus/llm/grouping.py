"""Connected groups over candidate buckets, without the square of a bucket's size.

Buckets of up to ``PAIR_BUCKET`` members make all their pairs. A larger bucket is
resolved in rounds: a few centres are compared with all members that are not yet
in a centre's component, the centres leave the bucket, components are updated,
and the bucket is done once all that is left of it lies in one component. Every
pair is so verified, ruled out, or already connected.

Where nodes are sets, the elements that few nodes of large buckets hold settle more.
Nodes that share one of them are paired by it. For all other pairs the number of a
node's scarce elements bounds the similarity, with every other node at once. Nodes
that the bound leaves no partner leave the bucket, and those with the fewest scarce
elements are the centres: copies of one text with changes of their own are linked
to the least changed one, or proven to have no partner, in one round. For what is
left each round takes ``growth`` times as many centres, so that the number of rounds
is a logarithm of a bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace

PAIR_BUCKET = 8
CENTRES, GROWTH = 6, 8


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, comp) of an undirected edge table (a, b): comp is the smallest node reachable.

    Each round every node takes the smallest label among its neighbours' and then
    the label of its label, so a chain of length n takes about log n rounds.
    """
    links = ws.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = ws.write(links.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), F.least("a", "comp").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        hop = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("hop"))
        near = labels.join(hop.withColumnRenamed("a", "node"), "node").select("node", "comp", F.least("comp", "hop").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("comp").alias("jumped"))
        best = F.least("best", F.coalesce("jumped", "best"))
        after = ws.write(near.join(jump, "best", "left").select("node", best.alias("comp"), (best < F.col("comp")).alias("moved")), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        labels = after.select("node", "comp")
        if after.where("moved").isEmpty():
            ws.drop(f"{name}-links")
            return labels


def merged(ws: Workspace, labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``labels`` (node, comp) after further edges (a, b): only the components that these connect are worked on."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    between = ws.write(joined.where("a <> b").distinct(), f"{name}-between")
    if between.isEmpty():
        return labels
    moves = components(ws, between, name)
    moved = labels.join(moves.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return ws.write(moved.union(moves.join(labels, "node", "left_anti").select("node", "comp")), f"{name}-merged")


def shared_buckets(ws: Workspace, members: DataFrame) -> DataFrame:
    """(place, bucket, node, size) of the (node, place, bucket) whose bucket holds two nodes or more."""
    counts = members.groupBy("place", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return ws.write(members.join(counts, ["place", "bucket"]), "members")


def group(
    ws: Workspace,
    nodes: DataFrame,
    members: DataFrame,
    likely: Callable[[Column, Column, Column], Column],
    verify: Callable[[DataFrame, str], DataFrame],
    scarce: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
    bound: Callable[[Column, Column, Column, Column], Column] | None = None,
    centres_at_first: int = CENTRES,
    growth: int = GROWTH,
) -> DataFrame:
    """(node, comp) of all nodes linked with another.

    ``nodes`` holds (node, n, sketch): its size and whatever ``likely`` needs; ``members`` is what ``shared_buckets`` gives.
    ``likely(sketch, sketch, place)`` tells whether a pair met in a bucket of that place may be linked (and is not to be
    made elsewhere). It and ``bound`` stand inside the joins, so pairs that are ruled out are never made.
    ``verify`` gets distinct pairs (a, b), a < b, and a name for tables it writes; it returns (a, b, linked) for those
    that it doesn't rule out.
    ``scarce`` gives for a table of nodes (node, own), how many scarce elements each has, and (a, b), all pairs
    that may be linked and share one; ``bound(n, own, other_n, other_own)`` tells whether a node may be linked with
    one of ``other_n`` elements or more, ``other_own`` of them scarce or more, none of which they share.
    """
    large = F.col("size") > PAIR_BUCKET
    bound = bound or (lambda n, own, other_n, other_own: F.lit(True))

    same = (F.col("bucket") == F.col("bucket_b")) & (F.col("place") == F.col("place_b"))
    side = lambda df: df.select(*[F.col(c).alias("b" if c == "node" else f"{c}_b") for c in ("bucket", "place", "node", "comp", "n", "own", "sketch")])
    met = likely(F.col("sketch"), F.col("sketch_b"), F.col("place")) & bound(*map(F.col, ("n", "own", "n_b", "own_b"))) & bound(*map(F.col, ("n_b", "own_b", "n", "own")))
    few = members.where(~large).join(nodes, "node").select("place", "bucket", "node", "sketch", F.col("node").alias("comp"), "n", F.lit(0).cast("long").alias("own"))
    pairs = few.join(side(few), same & (F.col("node") < F.col("b")) & met).select(F.col("node").alias("a"), "b")
    crowd = ws.write(members.where(large).select("node").distinct(), "crowd")
    own = crowd.select("node", F.lit(0).alias("own"))
    if scarce:
        own, sharing = scarce(crowd)
        pairs = pairs.union(sharing.select("a", "b"))
    own = ws.write(crowd.join(own, "node", "left").select("node", F.coalesce("own", F.lit(0)).cast("long").alias("own")), "own")
    many = members.where(large).join(nodes.join(own, "node"), "node").where(bound(F.col("n"), F.col("own"), F.lit(0), F.lit(0)))
    many = ws.write(many.select("place", "bucket", "node", "sketch", F.col("node").alias("comp"), "n", "own"), "many")
    step, done = 0, None
    while True:
        # row_number with a limit is cut before the shuffle too, so a large bucket sends a few rows per task
        rank = F.row_number().over(Window.partitionBy("place", "bucket").orderBy("own", "order", "node"))
        centres = many.withColumn("order", F.xxhash64("node")).withColumn("rank", rank).where(F.col("rank") <= centres_at_first * growth**step)
        centres = ws.write(side(centres), f"centres-{step}")
        # members that a centre's component already holds are left out inside the join too
        stars = many.join(centres, same & (F.col("comp") != F.col("comp_b")) & met)
        stars = stars.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        if step:
            found = verify(stars.distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"), f"round-{step}")
            done = done.union(found.select("a", "b", "linked"))
        else:
            found = done = verify(stars.union(pairs).distinct(), f"round-{step}")
        linked = found.where("linked").select("a", "b")
        labels = merged(ws, labels, linked, f"comps-{step}") if step else components(ws, linked, f"comps-{step}")
        used = centres.select(F.col("bucket_b").alias("bucket"), F.col("place_b").alias("place"), F.col("b").alias("node"))
        left = many.join(used, ["place", "bucket", "node"], "left_anti").drop("comp")
        left = left.join(labels, "node", "left").select("place", "bucket", "node", "sketch", F.coalesce("comp", "node").alias("comp"), "n", "own")
        left = ws.write(left, f"left-{step}")
        least = left.groupBy("place", "bucket").agg(F.min("n").alias("least_n"), F.min("own").alias("least_own"))
        left = left.join(least, ["place", "bucket"]).where(bound(*map(F.col, ("n", "own", "least_n", "least_own"))))
        undecided = left.groupBy("place", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("place", "bucket")
        many = ws.write(left.join(undecided, ["place", "bucket"], "left_semi").select("place", "bucket", "node", "sketch", "comp", "n", "own"), f"many-{step}")
        if many.isEmpty():
            return labels
        step += 1
