"""Spanning forests, bridges and blocks of networks of any size, in rounds of joins; no network is ever gathered.

A forest is found by least edges of components (Boruvka). Its Euler tour is a list of arcs, ranked by doubling pointers,
on which a subtree is an interval: sums by exclusive or give bridges, least and greatest places give cut vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import Saved

N = ["network_id"]


def undirected(edges: DataFrame, *extra: str) -> DataFrame:
    """Each pair of different nodes once, src < dst; of repeated ones the least of ``extra``."""
    e = edges.select(*N, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *extra).where("src != dst")
    return e.groupBy(*N, "src", "dst").agg(*[F.min(c).alias(c) for c in extra]) if extra else e.distinct()


def minimum_spanning_forest(edges: DataFrame, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, labels): network_id, src, dst, w of the least edges that join all that is joined; network_id, node, component.

    In a round each component takes its least edge to another, by weight, then src, dst (a total order, so taken edges make
    no cycle but of two); what they join becomes one component under its least taker's name, and only the least edge
    between two components stays. Components at least halve in a round. Loops, repeats and null weights do no harm: the
    least repeat counts, and nulls come first. Nodes without edges are in no component. The component's name is one of its
    nodes, not always the least.
    """
    spark = edges.sparkSession
    store = Saved(spark)
    e = undirected(edges.withColumn("w", F.col(weight) if weight else F.lit(0)), "w")
    live = store.keep(e.select(*N, "src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    labels = store.keep(live.select(*N, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node")))
    forest = []
    while not live.isEmpty():
        ends = live.select(*N, "a", "b", "w", "src", "dst").unionByName(live.select(*N, F.col("b").alias("a"), F.col("a").alias("b"), "w", "src", "dst"))
        best = store.keep(ends.groupBy(*N, "a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e")).select(*N, "a", "e.*"))
        forest.append(store.keep(best.select(*N, "src", "dst", "w").distinct()))
        back = best.select(*N, F.col("a").alias("b"), F.col("b").alias("back"))
        up = best.join(back, [*N, "b"]).select(*N, "a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("up"))
        up = store.keep(up)
        while True:
            top = up.select(*N, F.col("a").alias("up"), F.col("up").alias("top"))
            step = store.keep(up.join(top, [*N, "up"]).select(*N, "a", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            store.drop(up)
            up, more = step, not step.where("moved").isEmpty()
            if not more:
                break
        name = lambda c: up.select(*N, F.col("a").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023,E731
        moved = live.join(name("a"), [*N, "a"]).join(name("b"), [*N, "b"]).where("a_up != b_up")
        least = moved.groupBy(*N, F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).agg(F.min(F.struct("w", "src", "dst")).alias("e"))
        after = store.keep(least.select(*N, "e.src", "e.dst", "e.w", "a", "b"))
        named = labels.join(name("component"), [*N, "component"], "left").select(*N, "node", F.coalesce("component_up", "component").alias("component"))
        named = store.keep(named)
        store.drop(live, labels, up, best)
        live, labels = after, named
    out = forest[0] if forest else live.select(*N, "src", "dst", "w")
    for f in forest[1:]:
        out = out.unionByName(f)
    return out, labels


def euler_tour(forest: DataFrame, labels: DataFrame, values: DataFrame) -> DataFrame:
    """network_id, component, src, dst, after, acc for both arcs of each forest edge.

    The arcs of a tree make one round tour, cut open at its least arc. ``after`` counts the arcs that follow, ``acc`` is the
    exclusive or of their values; a node's value (network_id, node, x; 0 if missing) stands on its arc to its least
    neighbour. Between the two arcs of an edge lie just the arcs that leave the nodes on one side of it. Each round
    doubles the reach of all arcs, so rounds grow with the logarithm of the longest tour.
    """
    store = Saved(forest.sparkSession)
    both = forest.select(*N, "src", "dst").unionByName(forest.select(*N, F.col("dst").alias("src"), F.col("src").alias("dst")))
    at = Window.partitionBy(*N, "src").orderBy("dst")
    arcs = both.withColumn("first", F.first("dst").over(at)).withColumn("then", F.coalesce(F.lead("dst").over(at), "first"))
    arcs = arcs.join(labels.withColumnRenamed("node", "src"), [*N, "src"]).join(values.withColumnRenamed("node", "src"), [*N, "src"], "left")
    # Row (s, d): the arc d -> s is followed by s -> then.
    arcs = store.keep(arcs.select(*N, "component", "src", "dst", "then", F.when(F.col("dst") == F.col("first"), F.coalesce("x", F.lit(0))).otherwise(0).cast("long").alias("x")))
    opened = arcs.groupBy(*N, "component").agg(F.min(F.struct("src", "dst")).alias("o"))
    nexts = arcs.select(*N, "component", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src").alias("to_src"), F.col("then").alias("to_dst"))
    nexts = nexts.join(opened, [*N, "component"])
    goes = ~((F.col("to_src") == F.col("o.src")) & (F.col("to_dst") == F.col("o.dst")))
    nexts = nexts.select(*N, "component", "src", "dst", *[F.when(goes, F.col(c)).alias(c) for c in ("to_src", "to_dst")])
    value = arcs.select(*N, F.col("src").alias("to_src"), F.col("dst").alias("to_dst"), "x")
    state = nexts.join(value, [*N, "to_src", "to_dst"], "left").select(*N, "component", "src", "dst", "to_src", "to_dst", F.coalesce("x", F.lit(0).cast("long")).alias("acc"), F.when(F.col("to_src").isNotNull(), 1).otherwise(0).cast("long").alias("after"))
    state = store.keep(state)
    store.drop(arcs)
    while not state.where("to_src is not null").isEmpty():
        ahead = state.select(*N, F.col("src").alias("to_src"), F.col("dst").alias("to_dst"), F.col("to_src").alias("s2"), F.col("to_dst").alias("d2"), F.col("acc").alias("acc2"), F.col("after").alias("after2"))
        j = state.join(ahead, [*N, "to_src", "to_dst"], "left")
        step = store.keep(j.select(*N, "component", "src", "dst", F.col("s2").alias("to_src"), F.col("d2").alias("to_dst"), F.col("acc").bitwiseXOR(F.coalesce(F.col("acc2"), F.lit(0).cast("long"))).alias("acc"), (F.col("after") + F.coalesce("after2", F.lit(0))).alias("after")))
        store.drop(state)
        state = step
    return state.drop("to_src", "to_dst")


def _tours(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(forest edges with both arcs' figures, other edges, labels, all edges).

    Each edge outside the forest gets a value of 64 bits from its ends' hash; a node's value is the exclusive or of those
    at it, so what leaves one side of a forest edge adds up to the values of the edges that lead around it.
    """
    store = Saved(edges.sparkSession)
    e = store.keep(undirected(edges))
    forest, labels = minimum_spanning_forest(e)
    rest = store.keep(e.join(forest.select(*N, "src", "dst"), [*N, "src", "dst"], "left_anti"))
    ends = rest.withColumn("r", F.xxhash64(*N, "src", "dst")).select(*N, F.explode(F.array("src", "dst")).alias("node"), "r")
    tour = euler_tour(forest, labels, ends.groupBy(*N, "node").agg(F.bit_xor("r").alias("x")))
    other = tour.select(*N, F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("after").alias("back"), F.col("acc").alias("acc2"))
    one = tour.where("src < dst").join(other, [*N, "src", "dst"])
    return store.keep(one.select(*N, "component", "src", "dst", "after", "back", F.col("acc").bitwiseXOR(F.col("acc2")).alias("around"))), rest, labels, e


def bridges_at_scale(edges: DataFrame) -> DataFrame:
    """network_id, src, dst (src < dst) of the bridges: forest edges around which nothing leads.

    Wrong only if values of 64 bits cancel by chance. Pairs of edges of equal values are the cuts of two edges.
    """
    return _tours(edges)[0].where("around = 0").select(*N, "src", "dst")


def two_edge_classes(edges: DataFrame) -> DataFrame:
    """network_id, node, class: nodes that stay joined whichever one edge is taken away share a class, its least node's name.

    Nodes of no class of two or more stand for themselves; nodes without edges are not listed.
    """
    whole, _, labels, e = _tours(edges)
    kept = e.join(whole.where("around = 0"), [*N, "src", "dst"], "left_anti")
    _, parts = minimum_spanning_forest(kept)
    named = labels.select(*N, "node").join(parts, [*N, "node"], "left").withColumn("part", F.coalesce("component", "node"))
    return named.withColumn("class", F.min("node").over(Window.partitionBy(*N, "part"))).select(*N, "node", "class")


def _least_and_greatest(spots: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range (network_id, component, node, down, up) of places up .. down: the least lo and greatest hi of spots
    (network_id, component, place, lo, hi) in it. Tables of 1, 2, 4, ... places are made in turn; two cover a range."""
    store, key = Saved(spots.sparkSession), [*N, "component"]
    ranges = store.keep(ranges.withColumn("level", F.floor(F.log2(F.col("down") - F.col("up") + 1)).cast("int")))
    # log2 of a power of two may fall short by rounding: both tables still lie in the range, so mend the level by counting.
    ranges = ranges.withColumn("level", F.col("level") + F.when(F.expr("shiftleft(1L, level + 1) <= down - up + 1"), 1).otherwise(0) - F.when(F.expr("shiftleft(1L, level) > down - up + 1"), 1).otherwise(0))
    most = ranges.agg(F.max("level")).first()[0]
    table, out = store.keep(spots), None
    for k in range((most if most is not None else -1) + 1):
        asked = ranges.where(F.col("level") == k)
        both = asked.select(*key, "node", F.explode(F.array(F.col("up"), F.col("down") - (1 << k) + 1)).alias("place"))
        got = both.join(table, [*key, "place"], "left").groupBy(*key, "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = store.keep(got if out is None else out.unionByName(got))
        if k < most:
            ahead = table.select(*key, (F.col("place") - (1 << k)).alias("place"), "lo", "hi").where("place >= 0")
            wider = store.keep(table.unionByName(ahead).groupBy(*key, "place").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            store.drop(table)
            table = wider
    return out if out is not None else ranges.select(*key, "node", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi")).limit(0)


def blocks_at_scale(edges: DataFrame) -> DataFrame:
    """network_id, src, dst, block for every edge: edges on a common cycle share a block (its name is a node); a bridge is alone.

    Trees are rooted where their tours begin. A place on the tour stands for the node that is entered there. A node's
    edge to its parent joins its parent's block if something in its subtree leads to outside the parent's subtree; two
    nodes of which neither is above the other join by an edge between them. Blocks are the components of these links.
    """
    whole, rest, _, _ = _tours(edges)
    store = Saved(edges.sparkSession)
    down = F.col("after") > F.col("back")
    # Places run backwards (arcs that follow): a node is entered at down and left at up < down; the root holds all.
    tree = whole.select(*N, "component", F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("node"), F.greatest("after", "back").alias("down"), F.least("after", "back").alias("up"))
    tree = store.keep(tree)
    roots = tree.select(*N, "component", F.col("parent").alias("node")).distinct().join(tree.select(*N, "component", "node"), [*N, "component", "node"], "left_anti")
    top = tree.groupBy(*N, "component").agg((F.max("down") + 1).alias("down"))
    nodes = store.keep(tree.select(*N, "component", "node", "down", "up").unionByName(roots.join(top, [*N, "component"]).select(*N, "component", "node", "down", F.lit(-1).cast("long").alias("up"))))
    place = lambda c: nodes.select(*N, F.col("node").alias(c), F.col("down").alias(f"{c}_down"), F.col("up").alias(f"{c}_up"))
    cross = store.keep(rest.join(place("src"), [*N, "src"]).join(place("dst"), [*N, "dst"]))
    seen = cross.select(*N, F.col("src").alias("node"), F.col("dst_down").alias("lo"), F.col("dst_down").alias("hi")).unionByName(cross.select(*N, F.col("dst").alias("node"), F.col("src_down").alias("lo"), F.col("src_down").alias("hi")))
    own = nodes.select(*N, "node", F.col("down").alias("lo"), F.col("down").alias("hi"))
    at = seen.unionByName(own).groupBy(*N, "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(nodes, [*N, "node"])
    reach = _least_and_greatest(at.select(*N, "component", F.col("down").alias("place"), "lo", "hi"), tree.select(*N, "component", "node", "down", "up"))
    links = tree.join(reach, [*N, "component", "node"]).join(place("parent"), [*N, "parent"]).where("parent_up >= 0 and (hi > parent_down or lo < parent_up)").select(*N, F.col("node").alias("src"), F.col("parent").alias("dst"))
    apart = cross.where("src_up > dst_down or dst_up > src_down").select(*N, "src", "dst")
    _, parts = minimum_spanning_forest(links.unionByName(apart))
    named = store.keep(tree.join(parts.withColumnRenamed("component", "block"), [*N, "node"], "left").select(*N, "node", "parent", F.coalesce("block", "node").alias("block")))
    inner = named.select(*N, F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"), "block")
    lower = cross.select(*N, "src", "dst", F.when(F.col("src_down") < F.col("dst_down"), F.col("src")).otherwise(F.col("dst")).alias("node"))
    return inner.unionByName(lower.join(named.select(*N, "node", "block"), [*N, "node"]).select(*N, "src", "dst", "block"))


def cut_vertices_at_scale(edges: DataFrame) -> DataFrame:
    """network_id, node of nodes whose edges lie in two blocks or more."""
    ends = blocks_at_scale(edges).select(*N, F.explode(F.array("src", "dst")).alias("node"), "block")
    return ends.groupBy(*N, "node").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a != b").select(*N, "node")
