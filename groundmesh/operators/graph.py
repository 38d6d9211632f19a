"""Pair networks as graphs; many networks are handled in one job through network_id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import blocks_at_scale, bridges_at_scale, cut_vertices_at_scale, minimum_spanning_forest, two_edge_classes, undirected  # noqa: F401
from .lineage import Saved, saved
from .pairs import gap_days
from .robust import GROUP_PAIRS, blocks, by_size, connect_and_debridge, faults  # noqa: F401

N = ["network_id"]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """network_id, node, component: the least node that paths reach. Isolated nodes are their own component.

    Components join by their least edges, so rounds grow with the logarithm of a component, and pairs inside one are
    dropped as soon as it has formed.
    """
    _, labels = minimum_spanning_forest(edges)
    named = nodes.select(*N, "node").join(labels, [*N, "node"], "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy(*N, "part").agg(F.min("node").alias("component"))
    return saved(named.drop("component").join(least, [*N, "part"]).select(*N, "node", "component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """network_id, node, degree; isolates count 0."""
    ends = edges.select(*N, F.explode(F.array("src", "dst")).alias("node")).groupBy(*N, "node").agg(F.count("*").alias("degree"))
    return nodes.join(ends, [*N, "node"], "left").select(*N, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(*N, F.explode(F.array("src", "dst")).alias("node")).distinct(), [*N, "node"], "left_anti")


def low_links(n: int, ends: np.ndarray) -> tuple[int, list[int], set[int]]:
    """(components, numbers of bridges, cut vertices) of one network of nodes 0 .. n-1, by one depth-first pass."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (u, v) in enumerate(ends):
        near[u].append((v, k))
        near[v].append((u, k))
    seen, low, parts, found, cuts, clock = [-1] * n, [0] * n, 0, [], set(), 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        parts, branches, stack = parts + 1, 0, [(root, -1, iter(near[root]))]
        seen[root] = low[root] = clock
        clock += 1
        while stack:
            u, via, rest = stack[-1]
            for v, k in rest:
                if k == via:
                    continue
                if seen[v] >= 0:
                    low[u] = min(low[u], seen[v])
                    continue
                seen[v] = low[v] = clock
                clock += 1
                stack.append((v, k, iter(near[v])))
                break
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[u])
                    if low[u] > seen[up]:
                        found.append(via)
                    if up == root:
                        branches += 1
                    elif low[u] >= seen[up]:
                        cuts.add(up)
        if branches > 1:
            cuts.add(root)
    return parts, found, cuts


def weak_points(edges: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """network_id, kind, src, dst, k: each network's bridges (src, dst), cut vertices (src), and size of a spanning forest (k).

    A network of at most ``group_pairs`` pairs is a group of its own, searched by low links, so many networks spread over
    tasks. Larger ones are never gathered: forests, tours and blocks are made in rounds of joins (forest.py).
    """
    node, kind = dict(edges.dtypes)["src"], dict(edges.dtypes)["network_id"]

    def run(pdf):
        codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        ends = np.stack([codes[: len(pdf)], codes[len(pdf) :]], 1)
        parts, cut, split = low_links(len(names), ends)
        rows = [("bridge", pdf["src"].iloc[k], pdf["dst"].iloc[k], 0) for k in cut] + [("cut", names[v], None, 0) for v in sorted(split)] + [("forest", None, None, len(names) - parts)]
        out = pd.DataFrame(rows, columns=["kind", "src", "dst", "k"])
        out.insert(0, "network_id", pdf["network_id"].iloc[0])
        return out

    def in_rounds(e):
        found = saved(blocks_at_scale(e))
        alone = found.withColumn("n", F.count("*").over(Window.partitionBy(*N, "block"))).where("n = 1")
        ends = found.select(*N, F.explode(F.array("src", "dst")).alias("src"), "block").groupBy(*N, "src").agg(F.min("block").alias("a"), F.max("block").alias("b"))
        forest, _ = minimum_spanning_forest(e)
        none, zero = F.lit(None).cast(node), F.lit(0).cast("long").alias("k")
        out = alone.select(*N, F.lit("bridge").alias("kind"), "src", "dst", zero).unionByName(ends.where("a != b").select(*N, F.lit("cut").alias("kind"), "src", none.alias("dst"), zero))
        return out.unionByName(forest.groupBy(*N).agg(F.count("*").alias("k")).select(*N, F.lit("forest").alias("kind"), none.alias("src"), none.alias("dst"), "k"))

    return by_size(saved(undirected(edges)), group_pairs, lambda e: e.groupBy(*N).applyInPandas(run, f"network_id {kind}, kind string, src {node}, dst {node}, k long"), in_rounds)


def bridges(nodes: DataFrame, edges: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Edges whose removal splits a component; those of networks beyond ``group_pairs`` by sums around forest edges."""
    few = lambda e: weak_points(e).where("kind = 'bridge'").select(*N, "src", "dst")
    return by_size(saved(undirected(edges)), group_pairs, few, bridges_at_scale)


def cut_vertices(nodes: DataFrame, edges: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Nodes whose removal splits their component; leaves and isolates never do."""
    few = lambda e: weak_points(e).where("kind = 'cut'").select(*N, F.col("src").alias("node"))
    return by_size(saved(undirected(edges)), group_pairs, few, cut_vertices_at_scale)


def audit_network(nodes: DataFrame, edges: DataFrame, min_degree: int = 3, max_gap: int = 48) -> DataFrame:
    """One row for each network: sizes, degree figures, faults, the largest gap, and acceptance.

    Accepted: one component, no isolates, bridges or cut vertices, least degree and largest gap within limits. Nodes
    are dates.
    """
    deg = degrees(nodes, edges).groupBy(*N).agg(
        F.count("*").alias("nodes"), F.min("degree").alias("degree_min"), F.avg("degree").alias("degree_mean"),
        F.percentile("degree", F.lit(0.5)).alias("degree_median"), F.max("degree").alias("degree_max"), F.sum(F.expr("cast(degree = 0 as int)")).alias("isolates"),
    )
    size = edges.groupBy(*N).agg(F.count("*").alias("edges"))
    gaps = gap_days(nodes.select(*N, F.col("node").alias("date")), N).groupBy(*N).agg(F.coalesce(F.max("gap_days"), F.lit(0)).alias("max_gap"))
    weak = weak_points(edges).groupBy(*N).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(c) for k, c in (("bridge", "bridges"), ("cut", "cut_vertices"))], F.sum("k").alias("forest"))
    out = deg.join(size, N, "left").join(weak, N, "left").join(gaps, N, "left").na.fill(0, ["edges", "bridges", "cut_vertices", "forest"])
    out = out.withColumn("components", F.col("nodes") - F.col("forest")).drop("forest")
    fine = (F.col("components") == 1) & (F.col("isolates") == 0) & (F.col("bridges") == 0) & (F.col("cut_vertices") == 0)
    return out.withColumn("accepted", fine & (F.col("degree_min") >= min_degree) & (F.col("max_gap") <= max_gap))


def compare_networks(nodes: DataFrame, full: DataFrame, curated: DataFrame) -> DataFrame:
    """Each node's degree before and after curation, its loss, and whether it is newly isolated."""
    a = degrees(nodes, full).withColumnRenamed("degree", "full_degree")
    b = degrees(nodes, curated).withColumnRenamed("degree", "curated_degree")
    out = a.join(b, [*N, "node"])
    return out.withColumn("loss", F.col("full_degree") - F.col("curated_degree")).withColumn("newly_isolated", (F.col("full_degree") > 0) & (F.col("curated_degree") == 0))


def k_core_prune(nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """The nodes left once those of degree under k are dropped again and again."""
    store = Saved(nodes.sparkSession)
    nodes, edges = store.keep(nodes.select(*N, "node")), store.keep(edges.select(*N, "src", "dst"))
    while True:
        keep = store.keep(degrees(nodes, edges).where(F.col("degree") >= k).select(*N, "node"))
        if keep.count() == nodes.count():
            return keep
        left = store.keep(edges.join(keep.withColumnRenamed("node", "src"), [*N, "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), [*N, "dst"], "left_semi"))
        store.drop(nodes, edges)
        nodes, edges = keep, left


def _by_network(nodes: DataFrame, kept: DataFrame, offered: DataFrame, extra: dict[str, str], run, schema: str) -> DataFrame:
    """``run(nodes, kept pairs, offered pairs)`` for each network, as positions of its nodes in order."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in extra.items()]
    rows = nodes.select(*N, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit("node").alias("role"), *blank).distinct()
    rows = rows.unionByName(kept.select(*N, "src", "dst", F.lit("kept").alias("role"), *blank).distinct())
    rows = rows.unionByName(offered.select(*N, "src", "dst", F.lit("offered").alias("role"), *extra))

    def one(pdf):
        names = np.sort(pdf.loc[pdf["role"] == "node", "src"].unique())
        place = {x: k for k, x in enumerate(names)}
        part = {r: pdf[pdf["role"] == r] for r in ("kept", "offered")}
        ends = {r: np.array([(place[a], place[b]) for a, b in zip(x["src"], x["dst"], strict=True)], dtype=np.int64).reshape(-1, 2) for r, x in part.items()}
        out = run(names, ends["kept"], ends["offered"], part["offered"])
        out.insert(0, "network_id", pdf["network_id"].iloc[0])
        return out

    return rows.groupBy(*N).applyInPandas(one, f"network_id {dict(nodes.dtypes)['network_id']}, {schema}")


def repair_network(nodes: DataFrame, kept: DataFrame, dropped: DataFrame, max_gap: int = 48) -> DataFrame:
    """Restore dropped pairs of each network, one a round, until it is accepted or no pair makes it better.

    Gives network_id, src, dst, round, and accepted, the audit's verdict at the end; a network to which nothing is
    restored has one row without a pair, of round 0. The best trial of a round has the fewest components, then isolates,
    bridges, cut vertices, then what the least degree lacks of 3; ties by score (a column of dropped, larger first), then by
    dates. A network is a group of its own.
    """

    def run(names, ends, offers, frame):
        gap = max((int((b - a).days) for a, b in zip(names, names[1:], strict=False)), default=0)
        order = np.lexsort((offers[:, 1], offers[:, 0], -frame["score"].to_numpy(dtype=float))) if len(offers) else []
        have = {tuple(sorted(e)) for e in ends.tolist()}
        ends = np.array(sorted(e for e in have if e[0] != e[1]), dtype=np.int64).reshape(-1, 2)
        left = [e for e in dict.fromkeys(tuple(sorted(offers[k].tolist())) for k in order) if e not in have and e[0] != e[1]]
        rows = []
        now, trials = faults(len(names), ends, np.array(left, dtype=np.int64).reshape(-1, 2))
        while left and not (now[0] == 1 and not any(now[1:])):
            best = min(range(len(left)), key=lambda k: trials[k])
            if trials[best] >= now:
                break
            e = left.pop(best)
            ends = np.vstack([ends, e])
            rows.append((names[e[0]], names[e[1]], len(rows) + 1))
            now, trials = faults(len(names), ends, np.array(left, dtype=np.int64).reshape(-1, 2))
        fine = now[0] == 1 and not any(now[1:]) and gap <= max_gap
        out = pd.DataFrame(rows or [(None, None, 0)], columns=["src", "dst", "round"])
        return out.assign(accepted=fine)

    node = dict(nodes.dtypes)["node"]
    return _by_network(nodes, kept, dropped, {"score": "double"}, run, f"src {node}, dst {node}, round int, accepted boolean")


def edge_influence(edges: DataFrame) -> DataFrame:
    """Rank and percentile of each flagged edge's quality in its network, and whether it is weak (under .30).

    edges: network_id, src, dst, quality, flagged.
    """
    w = Window.partitionBy(*N)
    ranked = edges.withColumn("rank", F.row_number().over(w.orderBy("quality", "src", "dst"))).withColumn("pct", 100 * F.col("rank") / F.count("*").over(w))
    return ranked.where("flagged").select(*N, "src", "dst", "quality", "rank", "pct", (F.col("quality") < 0.3).alias("weak"))
