"""Making networks robust: the pairs that join their parts, then those that take away bridges and cut vertices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import N, blocks_at_scale, minimum_spanning_forest, undirected
from .lineage import saved

#: A network of at most so many pairs is searched in one group, larger ones in rounds of joins.
GROUP_PAIRS = 50_000


def low_blocks(n: int, ends: np.ndarray) -> np.ndarray:
    """A block's number for each edge of one network of nodes 0 .. n-1: edges on a common cycle share it."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (u, v) in enumerate(ends):
        near[u].append((v, k))
        near[v].append((u, k))
    seen, low, block, held, clock, blocks = [-1] * n, [0] * n, np.zeros(len(ends), np.int64), [], 0, 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        seen[root] = low[root] = clock
        clock += 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, via, rest = stack[-1]
            for v, k in rest:
                if k == via:
                    continue
                if seen[v] < 0:
                    held.append(k)
                    seen[v] = low[v] = clock
                    clock += 1
                    stack.append((v, k, iter(near[v])))
                    break
                if seen[v] < seen[u]:
                    held.append(k)
                    low[u] = min(low[u], seen[v])
            else:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[u])
                    if low[u] >= seen[up]:
                        while True:
                            k = held.pop()
                            block[k] = blocks
                            if k == via:
                                break
                        blocks += 1
    return block


def faults(n: int, ends: np.ndarray, offers: np.ndarray, least: int = 3) -> tuple[tuple, list[tuple]]:
    """What an audit counts against a network, worst first, and against it with each one of the offered edges.

    Components, isolates, bridges, cut vertices, what the least degree lacks of ``least``. An edge between two parts is a
    new bridge and makes cut vertices of ends that had edges and were none; one inside a part takes away the bridges on its
    path in the tree of blocks and cut vertices, and the inner cut vertices there that part just two blocks. Offers are
    no edges yet.
    """
    block = low_blocks(n, ends)
    degree = np.bincount(ends.ravel(), minlength=n) if len(ends) else np.zeros(n, np.int64)
    size = np.bincount(block) if len(ends) else np.zeros(0, np.int64)
    own: list[set] = [set() for _ in range(n)]
    for (u, v), b in zip(ends.tolist(), block.tolist(), strict=True):
        own[u].add(b)
        own[v].add(b)
    near: dict = {}
    for v in range(n):
        if len(own[v]) > 1:
            near[-1 - v] = list(own[v])
            for b in own[v]:
                near.setdefault(b, []).append(-1 - v)
    depth, up, root_of = {}, {}, {}
    for root in [*range(len(size)), *near]:
        if root in depth:
            continue
        depth[root], up[root], root_of[root], stack = 0, None, root, [root]
        while stack:
            x = stack.pop()
            for y in near.get(x, ()):
                if y not in depth:
                    depth[y], up[y], root_of[y] = depth[x] + 1, x, root
                    stack.append(y)
    place = [-1 - v if len(own[v]) > 1 else next(iter(own[v])) if own[v] else None for v in range(n)]
    cuts = sum(len(o) > 1 for o in own)
    alone = int((degree == 0).sum())
    parts, bridges = alone + len({root_of[b] for b in range(len(size))}), int((size == 1).sum())
    lowest = np.sort(degree)[:3].tolist() if n else []
    of = lambda d: max(0, least - min(d, default=least))
    out = []
    for u, v in offers.tolist():
        rest = list(lowest)
        for w in {u, v}:
            if degree[w] in rest:
                rest.remove(degree[w])
        lacks = of([*rest, degree[u] + 1, degree[v] + 1])
        a, b = place[u], place[v]
        if a is None or b is None or root_of[a] != root_of[b]:
            new = sum(x is not None and x >= 0 for x in (a, b))
            out.append((parts - 1, alone - (a is None) - (b is None), bridges + 1, cuts + new, lacks))
            continue
        one, two = [a], [b]
        while one[-1] != two[-1]:
            side = one if depth[one[-1]] >= depth[two[-1]] else two
            side.append(up[side[-1]])
        path = one + two[-2::-1]
        gone = sum(size[x] == 1 for x in path if x >= 0) if a != b else 0
        out.append((parts, alone, bridges - int(gone), cuts - sum(len(near[x]) == 2 for x in path[1:-1] if x < 0), lacks))
    return (parts, alone, bridges, cuts, of(lowest)), out


def by_size(edges: DataFrame, group_pairs: int, grouped, in_rounds) -> DataFrame:
    """``grouped`` over the networks of at most ``group_pairs`` pairs, ``in_rounds`` over the larger ones, if there are any."""
    sizes = edges.groupBy(*N).agg(F.count("*").alias("pairs"))
    large = sizes.where(F.col("pairs") > group_pairs).select(*N)
    if large.isEmpty():
        return grouped(edges)
    return grouped(edges.join(large, N, "left_anti")).unionByName(in_rounds(saved(edges.join(large, N, "left_semi"))))


def blocks(edges: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """network_id, src, dst, block for every pair once, src < dst; a block's name is one of its network's nodes."""
    kinds = dict(edges.dtypes)

    def run(pdf):
        codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        found = low_blocks(len(names), np.stack([codes[: len(pdf)], codes[len(pdf) :]], 1))
        least = pdf["src"].groupby(found).transform("min").to_numpy()
        # Two blocks may share their least source; its least end then tells them apart as src alone cannot.
        first = pd.Series(np.arange(len(pdf)), index=pdf.index).groupby(found).transform("min").to_numpy()
        return pdf.assign(block=least, part=first)[["network_id", "src", "dst", "block", "part"]]

    schema = f"network_id {kinds['network_id']}, src {kinds['src']}, dst {kinds['src']}, block {kinds['src']}, part long"
    large = lambda e: blocks_at_scale(e).withColumn("part", F.lit(0).cast("long"))
    return by_size(saved(undirected(edges)), group_pairs, lambda e: e.groupBy(*N).applyInPandas(run, schema), large)


def _greedy(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """The pairs to add to one network, from the tree of its blocks and cut vertices, and the faults each takes away."""
    cuts: dict = {}
    parts: dict = {}
    for x, y, bridge in pdf.loc[pdf["role"] == "tree", ["x", "y", "bridge"]].itertuples(index=False):
        cuts.setdefault(x, set()).add(y)
        parts.setdefault(y, [set(), int(bridge)])[0].add(x)
    offers = sorted(((int(d), s, t, x, y) for d, s, t, x, y in pdf.loc[pdf["role"] == "offer", ["days", "src", "dst", "x", "y"]].itertuples(index=False)), key=lambda o: o[:3])
    out, alias = [], {}

    def now(x):
        while x in alias:
            x = alias[x]
        return x

    while offers and len(out) < most:
        depth, up = {}, {}
        for root in parts:
            if root in depth:
                continue
            depth[root], up[root], stack = 0, None, [root]
            while stack:
                v = stack.pop()
                for w in parts[v][0] if v in parts else cuts[v]:
                    if w not in depth:
                        depth[w], up[w] = depth[v] + 1, v
                        stack.append(w)
        best, left = None, []
        for o in offers:
            a, b = now(o[3]), now(o[4])
            if a == b or a not in depth or b not in depth:
                continue
            left.append(o)
            one, two = [a], [b]
            while one[-1] != two[-1]:
                side = one if depth[one[-1]] >= depth[two[-1]] else two
                if up[side[-1]] is None:
                    break
                side.append(up[side[-1]])
            if one[-1] != two[-1]:  # of different parts: it would be a new bridge
                continue
            path = one + two[-2::-1]
            bridges = sum(parts[v][1] for v in path if v in parts)
            freed = sum(len(cuts[v]) == 2 for v in path[1:-1] if v in cuts)
            if 10 * bridges + freed > 0 and (best is None or (10 * bridges + freed, -o[0]) > best[:2]):
                best = (10 * bridges + freed, -o[0], o, path, bridges, freed)
        offers = left
        if best is None:
            break
        gain, _, o, path, bridges, freed = best
        out.append((o[1], o[2], o[0], "remove_bridge" if gain >= 10 else "reduce_articulation", bridges, freed))
        merged = [v for v in path if v in parts]
        whole = merged[0]
        for v in merged[1:]:
            parts[whole][0] |= parts.pop(v)[0]
            alias[v] = whole
        parts[whole][1] = 0
        for c in list(parts[whole][0]):
            cuts[c] = {now(p) for p in cuts[c]}
            if len(cuts[c]) == 1:
                parts[whole][0].discard(c)
                del cuts[c]
                alias[c] = whole
        offers = [x for x in offers if x is not o]
    return pd.DataFrame(out, columns=["src", "dst", "days", "role", "bridges", "freed"])


def connect_and_debridge(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, most: int = 30, base_days: int = 36, connect_days: int = 120, most_connect: int = 20, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """Pairs to add so that each network is connected and has no bridges: network_id, src, dst, days, role, step, and what is left.

    candidates: network_id, src, dst, days; those over ``base_days`` up to ``connect_days`` that are no pairs yet are offered.
    First the shortest that join two parts, ties by dates, until there is one part, none joins, or ``most_connect`` are
    added: the least edges of a spanning forest over the parts. Then, a pair at a time, the one that takes away most, a
    bridge counting as ten cut vertices, the shorter of equals, until nothing helps or ``most`` are added in all. A pair
    takes away what lies on its path in the tree of blocks and cut vertices: all bridges, and the inner cut vertices that
    part just two blocks; so nothing is searched anew for each offer, and only this tree and one offer for each two of its
    places come together in a group. Larger networks find their blocks in rounds (see by_size). bridges_left,
    cut_vertices_left and components_left tell what remains; a network without additions has one row of step 0. Roles:
    connect_components, remove_bridge, reduce_articulation.
    """
    e = saved(undirected(edges))
    offered = undirected(candidates.where((F.col("days") > base_days) & (F.col("days") <= connect_days)), "days")
    offered = saved(offered.join(e, [*N, "src", "dst"], "left_anti"))
    known = nodes.select(*N, "node").distinct()
    _, labels = minimum_spanning_forest(e)
    part = saved(known.join(labels, [*N, "node"], "left").select(*N, "node", F.coalesce("component", "node").alias("part")))
    at = lambda c: part.select(*N, F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    across = offered.join(at("src"), [*N, "src"]).join(at("dst"), [*N, "dst"]).where("src_part != dst_part")
    joining, _ = minimum_spanning_forest(across.select(*N, F.col("src_part").alias("src"), F.col("dst_part").alias("dst"), F.struct("days", "src", "dst").alias("pick")), "pick")
    order = Window.partitionBy(*N).orderBy("days", "src", "dst")
    joined = joining.select(*N, "w.src", "w.dst", "w.days").withColumn("step", F.row_number().over(order)).where(F.col("step") <= min(most_connect, most))
    joined = saved(joined.withColumn("role", F.lit("connect_components")))

    found = saved(blocks(e.unionByName(joined.select(*N, "src", "dst")), group_pairs))
    sizes = found.groupBy(*N, "block", "part").agg((F.count("*") == 1).alias("bridge"))
    places = found.select(*N, F.explode(F.array("src", "dst")).alias("node"), "block", "part").distinct()
    many = places.groupBy(*N, "node").agg(F.count("*").alias("k"), F.min(F.struct("block", "part")).alias("own"))
    # A place of the tree is a cut vertex (part -1) or a block.
    place = many.select(*N, "node", F.when(F.col("k") > 1, F.struct(F.col("node").alias("block"), F.lit(-1).cast("long").alias("part"))).otherwise(F.col("own")).alias("place"))
    place = saved(place)
    told = lambda c: place.select(*N, F.col("node").alias(c), F.col("place").cast("string").alias({"src": "x", "dst": "y"}[c]))
    offers = offered.join(joined, [*N, "src", "dst"], "left_anti").join(told("src"), [*N, "src"]).join(told("dst"), [*N, "dst"]).where("x != y")
    offers = offers.groupBy(*N, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("days", "src", "dst")).alias("o"))
    offers = offers.select(*N, F.lit("offer").alias("role"), "x", "y", F.lit(False).alias("bridge"), "o.days", "o.src", "o.dst", F.lit(0).alias("joined"))
    blank = {c: F.lit(None).cast(dict(offered.dtypes)[c]).alias(c) for c in ("days", "src", "dst")}
    tree = places.join(place.where("place.part = -1"), [*N, "node"]).join(sizes, [*N, "block", "part"])
    tree = tree.select(*N, F.lit("tree").alias("role"), F.col("place").cast("string").alias("x"), F.struct("block", "part").cast("string").alias("y"), "bridge", *blank.values(), F.lit(0).alias("joined"))
    count = joined.groupBy(*N).agg(F.count("*").cast("int").alias("joined"))
    size = count.select(*N, F.lit("size").alias("role"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"), F.lit(False).alias("bridge"), *blank.values(), "joined")
    kinds = dict(offered.dtypes)

    def run(pdf):
        taken = int(pdf["joined"].sum())
        out = _greedy(pdf, most - taken)
        out.insert(0, "network_id", pdf["network_id"].iloc[0])
        return out.assign(step=np.arange(taken + 1, taken + 1 + len(out)))

    added = offers.unionByName(tree).unionByName(size).groupBy(*N).applyInPandas(run, f"network_id {kinds['network_id']}, src {kinds['src']}, dst {kinds['src']}, days {kinds['days']}, role string, bridges int, freed int, step int")
    added = saved(added)
    weak = sizes.groupBy(*N).agg(F.sum(F.col("bridge").cast("int")).alias("b")).join(many.groupBy(*N).agg(F.sum((F.col("k") > 1).cast("int")).alias("c")), N)
    gone = added.groupBy(*N).agg(F.sum("bridges").alias("gb"), F.sum("freed").alias("gc"))
    parts = part.groupBy(*N).agg(F.count_distinct("part").alias("parts"))
    left = parts.join(weak, N, "left").join(gone, N, "left").join(count, N, "left").na.fill(0, ["b", "c", "gb", "gc", "joined"])
    left = left.select(*N, (F.col("b") - F.col("gb")).cast("int").alias("bridges_left"), (F.col("c") - F.col("gc")).cast("int").alias("cut_vertices_left"), (F.col("parts") - F.col("joined")).cast("int").alias("components_left"))
    pairs = joined.select(*N, "src", "dst", "days", "role", "step").unionByName(added.drop("bridges", "freed"))
    out = left.join(pairs, N, "left")
    return out.select(*N, "src", "dst", F.col("days").cast("long").alias("days"), "role", F.coalesce("step", F.lit(0)).alias("step"), "bridges_left", "cut_vertices_left", "components_left")
