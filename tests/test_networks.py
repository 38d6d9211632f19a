"""Networks of any size against low links and plain search."""

import random

import numpy as np
from groundmesh.operators import forest, graph, robust

SCHEMA = "network_id string, src long, dst long"


def random_networks(seed, networks=12):
    r, rows = random.Random(seed), []
    for k in range(networks):
        n = r.randint(2, 40)
        shape = k % 4
        for _ in range(r.randint(1, int(n * r.choice([0.6, 1.1, 1.8])))):
            a = r.randrange(n)
            b = (a + 1) % n if shape == 0 else min(n - 1, a + r.randint(1, 3)) if shape == 1 else 0 if shape == 2 and r.random() < 0.6 else r.randrange(n)
            rows.append((f"n{k}", a * 7 % 97, b * 7 % 97))  # loops and repeats among them
    return rows


def by_network(rows):
    out = {}
    for k, a, b in rows:
        out.setdefault(k, set()).add((min(a, b), max(a, b)))
    return {k: sorted(e for e in v if e[0] != e[1]) for k, v in out.items()}


def low(edges):
    names = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(names)}
    parts, found, cuts = graph.low_links(len(names), np.array([(place[a], place[b]) for a, b in edges], dtype=np.int64).reshape(-1, 2))
    return {edges[k] for k in found}, {names[v] for v in cuts}


def classes(edges, gone=()):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        if e not in gone:
            a, b = sorted((top(e[0]), top(e[1])))
            root[b] = a
    return {x: top(x) for x in root}


def test_bridges_and_blocks_of_any_size(spark):
    rows = random_networks(1)
    edges, plain = spark.createDataFrame(rows, SCHEMA), by_network(rows)
    want = {k: low(v) for k, v in plain.items()}
    assert {tuple(r) for r in forest.bridges_at_scale(edges).collect()} == {(k, *e) for k, (b, _) in want.items() for e in b}
    assert {tuple(r) for r in forest.cut_vertices_at_scale(edges).collect()} == {(k, v) for k, (_, c) in want.items() for v in c}
    got = {(r["network_id"], r["node"]): r["class"] for r in forest.two_edge_classes(edges).collect()}
    assert got == {(k, x): c for k, v in plain.items() for x, c in classes(v, want[k][0]).items()}
    blocks = forest.blocks_at_scale(edges).collect()
    assert sorted((r[0], r[1], r[2]) for r in blocks) == sorted((k, *e) for k, v in plain.items() for e in v)
    shared = lambda found: sorted(sorted(v) for v in found.values())
    one, two = {}, {}
    for r in blocks:
        one.setdefault((r[0], r[3]), []).append((r[0], r[1], r[2]))
    for r in robust.blocks(edges).collect():
        two.setdefault((r[0], r[3], r[4]), []).append((r[0], r[1], r[2]))
    assert shared(one) == shared(two)


def test_minimum_spanning_forest(spark):
    r = random.Random(4)
    rows = [(k, a, b, r.choice([None, 1, 2, 3, 9])) for k, a, b in random_networks(3)]
    tree, labels = forest.minimum_spanning_forest(spark.createDataFrame(rows, SCHEMA + ", days int"), "days")
    least = {}
    for k, a, b, w in rows:
        if a != b:
            key = (k, min(a, b), max(a, b))
            old = least.get(key, w)
            least[key] = w if old is None else old if w is None else min(old, w)
    root, want = {}, set()
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for (k, a, b), w in sorted(least.items(), key=lambda x: (x[0][0], x[1] is not None, x[1] or 0, x[0])):
        if top((k, a)) != top((k, b)):
            root[top((k, a))] = top((k, b))
            want.add((k, a, b, w))
    assert {tuple(x) for x in tree.collect()} == want
    got = {(x[0], x[1]): x[2] for x in labels.collect()}
    assert len({(k, c) for (k, _), c in got.items()}) == len({top(x) for x in got}) and all(top(x) == top((x[0], c)) for x, c in got.items())


def test_no_edges(spark):
    none = spark.createDataFrame([("a", 1, 1)], SCHEMA)
    for f in (forest.bridges_at_scale, forest.cut_vertices_at_scale, forest.two_edge_classes, forest.blocks_at_scale):
        assert f(none).collect() == []


def plain_additions(nodes, edges, candidates, most, most_connect, base, longest):
    """The rule taken literally: every offer is tried by a new search of the whole network."""
    edges, out = set(edges), []
    offers = sorted((d, a, b) for (a, b), d in candidates.items() if base < d <= longest and (a, b) not in edges)
    count = lambda es: len({c for c in classes(sorted(es) + [(x, x) for x in nodes]).values()})
    for _ in range(min(most_connect, most)):
        joins = [o for o in offers if (o[1], o[2]) not in edges and count(edges | {o[1:]}) < count(edges)]
        if not joins:
            break
        edges.add(joins[0][1:])
        out.append((*joins[0][1:], joins[0][0], "connect_components"))
    while len(out) < most:
        b, c = low(sorted(edges)) if edges else (set(), set())
        best = None
        for o in offers:
            if o[1:] in edges:
                continue
            nb, nc = low(sorted(edges | {o[1:]}))
            gain = 10 * (len(b) - len(nb)) + len(c) - len(nc)
            if gain > 0 and (best is None or (gain, -o[0]) > (best[0], -best[1][0])):
                best = gain, o
        if best is None:
            break
        edges.add(best[1][1:])
        out.append((*best[1][1:], best[1][0], "remove_bridge" if best[0] >= 10 else "reduce_articulation"))
    b, c = low(sorted(edges)) if edges else (set(), set())
    return out, len(b), len(c), count(edges)


def test_connect_and_debridge_by_brute_force(spark):
    r, want, rows = random.Random(8), {}, {"node": [], "edge": [], "offer": []}
    for k in range(25):
        name, n = f"n{k:02d}", r.randint(1, 13)
        nodes, edges = range(n), {(a, a + 1) for a in range(n - 1) if r.random() < 0.7} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 3)) if n > 1}
        offers = {(a, b): r.randint(30, 130) for a in range(n) for b in range(a + 1, n) if r.random() < 0.4}
        want[name] = plain_additions(nodes, edges, offers, 4 if k % 3 == 0 else 30, 2 if k % 4 == 0 else 20, 36, 120) if k % 3 or k % 4 else plain_additions(nodes, edges, offers, 30, 20, 36, 120)
        rows["node"] += [(name, x) for x in nodes]
        rows["edge"] += [(name, *e) for e in edges]
        rows["offer"] += [(name, b, a, d) for (a, b), d in offers.items()]
    nodes, edges = spark.createDataFrame(rows["node"], "network_id string, node long"), spark.createDataFrame(rows["edge"], SCHEMA)
    offers = spark.createDataFrame(rows["offer"], SCHEMA + ", days int")
    for most, caps, chosen in ((30, 20, lambda k: (k % 3 and k % 4) or not (k % 3 or k % 4)), (4, 20, lambda k: k % 3 == 0 and k % 4), (30, 2, lambda k: k % 4 == 0 and k % 3)):
        names = [f"n{k:02d}" for k in range(25) if chosen(k)]
        got = graph.connect_and_debridge(nodes.where(nodes.network_id.isin(names)), edges.where(edges.network_id.isin(names)), offers.where(offers.network_id.isin(names)), most=most, most_connect=caps).collect()
        for name in names:
            mine = sorted((r for r in got if r["network_id"] == name), key=lambda r: r["step"])
            pairs, b, c, parts = want[name]
            assert [(r["src"], r["dst"], r["days"], r["role"]) for r in mine if r["step"]] == pairs, name
            assert {(r["bridges_left"], r["cut_vertices_left"], r["components_left"]) for r in mine} == {(b, c, parts)}, name


def test_faults_with_each_offer():
    r = random.Random(11)
    for _ in range(300):
        n = r.randint(1, 10)
        every = [(a, b) for a in range(n) for b in range(a + 1, n)]
        ends = r.sample(every, r.randint(0, len(every))) if r.random() < 0.5 else r.sample(every, min(len(every), n - 1))
        offers = [e for e in every if e not in ends]

        def plain(es):
            parts, found, cuts = graph.low_links(n, np.array(es, dtype=np.int64).reshape(-1, 2))
            degree = [sum(v in e for e in es) for v in range(n)]
            return parts, degree.count(0), len(found), len(cuts), max(0, 3 - min(degree))

        now, then = robust.faults(n, np.array(ends, dtype=np.int64).reshape(-1, 2), np.array(offers, dtype=np.int64).reshape(-1, 2))
        assert now == plain(ends) and then == [plain([*ends, e]) for e in offers]
