import random

from pyspark.sql import functions as F

from assetloom.operators import traversal
from assetloom.plans import durable, pointers


def rounds(monkeypatch):
    """Frames written by the pointer plans."""
    made, real = [], pointers.saved
    monkeypatch.setattr(pointers, "saved", lambda df: made.append(1) or real(df))
    return made


def test_chain_of_ten_thousand(spark, monkeypatch):
    made, n = rounds(monkeypatch), 10_000
    chain = spark.range(n).selectExpr("concat('n', id + 1) as node", "concat('n', id) as up", "id = 0 as top", "id % 3000 = 0 as gate", "'in' as branch")
    far = {r.node: (r.hit, r.dist) for r in pointers.nearest(chain, F.col("top")).where(f"node in ('n{n}', 'n1')").collect()}
    assert far == {f"n{n}": ("n0", n), "n1": ("n0", 1)} and len(made) <= 16
    made.clear()
    root = spark.createDataFrame([(f"n{n}",), ("n5",)], "root string")
    up = traversal.tree_path(chain.select("node", F.col("up").alias("parent")), root)
    assert up.count() == n + 1 + 6 and up.agg(F.min("ord")).first()[0] == -n
    edges = chain.select(F.col("up").alias("src"), F.col("node").alias("dst"), F.lit("in").alias("type"), F.lit(1).alias("k"))
    nodes = spark.range(n + 1).selectExpr("concat('n', id) as node", "if(id % 3000 = 0, 'gate', 'plain') as type")
    gates = traversal.visibility_gates(edges, nodes, root, {"in": 0}, "gate").collect()
    assert sorted((r.root, r.ord, r.gate) for r in gates) == sorted([("n10000", n - 3000 * i, f"n{3000 * i}") for i in range(4)] + [("n5", 5, "n0")])
    assert [tuple(r) for r in traversal.nearest_ancestor(edges, nodes, root, "gate").orderBy("root").collect()] == [("n10000", "n9000", 1000), ("n5", "n0", 5)]


def test_random_pointers_with_cycles(spark):
    rng = random.Random(3)
    up = {i: rng.choice([None, *range(60)]) for i in range(60)}
    marked = {i for i in range(60) if rng.random() < 0.1}
    frame = spark.createDataFrame([(i, u, u in marked) for i, u in up.items() if u is not None], "node long, up long, mark boolean")

    def way(i):
        out, seen, at, d = [(i, 0)], {i}, up[i], 1
        while at is not None and at not in seen:
            out.append((at, d))
            seen.add(at)
            at, d = up[at], d + 1
        return out, (at, d)

    got = {r.node: (r.hit, r.dist) for r in pointers.nearest(frame, F.col("mark")).collect()}
    for i in up:
        path, (closing, d) = way(i)
        want = next(((a, k) for a, k in path[1:] if a in marked), (closing, d) if closing == i and i in marked else None)
        assert got.get(i) == want, i
    starts = spark.createDataFrame([(i, i) for i in up], "root long, node long")
    got = {}
    for r in pointers.ancestors(frame, starts).collect():
        got.setdefault(r.root, []).append((r.node, r.dist))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(way(i)[0]) for i in up}


def test_preorder(spark):
    rng, rows, want = random.Random(4), [], {}
    for tree in range(6):
        below = {None: []}
        for i in range(rng.choice([1, 2, 40])):
            parent = rng.choice([*below]) if i else None
            below[i] = []
            below[parent].append((rng.randint(0, 3), i))
            rows.append((tree, i, parent, below[parent][-1][0]))
        out = []

        def visit(i):
            out.append(i)
            for _, c in sorted(below[i]):
                visit(c)

        for _, top in sorted(below[None]):
            visit(top)
        want.update({(tree, i): k for k, i in enumerate(out)})
    rows += [(0, 900, 901, 0), (0, 901, 900, 0), (1, 800, 799, 0), (1, 801, 800, 1)]  # a cycle, and nodes below one that isn't there
    frame = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, ord int")
    got = {(r.tree_id, r.node_id): r.first for r in pointers.preorder(frame).collect()}
    assert got == want
    chain = spark.range(10_000).selectExpr("1 as tree_id", "10000 - id as node_id", "if(id = 0, null, 10001 - id) as parent_id", "0 as ord", "if(id > 7000, 'call', 'x') as kind")
    assert [tuple(r) for r in traversal.first_of_kind_in_tree(chain, ["call"]).collect()] == [(1, 10000 - 7001)]
    assert durable.saved(pointers.preorder(chain)).where("last = 9999 and first = 10000 - node_id").count() == 10_000


def test_sets_of_members(spark):
    """Bits along random steps with cycles against a walk from each member; blocks of over 64 members take several words."""
    from assetloom.plans import reach

    rng = random.Random(6)
    steps = {(rng.randrange(80), rng.randrange(80)) for _ in range(120)}
    starts = [(f"r{i}", rng.randrange(80)) for i in range(300)]
    want = set()
    for member, node in starts:
        met, todo = set(), [node]
        while todo:
            at = todo.pop()
            if at not in met:
                met.add(at)
                todo += [b for a, b in steps if a == at]
        want |= {(x, member) for x in met}
    sets, numbers = reach.reach(spark.createDataFrame(sorted(steps), "src long, dst long"), spark.createDataFrame(starts, "member string, node long"))
    got = reach.members_of(sets, numbers, "node").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and sets.count() < len(want) / 5
    assert numbers.groupBy("word", "bit").count().where("count > 1").isEmpty()


def test_implied_edges_of_chains_trees_and_cycles(spark):
    from assetloom.operators import graph

    rng = random.Random(8)
    schema = "type string, src string, dst string, k long"
    for shape in ("tree", "graph"):
        steps = [("next", f"n{i}" if rng.random() < 0.5 else f"n{rng.randrange(i + 1)}", f"n{i + 1}", i) for i in range(40)]
        steps += [("next", "x", "y", 50), ("next", "y", "x", 51)] + [("next", f"n{rng.randrange(41)}", f"n{rng.randrange(41)}", 60 + i) for i in range(12 if shape == "graph" else 0)]
        names = [f"n{i}" for i in range(41)] + ["x", "y", "z"]
        calls = [("calls", a, b, i) for i, (a, b) in enumerate({(rng.choice(names), rng.choice(names)) for _ in range(300)} | {("x", "y"), ("z", "x")})]
        reached = {}
        for n in names:
            met, todo = set(), [d for _, s, d, _ in steps if s == n]
            while todo:
                at = todo.pop()
                if at not in met:
                    met.add(at)
                    todo += [d for _, s, d, _ in steps if s == at]
            reached[n] = met - {n}
        got = graph.drop_implied_edges(spark.createDataFrame(steps + calls, schema), ["next"], ["calls"]).where("type = 'calls'").collect()
        assert {(r.src, r.dst) for r in got} == {(a, b) for _, a, b, _ in calls if b not in reached[a]}


def test_implied_edges_of_one_long_chain(spark):
    """A hundred thousand steps of one owner: the closure would have five thousand million rows."""
    from assetloom.operators import graph

    n = 100_000
    steps = spark.range(n).selectExpr("'next' as type", "concat('n', id) as src", "concat('n', id + 1) as dst", "id as k")
    calls = spark.range(n).selectExpr("'calls' as type", "concat('n', id) as src", f"concat('n', (id * 7919 + 13) % {n}) as dst", "id as k")
    got = graph.drop_implied_edges(steps.unionByName(calls), ["next"], ["calls"]).where("type = 'calls'")
    assert got.count() == sum((i * 7919 + 13) % n <= i for i in range(n))


def test_large_frontiers_go_to_the_edges(spark, monkeypatch):
    """Without broadcasts: equal walks, hubs in parts, and no exchange of the edges in a round."""
    from assetloom.plans import frontier

    rng = random.Random(9)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(150)} | {(7, i) for i in range(60)}
    steps = spark.createDataFrame(sorted(pairs), "src long, dst long")
    roots = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "root long")
    edges = steps.selectExpr("'e' as type", "src", "dst")
    want = sorted(map(tuple, frontier.walk(steps, roots).collect())), sorted(map(tuple, frontier.walk_with_parents(edges, roots).collect()), key=repr)
    monkeypatch.setattr(frontier, "FEW", 0)
    assert sorted(map(tuple, frontier.walk(steps, roots).collect())) == want[0]
    assert sorted(map(tuple, frontier.walk_with_parents(edges, roots).collect()), key=repr) == want[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = frontier.Clustered(durable.saved(steps.selectExpr("src as from", "dst as next")), "from")
        met = laid.met(durable.cut(roots.selectExpr("root", "root as node")), 10)
        assert met.count() > 0 and laid.hubs.where("hub = 7 and parts > 1").count() == 1 and laid.layout.where("from = 7").select("part").distinct().count() > 1
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
        round_ = plan[plan.index("== Final Plan ==") : plan.index("InMemoryTableScan")]
        assert round_.count("Exchange hashpartitioning") == 1, plan  # the frontier's own
        laid.clear()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_trees_are_gone_through_as_lists(spark, monkeypatch):
    """Random forests with cycles and loose ends: lists, numbers and a walk agree; trees of few nodes need no rounds."""
    rng, rows = random.Random(8), []
    for tree in range(40):
        n = rng.randint(1, 12)
        for i in range(n):
            rows.append((tree, i, rng.choice([None, *range(n + 1)]) if rng.random() < 0.5 else (i - 1 if i else None), rng.choice([None, 0, 1]), rng.choice("abcx"), f"v{i}"))
    want = {}
    for tree in range(40):
        own = [r for r in rows if r[0] == tree]
        order = []

        def visit(parent):
            for r in sorted((r for r in own if r[2] == parent), key=lambda r: (r[3] is not None, r[3] or 0, r[1])):
                order.append(r)
                visit(r[1])

        visit(None)
        best = min(((0 if r[4] == "a" else 1, k, r) for k, r in enumerate(order) if r[4] in "abc"), default=None)
        if best:
            want[tree] = (best[2][1], best[2][5])
    frame = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, ord int, kind string, value string")
    find = lambda small: {r.tree_id: (r.node_id, r.value) for r in traversal.first_of_kinds_in_tree(frame, [["a"], ["b", "c"]], "value", small=small).collect()}
    assert find(5) == find(0) == want
    made = rounds(monkeypatch)
    assert find(64) == want and not made


def test_rows_that_point_at_few_nodes(spark):
    """A node that most rows point at is sent to them; the others, and rows that point at nothing, are joined as before."""
    up = spark.range(1, 4000).selectExpr("id as node", "if(id < 4, id - 1, if(id % 50 = 0, id - 1, 3)) as up")
    on = up.selectExpr("node as n", "up as n_up")
    got = pointers.hop(durable.saved(up), "up", durable.saved(on), "n", 3999)
    assert "broadcast" in got._jdf.queryExecution().optimizedPlan().toString()
    above = {r.node: r.up for r in up.collect()}
    assert {r.node: r.n_up for r in got.collect()} == {i: above.get(u) for i, u in above.items()}


def test_implied_edges_of_a_wide_tree_take_few_rounds(spark, monkeypatch):
    """What follows nothing and no pair ends at isn't looked at; the rounds follow from the depth of 3, not from the number of nodes."""
    from assetloom.operators import graph

    made, real, seen = [], pointers.saved, []
    monkeypatch.setattr(pointers, "saved", lambda df: made.append(1) or real(df))
    monkeypatch.setattr(graph, "nearest", lambda parents, *a: seen.append(parents.count()) or pointers.nearest(parents, *a))
    steps = spark.createDataFrame([("next", "top", f"g{i}") for i in range(10)], "type string, src string, dst string")
    steps = steps.unionByName(spark.range(5000).selectExpr("'next' as type", "concat('g', id % 10) as src", "concat('n', id) as dst"))
    steps = steps.unionByName(spark.range(5000).selectExpr("'next' as type", "concat('n', id) as src", "concat('leaf', id) as dst"))
    calls = spark.createDataFrame([("calls", "top", "n1"), ("calls", "g1", "leaf1"), ("calls", "g2", "leaf1"), ("calls", "n1", "leaf1"), ("calls", "leaf1", "g1"), ("calls", "n1", "n11"), ("calls", "top", "top"), ("calls", "out", "leaf1")], "type string, src string, dst string")
    got = graph.drop_implied_edges(steps.unionByName(calls).withColumn("k", F.lit(1)), ["next"], ["calls"]).where("type = 'calls'").collect()
    assert sorted((r.src, r.dst) for r in got) == [("g2", "leaf1"), ("leaf1", "g1"), ("n1", "n11"), ("out", "leaf1"), ("top", "top")]
    assert len(made) <= 8 and seen == [5011]


def test_lifted(spark):
    parents = spark.range(1, 1001).selectExpr("id as node", "id - 1 as up")
    asks = spark.createDataFrame([("a", 1000, 999), ("b", 7, 0), ("c", 7, 7), ("d", 7, 8), ("e", 640, 512)], "name string, node long, steps long")
    assert sorted(tuple(r) for r in pointers.lifted(parents, asks).collect()) == [("a", 1), ("b", 7), ("c", 0), ("e", 128)]
