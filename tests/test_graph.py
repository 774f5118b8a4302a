"""Literal and metamorphic tests of the graph operators, on a small graph with a cycle, a self-loop and an external leaf."""

import pytest
from pyspark.sql import functions as F

from assetloom.operators import graph, reports, traversal
from assetloom.plans.components import components
from assetloom.plans.frontier import adjacency, walk

EDGES = [
    ("renders", "c:Shell", "c:Card", 1),
    ("renders", "c:Shell", "c:Stats", 2),
    ("uses_hook", "c:Shell", "h:useData", 3),
    ("uses_hook", "h:useData", "h:useCounter", 4),
    ("calls", "h:useData", "f:getStats", 5),
    ("calls", "f:getStats", "external:axios#get", 6),
    ("calls", "f:getStats", "f:getStats", 7),
    ("uses_hook", "h:useCounter", "h:useData", 8),
    ("renders", "r:/dash", "c:Shell", 9),
    ("calls", "external:axios#get", "f:hidden", 10),
]
NODES = [("c:Shell", "component"), ("c:Card", "component"), ("c:Stats", "component"), ("h:useData", "hook"), ("h:useCounter", "hook"), ("f:getStats", "function"), ("r:/dash", "route"), ("c:Lost", "component"), ("f:hidden", "function")]


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.createDataFrame(EDGES, "type string, src string, dst string, k long")
    nodes = spark.createDataFrame([(n, t, n[2:], f"/{t}") for n, t in NODES], "node string, type string, label string, path string")
    return nodes, edges


def roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_walks_end_on_cycles(spark, g):
    _, edges = g
    got = dict(rows(walk(adjacency(edges), roots(spark, "c:Shell")), "node", "depth"))
    assert got == {"c:Shell": 0, "c:Card": 1, "c:Stats": 1, "h:useData": 1, "h:useCounter": 2, "f:getStats": 2, "external:axios#get": 3, "f:hidden": 4}


def test_expansions_grow_with_depth_and_reverse(spark, g):
    _, edges = g
    r = roots(spark, "c:Shell", "c:Card")
    sets = [set(rows(traversal.expand_khop(edges, r, d), "root", "src", "dst", "k")) for d in (1, 2, 3)]
    assert sets[0] < sets[1] <= sets[2]
    flipped = edges.selectExpr("type", "dst AS src", "src AS dst", "k")
    assert rows(traversal.reachable(edges, r, direction="in"), "root", "node", "depth") == rows(traversal.reachable(flipped, r), "root", "node", "depth")


def test_chains_stop_at_leaves(spark, g):
    nodes, edges = g
    got = rows(traversal.call_chain(nodes, edges, roots(spark, "h:useData"), ["calls", "uses_hook"]), "node", "depth", "kind")
    assert got == [("external:axios#get", 2, "external"), ("f:getStats", 1, "internal"), ("h:useCounter", 1, "internal")]
    deep = rows(traversal.deep_call_chain(nodes, edges, roots(spark, "c:Shell"), ["calls"], "uses_hook", "passes_prop"), "root", "via", "node")
    assert deep == [("c:Shell", "h:useData", "external:axios#get"), ("c:Shell", "h:useData", "f:getStats")]


def test_impact_and_chains(spark, g):
    nodes, edges = g
    r = roots(spark, "f:getStats")
    got = rows(traversal.impact(edges, r), "node", "depth")
    assert got == [("c:Shell", 2), ("h:useCounter", 2), ("h:useData", 1), ("r:/dash", 3)]
    chains = traversal.impact_chains(edges, r, ["calls", "uses_hook", "renders"], nodes.where("type = 'route'").select("node"))
    assert rows(chains, "node", "depth", "chain") == [("r:/dash", 3, "f:getStats <- h:useData <- c:Shell <- r:/dash")]
    impacted = traversal.impact(edges, r)
    assets = spark.createDataFrame([("c:Shell", "a.tsx")], "node string, asset string")
    touching = spark.createDataFrame([("a.tsx", "/dash"), ("b.tsx", "/x")], "asset string, route string")
    assert rows(traversal.impact_routes(impacted, r, assets, touching), "root", "route") == [("f:getStats", "/dash")]
    assert rows(traversal.unused_symbols(nodes, edges, ["renders", "uses_hook", "calls"]), "node") == [("c:Lost",), ("r:/dash",)]


def test_unrelated_nodes_change_nothing(spark, g):
    nodes, edges = g
    more = edges.union(spark.createDataFrame([("renders", "c:X", "c:Y", 99)], edges.schema))
    r = roots(spark, "c:Shell")
    assert rows(traversal.impact(more, r), "node") == rows(traversal.impact(edges, r), "node")
    assert rows(traversal.containment_tree(more, r), "path") == rows(traversal.containment_tree(edges, r), "path")


def test_reports(spark, g):
    nodes, edges = g
    got = rows(reports.trace_symbol(nodes, edges, roots(spark, "c:Shell", "c:Lost"), ["renders"], ["renders", "uses_hook", "calls"], ["calls", "uses_hook"]), "root", "section", "subject")
    assert ("c:Shell", "usage", "r:/dash") in got and ("c:Shell", "tree", "c:Card") in got and ("c:Shell", "calls", "h:useCounter") in got
    assert ("c:Lost", "warnings", "c:Lost") in got and ("c:Shell", "warnings", "c:Shell") not in got
    flags = spark.createDataFrame([(r.path, False) for r in nodes.select("path").distinct().collect()], "path string, client boolean")
    more = rows(reports.trace_symbol(nodes, edges, roots(spark, "c:Shell"), ["renders"], ["renders", "uses_hook", "calls"], ["calls"], passing=("renders",), hooks=("uses_hook",), lazy=("renders",), flags=flags), "section", "subject", "value")
    direct = edges.where("type = 'renders'").select("src", "dst").collect()
    assert {x[1] for x in more if x[0] == "passed"} == {r.dst for r in direct if r.src == "c:Shell"}
    assert {x[1] for x in more if x[0] == "received"} == {x[1] for x in more if x[0] == "dynamic"} == {r.src for r in direct if r.dst == "c:Shell"}
    uses = {r.dst for r in edges.where("type = 'uses_hook' and src = 'c:Shell'").collect()}
    assert {x[1] for x in more if x[0] == "hooks"} == uses
    assert [x[2] for x in more if x[0] == "boundary"] == ["client by use" if uses else "server"]
    assert (("warnings", "c:Shell", "uses hooks without a client mark") in more) == bool(uses)
    passes = spark.createDataFrame([("c:Card", "c:Shell", "title", "t"), ("c:Card", "c:Shell", "odd", "data.t"), ("c:Card", "c:Shell", "onClick", "data")], "node string, giver string, prop string, value string")
    declared = spark.createDataFrame([("c:Card", "title")], "node string, prop string")
    assert rows(reports.received_properties(passes, declared), "prop", "declared") == [("odd", False), ("onClick", False), ("title", True)]
    from assetloom.functions.rules import references_identifier

    names = spark.createDataFrame([("c:Shell", "data")], "owner string, name string")
    assert rows(reports.pass_downs(passes, names, references_identifier), "child", "prop", "renamed") == [("c:Card", "odd", True)]
    sources = spark.createDataFrame([("c:Stats", "n", "h:useData")], "node string, prop string, origin string")
    assert rows(reports.property_origins(sources, passes), "node", "prop", "kind")[-1] == ("c:Stats", "n", "source")
    sites = spark.createDataFrame([("c:Shell", "loop", "data.items", 3), ("c:Shell", "event", "other(dataset)", 4)], "owner string, kind string, expression string, line int")
    assert rows(reports.symbol_usage_sites(sites, names, references_identifier), "kind", "line") == [("loop", 3)]


def test_properties(spark, g):
    passed = spark.createDataFrame([("c:Shell", "c:Card", "t", "t"), ("c:Page", "c:Shell", "t", "data.t"), ("c:X", "c:Page", "t", "t")], "parent string, child string, prop string, expression string")
    assert rows(traversal.pass_through_chain(passed, spark.createDataFrame([("c:Card", "t")], "root string, prop string")), "ord", "node", "expression") == [(1, "c:Shell", "t"), (2, "c:Page", "data.t")]


def test_small_operators(spark, g):
    nodes, edges = g
    tree = spark.createDataFrame([(1, 1, None, 0, "await"), (1, 2, 1, 1, "member"), (1, 3, 1, 0, "x"), (1, 4, 3, 0, "call"), (1, 5, 2, 0, "call")], "tree_id int, node_id int, parent_id int, ord int, kind string")
    assert rows(traversal.first_of_kind_in_tree(tree, ["call"]), "tree_id", "node_id") == [(1, 4)]
    near = traversal.nested_dependency_chain(edges.where("type = 'uses_hook'"), spark.createDataFrame([("c:Shell", "counterValue"), ("c:Shell", "other")], "root string, field string"))
    assert rows(near, "field", "ord", "node") == [(f, i, n) for f in ("counterValue", "other") for i, n in ((1, "h:useData"), (2, "h:useCounter"))]  # none matches at first, so all are followed
    sites = spark.createDataFrame([("f:getStats", "count", "write", 4, "effect"), ("c:Lost", "count", "write", 5, "effect")], "owner string, field string, role string, line int, context string")
    assert rows(traversal.field_writers(edges, sites, spark.createDataFrame([("r:/dash", "count")], "root string, field string")), "owner", "line") == [("f:getStats", 4)]
    scopes = spark.createDataFrame([("c:Card", "renders", "c:Shell", "c:Card", 1)], "root string, type string, src string, dst string, k long")
    both = traversal.composition_scope(edges, roots(spark, "c:Card", "c:Stats"), scopes, ["renders"], ["renders"])
    assert rows(both, "root", "src", "dst") == [("c:Card", "c:Shell", "c:Card"), ("c:Stats", "c:Shell", "c:Stats"), ("c:Stats", "r:/dash", "c:Shell")]
    flows = spark.createDataFrame([(1, "c:Card", "n", "data.n", 7, "c:Shell")], "flow_id int, child string, prop string, value string, line int, owner string")
    targets = spark.createDataFrame([(1, "h:useData")], "flow_id int, dst string")
    assert rows(graph.edges_value_source(flows, targets), "src", "dst", "prop") == [("h:useData", "c:Card", "n")]


def test_components_of_long_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(159, 158), (7, 7), (300, 301)]
    got = dict(rows(components(spark.createDataFrame(pairs, "a long, b long")), "node", "component"))
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_upstream_edges_of_a_long_chain(spark):
    chain = [("calls", f"n{i + 1}", f"n{i}", i) for i in range(18)] + [("calls", "n0", "n18", 18)]
    edges = spark.createDataFrame(chain, "type string, src string, dst string, k int")
    seeds = spark.createDataFrame([("r", "n0")], "root string, node string")
    found = traversal.upstream_edges(edges, seeds, seeds.where("false"), ["calls"])
    assert sorted(r.k for r in found.collect()) == list(range(19))
    assert sorted(r.k for r in traversal.upstream_edges(edges, seeds, seeds.where("false"), ["calls"], 5).collect()) == list(range(5))


def test_walks_have_no_silent_end(spark):
    n = 22
    flows = spark.createDataFrame([(f"n{i + 1}", f"n{i}", "t", "t") for i in range(n)] + [("n0", f"n{n}", "t", "t")], "parent string, child string, prop string, expression string")
    chain = traversal.pass_through_chain(flows, spark.createDataFrame([("n0", "t")], "root string, prop string"))
    assert chain.agg(F.max("ord")).first()[0] == n and chain.count() == n  # and the cycle ends
    e = spark.createDataFrame([("has", f"n{i}", f"n{(i + 1) % 5}", i) for i in range(5)], "type string, src string, dst string, k int")
    nodes = spark.createDataFrame([(f"n{i}", "top" if i == 0 else "x") for i in range(5)], "node string, type string")
    root = spark.createDataFrame([("n4",)], "root string")
    assert rows(traversal.nearest_ancestor(e, nodes, root, "top"), "ancestor", "depth") == [("n0", 4)]
    assert rows(traversal.nearest_ancestor(e, nodes, root, "none"), "ancestor") == []


def test_nested_dependencies_follow_matches_or_all(spark):
    e = spark.createDataFrame([("u", a, b, 0) for a, b in (("useA", "useCounter"), ("useA", "useTheme"), ("useCounter", "useXx"), ("useCounter", "useYy"), ("useTheme", "useZz"), ("useXx", "useA"))], "type string, src string, dst string, k int")
    roots = spark.createDataFrame([("useA", "counterValue"), ("useA", None)], "root string, field string")
    got = traversal.nested_dependency_chain(e, roots)
    assert rows(got.where("field is not null"), "ord", "node") == [(1, "useCounter"), (2, "useXx"), (2, "useYy")]
    assert rows(got.where("field is null"), "ord", "node") == [(1, "useCounter"), (1, "useTheme"), (2, "useXx"), (2, "useYy"), (2, "useZz")]


def test_labels_categories_and_focus(spark):
    e = spark.createDataFrame(
        [("renders", "a", "b", None, None, None, None, None), ("passes_prop", "a", "b", None, "x=1, y=2", None, None, None), ("passes_prop", "a", "b", None, "x=" + "1" * 50, None, None, None), ("prop_source", "a", "b", None, None, "user", None, None), ("sequence", "a", "b", None, None, None, 2, "await"), ("calls", "a", "b", "fetches", None, None, None, None), ("uses_hook", "a", "b", "uses hook", None, None, None, None)],
        "type string, src string, dst string, label string, props string, prop string, order int, step string",
    )
    got = [r.label for r in reports.edge_label(e).collect()]
    assert got == ["render", "pass props: {x=1, y=2}", ("pass props: {x=" + "1" * 50)[:41] + "…", "→ user", "2. await", "fetches", "hook"]
    n = spark.createDataFrame([("a", "store", None), ("b", "thing", None), ("c", "hook", "data"), ("d", "loop", "odd"), ("e", "page", None)], "node string, type string, category string")
    assert rows(graph.node_category(n), "node", "category") == [("a", "data"), ("b", "ui"), ("c", "data"), ("d", "logic")]
    f = spark.createDataFrame([("prop_source", "h", "kid", 1, "User", "me"), ("prop_source", "h", "kid", 2, "other", "me"), ("calls", "me", "getUser", 3, None, None), ("renders", "me", "kid", 4, None, None), ("calls", "x", "me", 5, None, None), ("uses_hook", "me", "useUser", 6, None, None)], "type string, src string, dst string, k int, prop string, passed_from string")
    focus = spark.createDataFrame([("p", "me", "prop", "user"), ("c", "me", "call", "user"), ("h", "me", "hook", "user")], "root string, owner string, kind string, text string")
    assert rows(traversal.focus_usage_edges(f, focus), "root", "k") == [("c", 3), ("h", 6), ("p", 1), ("p", 3), ("p", 6)]


def test_edges_are_built_from_a_catalog(spark):
    symbols = spark.createDataFrame([("component:Card@ui/card.tsx", "Card", "component", "ui/card.tsx", 1), ("component:Card@old/card.tsx", "Card", "component", "old/card.tsx", 1), ("hook:useCart@lib/cart.ts", "useCart", "hook", "lib/cart.ts", 1)], "symbol string, name string, type string, path string, ord int")
    imports = spark.createDataFrame([("app/page.tsx", 0, "Card", "@/ui/card", "ui/card.tsx")], "source string, import_ord int, name string, module string, path string")
    refs = spark.createDataFrame([("file:app/page.tsx", "@/ui/card", "ui/card.tsx"), ("file:app/page.tsx", "react", None)], "owner string, target string, path string")
    one = lambda name: spark.createDataFrame([(1, "P", "app/page.tsx", name)], "ref_id int, owner string, source string, name string")
    passes = spark.createDataFrame([(1, "P", "app/page.tsx", "Card", 0, ["a", "b"], ["1", "true"])], "ref_id int, owner string, source string, name string, ord int, names array<string>, values array<string>")
    calls = spark.createDataFrame([(1, "P", "app/page.tsx", "useCart.add", 3), (2, "P", "app/page.tsx", "Math.max", 4)], "ref_id int, owner string, source string, callee string, line int")
    got = graph.build_edges(symbols, imports, refs, one("Card"), one("useCart"), passes, calls)
    card, hook = "component:Card@ui/card.tsx", "hook:useCart@lib/cart.ts"
    assert rows(got, "type", "src", "dst", "k") == [("calls", "P", "builtin:Math.max", 4), ("calls", "P", hook, 3), ("imports", "file:app/page.tsx", "react", 0), ("imports", "file:app/page.tsx", "ui/card.tsx", 0), ("passes_prop", "P", card, 0), ("renders", "P", card, 0), ("uses_hook", "P", hook, 0)]
    assert graph.edges_passes(passes, imports, symbols).first().summary == "a=1, b=true"


def test_dependency_layer(spark):
    from assetloom.operators.graph import layer_dependency

    refs = spark.createDataFrame([("a/x.ts", "./y", "a/y.ts"), ("b/x.ts", "./y", "b/y.ts"), ("a/x.ts", "react", None), ("a/x.ts", "@/gone", None), ("a/x.ts", "react", None), ("c.ts", None, None), (None, "zod", None)], "owner string, target string, path string")
    nodes, edges = layer_dependency(refs)
    assert rows(nodes, "node", "type", "label") == [
        ("file:a/x.ts", "file", "x.ts"), ("file:a/y.ts", "file", "y.ts"), ("file:b/x.ts", "file", "x.ts"), ("file:b/y.ts", "file", "y.ts"),
        ("module:./y", "workspace", "./y"), ("module:@/gone", "module", "@/gone"), ("module:react", "external", "react"), ("module:zod", "external", "zod"),
    ]
    assert rows(edges, "src", "dst", "type") == [
        ("file:a/x.ts", "module:./y", "imports"), ("file:a/x.ts", "module:@/gone", "imports"), ("file:a/x.ts", "module:react", "imports"), ("file:b/x.ts", "module:./y", "imports"),
        ("module:./y", "file:a/y.ts", "resolved-to"), ("module:./y", "file:b/y.ts", "resolved-to"),
    ]
    empty = layer_dependency(refs.where("false"))
    assert empty[0].count() == empty[1].count() == 0


def test_route_scopes(spark):
    """Two routes with a layout in common; a component of one, one of both, and one of none, which has its neighbourhood."""
    from assetloom.operators import routes as R

    none = None
    schema = "route string, page string, layouts array<string>, loading string, error string, not_found string, handlers array<string>"
    sites = spark.createDataFrame([("/a", "app/a/page.tsx", ["app/layout.tsx"], none, none, none, []), ("/b", "app/b/page.tsx", ["app/layout.tsx"], none, none, none, [])], schema)
    steps = [("renders", "app/a/page.tsx", "c:A", 1), ("renders", "app/b/page.tsx", "c:B", 2), ("renders", "c:A", "c:Deep", 3), ("renders", "app/a/page.tsx", "c:Both", 4), ("renders", "app/b/page.tsx", "c:Both", 5), ("renders", "c:X", "c:Y", 6)]
    edges = spark.createDataFrame(steps, "type string, src string, dst string, k long")
    nodes = spark.createDataFrame([(n, n) for n in {x for e in steps for x in e[1:3]}], "node string, path string")
    asked = roots(spark, "c:A", "c:Both", "c:Y", "c:Deep")
    scopes = R.route_scopes(nodes, edges, asked, sites, ["renders"])
    assert rows(scopes, "root", "k") == [("c:A", 1), ("c:A", 3), ("c:A", 4)] + [("c:Both", i) for i in range(1, 6)]
    every = traversal.composition_scope(edges, asked, scopes, ["renders"], ["renders"])
    assert [k for r, k in rows(every, "root", "k") if r == "c:Y"] == [6] and {k for r, k in rows(every, "root", "k") if r == "c:Deep"} == {1, 3}


def test_prune_to_sink_meets_no_hub_with_all_its_edges(spark):
    """A hub with 3,000 edges above each of 300 sinks; meeting the kept hub with all that leaves it would make 900,000 rows."""
    from assetloom.operators import traversal

    edges = spark.range(3000).selectExpr("'e' as type", "'hub' as src", "concat('n', id) as dst", "id as k")
    edges = edges.unionByName(edges.where("k < 5")).unionByName(spark.createDataFrame([("e", "n1", "hub", -1), ("e", None, "n1", -2), ("e", "n2", None, -3)], "type string, src string, dst string, k long"))
    sinks = spark.range(300).selectExpr("concat('n', id) as root")
    out = traversal.prune_to_sink(edges, sinks)
    got = {tuple(r) for r in out.select("root", "type", "src", "dst", "k").collect()}
    want = {(f"n{r}", "e", "hub", f"n{d}", d) for r in range(300) for d in {r, 1}} | {(f"n{r}", "e", "n1", "hub", -1) for r in range(300)}
    assert got == want and out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_merge_steps_agrees_with_its_sql_on_ends_of_days_and_ties(spark, tmp_path):
    import duckdb

    from assetloom import catalogue

    values = ", ".join(f"({i}, TIMESTAMP '{t}', 1, '{k}')" for i, t, k in [(1, "2024-01-01 23:59:59.7", "view"), (2, "2024-01-02 00:00:00", "error"), (3, "2024-01-02 01:00:00", "view"), (3, "2024-01-02 01:00:00", "search"), (4, "1969-12-31 23:00:00", "click")])
    db = duckdb.connect()
    db.execute(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, 0.0::DOUBLE AS value, '' AS props FROM (VALUES {values}) t(event_id, ts, user_id, event_type)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["merge_steps"](spark, str(tmp_path)).orderBy("number").collect()]
    assert got == db.execute(f"SELECT * FROM ({catalogue.ORACLE_SQL['merge_steps']}) ORDER BY number").fetchall()
    assert [r[3] for r in got] == ["click", "view", "error", "search", "view"]


def test_tree_levels_bring_no_parallel_edges_together(spark, monkeypatch):
    plans, real = [], traversal.walk
    monkeypatch.setattr(traversal, "walk", lambda steps, *a: plans.append(steps._jdf.queryExecution().optimizedPlan().toString()) or real(steps, *a))
    edges = spark.createDataFrame([("e", "a", "b", 1), ("e", "a", "b", 2), ("e", "b", "c", 3), ("e", "a", "c", 4), ("e", "c", "d", 5), ("e", None, "x", 6), ("e", "x", None, 7)], "type string, src string, dst string, k long")
    nodes = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    assert rows(traversal.tree_levels(nodes, edges), "node", "level") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", 0)]
    assert len(plans) == 1 and "Aggregate" not in plans[0]


def test_neighbors_leaves_out_other_edges_before_pairs_are_made_distinct(spark):
    from assetloom.operators.traversal import neighbors

    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a"), ("d", "e"), ("a", None), (None, "a")], "src string, dst string")
    found = neighbors(e, spark.createDataFrame([("a",)], "root string"), "both")
    assert sorted((x.root, x.node) for x in found.collect()) == [("a", "b"), ("a", "c")]
    assert str(found._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 1


def test_tree_and_walk_share_clustered_steps_with_parallel_edges(spark):
    from assetloom.operators.traversal import containment_tree
    from assetloom.plans.frontier import clustered, walk

    steps = clustered(spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "d")], "src string, dst string"))
    roots = spark.createDataFrame([("a",)], "root string")
    tree = containment_tree(steps, roots)
    assert sorted((x.path, x.is_last) for x in tree.collect()) == [("a", True), ("a > b", False), ("a > b > d", True), ("a > c", True)]
    assert sorted((x.node, x.depth) for x in walk(steps, roots).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_visible_tree_keeps_two_ancestors_of_hidden_nodes(spark):
    nodes = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "v"), ("h", "h"), ("i", "h"), ("x", "v")], "node string, type string")
    pairs = [("a", "h"), ("b", "h"), ("c", "h"), ("h", "i"), ("i", "h"), ("h", "a"), ("i", "b"), ("i", "x"), ("i", "x")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    found = traversal.visible_tree(edges, nodes, ["h"])
    assert sorted((x.node, x.parent) for x in found.collect()) == [("a", "b"), ("b", "a"), ("c", None), ("x", "a")]


def test_written_fields_are_looked_for_in_one_join(spark):
    edges = spark.createDataFrame([("r", "a")], "src string, dst string")
    calls = spark.createDataFrame([("a", "setStatus", "on", 1, "x"), ("a", "setStatus", "off", 1, "x"), ("a", "setOther", "on", 2, "y"), ("b", "dispatch", "on", 3, "z")], "owner string, callee string, context string, line int, expression string")
    effects = spark.createDataFrame([("a", ["status"], "effect", 4), ("a", ["other"], "effect", 5), ("a", None, "effect", 6)], "owner string, deps array<string>, context string, line int")
    found = traversal.traced_field_writers(edges, calls, effects, spark.createDataFrame([("r", "status")], "root string, field string"))
    assert sorted((x.role, x.owner, x.line, x.context) for x in found.collect()) == [("trigger", "a", 4, "effect"), ("write", "a", 1, "off"), ("write", "a", 1, "on")]


def test_edges_among_many_nodes_are_looked_up_without_sorting_them(spark, monkeypatch):
    from assetloom.plans import frontier

    monkeypatch.setattr(frontier, "FEW", 0)
    nodes = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "w")], "node string, type string")
    edges = spark.createDataFrame([("t", "a", "b", 1), ("t", "a", "c", 2), ("t", "c", "b", 3), ("t", "a", None, 4)], "type string, src string, dst string, k int")
    found = graph.layer_component(nodes, edges, ["v"])[1]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [x.k for x in found.collect()] == [1]


def test_expand_khop_in_both_directions_loses_no_edge_of_the_last_round(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("c", "b", 2), ("c", "d", 3), ("e", "d", 4), (None, "a", 5), (None, "b", 6), ("b", "b", 7), ("a", "b", 1)], "src string, dst string, k int")
    found = traversal.expand_khop(edges, spark.createDataFrame([("a",)], "root string"), 3)
    assert sorted(x.k for x in found.collect()) == [1, 2, 3, 5, 6, 7]
    assert sorted(x.k for x in traversal.expand_khop(edges, spark.createDataFrame([("a",)], "root string"), 1).collect()) == [1, 5]
