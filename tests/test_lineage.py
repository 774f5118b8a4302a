import pytest

from assetloom.operators import lineage

EDGES = "src string, dst string, type string, k long, prop string, passed_from string, flow_id string, callee string"
FLOWS = "flow_id string, node_id long, parent_id long, ord int, kind string, name string, property string, callee string, line int, expression string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def chain(spark):
    """Card.title <- Shell.heading (parameter) <- Page: const { heading } = await useHead(); Shell passes it on."""
    edges = [
        ("h:useHead", "c:Card", "prop_source", 1, "title", "c:Shell", "f1", None),
        ("h:useHead", "c:Shell", "prop_source", 2, "Heading", "c:Page", "f2", None),
        ("c:Shell", "c:Card", "passes_prop", 3, "title", None, None, None),
        ("c:Page", "h:useHead", "sequence", 4, None, None, None, "useHead"),
        ("c:App", "c:Other", "passes_prop", 5, "Label", None, None, None),
        ("external:lib#get", "c:Plain", "prop_source", 6, "x", None, None, None),
        ("s:api", "c:Deep", "prop_source", 7, "y", "c:Up", "f3", None),
        ("c:Up", "f:load", "calls", 8, None, None, None, "api.load"),
    ]
    flows = [
        ("f1", 1, None, 0, "parameter", "heading", None, None, 3, "heading"),
        ("f2", 1, None, 0, "member", None, "text", None, 7, "data.text"),
        ("f2", 2, 1, 0, "identifier", "data", None, None, 5, "data"),
        ("f2", 3, 2, 0, "await", None, None, None, 5, "await useHead()"),
        ("f2", 4, 3, 0, "await", None, None, None, 5, "await useHead()"),
        ("f2", 5, 4, 0, "hook_call", None, None, "useHead", 5, "useHead()"),
        ("f2", 6, 5, 0, "identifier", "never", None, None, 5, "never"),
        ("f3", 1, None, 0, "object", None, None, None, 2, "{ y: api.load() }"),
        ("f3", 2, 1, 0, "call", None, None, "api.load", 2, "api.load()"),
    ]
    nodes = [("c:Card", "component", "Card"), ("c:Shell", "component", "Shell"), ("c:Page", "component", "Page"), ("h:useHead", "hook", "useHead"), ("c:App", "component", "App"), ("c:Up", "component", "Up")]
    return spark.createDataFrame(nodes, "node string, type string, label string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame(flows, FLOWS)


def asked(spark, *pairs):
    return spark.createDataFrame(pairs, "root string, prop string")


def test_property_lineage(spark, chain):
    nodes, edges = lineage.property_lineage(*chain, asked(spark, ("c:Card", "title")))
    step = "step:c:Page"
    assert rows(edges, "src", "dst", "type") == sorted(
        [
            ("prop:c:Shell:heading", "prop:c:Card:title", "prop_source"),
            ("c:Shell", "prop:c:Card:title", "passes_prop"),
            ("h:useHead", f"{step}:5:data", "prop_source"),
            ("h:useHead", f"{step}:5:data", "sequence"),
            (f"{step}:5:data", f"{step}:7:text", "sequence"),
            (f"{step}:5:data", "prop:c:Shell:heading", "prop_source"),
            (f"{step}:7:text", "prop:c:Shell:heading", "prop_source"),
            ("c:Page", "prop:c:Shell:heading", "passes_prop"),
            ("c:Page", "h:useHead", "sequence"),
        ],
        key=repr,
    )
    got = {r.node: (r.type, r.label, r.cut) for r in nodes.collect()}
    assert got["h:useHead"] == ("hook", "useHead", False) and got[f"{step}:7:text"] == ("variable", "text", False) and got["prop:c:Shell:heading"] == ("prop", "heading", False) and len(got) == 7
    _, edges = lineage.property_lineage(*chain, asked(spark, ("c:Other", "label"), ("c:Plain", "x"), ("c:Nothing", "z")))
    assert rows(edges, "root", "src", "dst", "type") == [("c:Other", "c:App", "prop:c:Other:label", "passes_prop"), ("c:Plain", "external:lib#get", "prop:c:Plain:x", "prop_source")]
    nodes, edges = lineage.property_lineage(*chain, asked(spark, ("c:Deep", "y")))  # the call is none of the parent's own sources
    assert rows(edges, "src", "dst", "type") == [("c:Up", "prop:c:Deep:y", "passes_prop"), ("c:Up", "s:api", "calls"), ("s:api", "prop:c:Deep:y", "prop_source")]
    for part in lineage.property_lineage(*chain, asked(spark)):
        assert part.count() == 0


def test_cut_and_cycles(spark):
    """A property passed on through twenty parents, and one that two components hand to each other."""
    names = [f"c:{i}" for i in range(21)]
    edges = [("c:20", a, "prop_source", i, "p", b, f"f{i}", None) for i, (a, b) in enumerate(zip(names, names[1:]))] + [("x", "c:a", "prop_source", 90, "p", "c:b", "fa", None), ("x", "c:b", "prop_source", 91, "p", "c:a", "fb", None)]
    flows = [(e[6], 1, None, 0, "parameter", "p", None, None, 1, "p") for e in edges]
    args = spark.createDataFrame([], "node string, type string, label string"), spark.createDataFrame(edges, EDGES), spark.createDataFrame(flows, FLOWS)
    nodes, _ = lineage.property_lineage(*args, asked(spark, ("c:0", "p"), ("c:17", "p"), ("c:a", "p")))
    assert rows(nodes.where("cut"), "root", "node") == [("c:0", "prop:c:6:p")]
    assert rows(nodes.where("root = 'c:0' and type = 'prop'"), "node") == sorted((f"prop:c:{i}:p",) for i in range(8))
    assert rows(nodes.where("root = 'c:a' and type = 'prop'"), "node") == [("prop:c:a:p",), ("prop:c:b:p",)]
    nodes, _ = lineage.property_lineage(*args, asked(spark, ("c:0", "p")), max_depth=30)
    assert nodes.where("cut").count() == 0 and nodes.where("type = 'prop'").count() == 21


def test_deep_expressions(spark):
    """A thousand nested members above a name."""
    n = 1000
    flows = [("f", i, i - 1 if i else None, 0, "member", None, f"m{i}", None, 1, "e") for i in range(n)] + [("f", n, n - 1, 0, "identifier", "x", None, None, 1, "x")]
    got = lineage.flow_edges(spark.createDataFrame(flows, FLOWS))
    assert got.where("type = 'sequence'").count() == n and got.where("b.kind = 'target'").count() == n + 1


NODES = "node string, ord long, type string, label string, name string, outputs array<string>, reads array<string>, inputs array<struct<name: string, source: string>>, expression string, path string"


def node(n, ord_, type_, label, name=None, outputs=(), reads=(), inputs=(), path="/p"):
    return (n, ord_, type_, label, name, list(outputs), list(reads), list(inputs), None, path)


def test_focus_steps(spark):
    """A prop of a hook, whose input is of a hook, whose input is fetched; two gates; a hook that asks for itself."""
    from assetloom.operators.resolution import expression_lookup

    nodes = spark.createDataFrame(
        [
            node("page", 0, "page", "Page"),
            node("outer", 1, "condition", "user", reads=["ctx.user"]),
            node("inner", 2, "condition", "open"),
            node("card", 3, "component", "Card"),
            node("ctx", 4, "context", "UserContext", "user", outputs=["ctx"]),
            node("h1", 5, "hook", "useOne", outputs=["one"], inputs=[("a", "two.x"), ("b", None)]),
            node("h2", 6, "hook", "useTwo", outputs=["two"], inputs=[("c", "data.rows")]),
            node("load", 7, "data-fetch", "load()", "load", outputs=["data"]),
            node("h3", 8, "hook", "useThree", outputs=["three"], inputs=[("self", "three")]),
            node("leaf", 9, "component", "Leaf"),
            node("more", 10, "data-fetch", "more()", "more", outputs=["rest"]),
        ],
        NODES,
    )
    edges = spark.createDataFrame(
        [("renders", "page", "outer", 1), ("branch", "outer", "inner", 2), ("branch", "inner", "card", 3), ("uses_hook", "card", "h3", 4), ("uses_hook", "card", "h2", 5), ("calls", "card", "more", 6), ("renders", "card", "leaf", 7), ("calls", "h2", "load", 8)],
        "type string, src string, dst string, k long",
    )
    passes = spark.createDataFrame([("card", 0, "one.value"), ("card", 1, "unknown"), ("card", 2, "three")], "node string, ord long, expression string")
    lookup = expression_lookup(nodes, hook_inputs=False)
    root = spark.createDataFrame([("card",), ("page",), ("h1",)], "root string")
    got = lineage.focus_steps(nodes, edges, root, passes, lookup, {"renders": 1, "branch": 0}, ["renders", "calls"]).collect()
    steps = [(r.node, r.depth, r.role, r.link) for r in sorted(got, key=lambda r: r.ord) if r.root == "card"]
    assert steps == [
        ("load", -6, "data-source", "feeds"),
        ("more", -6, "data-source", "feeds"),
        ("h2", -5, "hook-logic", "feeds"),
        ("h1", -4, "hook-logic", "feeds"),
        ("h3", -4, "hook-logic", "feeds"),
        ("inner", -3, "visibility-condition", "feeds"),
        ("ctx", -2, "data-source", "feeds"),
        ("outer", -1, "visibility-condition", "feeds"),
        ("card", 0, "focus", "renders"),
        ("leaf", 1, "ui-output", "renders"),
        ("more", 1, "data-source", None),
    ]
    assert [r.node for r in sorted(got, key=lambda r: r.ord) if r.root == "h1"] == ["load", "h2", "h1"]
    assert [(r.node, r.depth) for r in sorted(got, key=lambda r: r.ord) if r.root == "page"] == [("page", 0), ("outer", 1)]


def test_return_literals(spark):
    rows_ = [("a", "x", None, "b", "y"), ("b", "y", None, "c", "z"), ("c", "z", "false", None, None), ("r", "x", None, "s", "x"), ("s", "x", None, "r", "x"), ("q", "x", None, "gone", "x"), ("a", "own", "1", None, None)]
    got = lineage.return_literals(spark.createDataFrame(rows_, "function string, field string, literal string, callee string, callee_field string"))
    assert rows(got, "function", "field", "literal") == [("a", "own", "1"), ("a", "x", "false"), ("b", "y", "false"), ("c", "z", "false")]


def test_value_trace(spark):
    from assetloom.operators.resolution import expression_lookup

    nodes = spark.createDataFrame(
        [
            node("page", 0, "page", "DemoPage", path="/page"),
            node("loop", 1, "loop", "plans.map", path="/page"),
            node("card", 2, "component", "Card", path="/card"),
            node("load", 3, "data-fetch", "getPageData()", "getPageData", outputs=["data"]),
            node("hook", 4, "hook", "useUser", outputs=["user"]),
            node("inner", 5, "hook", "useUserStore"),
            node("ctx", 6, "context", "ThemeContext", "theme", outputs=["theme"]),
            node("store", 7, "store", "cart", "cart", outputs=["cart"]),
        ],
        NODES,
    )
    make = lambda data, schema: spark.createDataFrame(data, schema)
    edges = make([("uses_hook", "hook", "inner", 1)], "type string, src string, dst string, k long")
    args = dict(
        locals_=make([("page", "shown", "useUser", None, False, [], []), ("card", "total", None, None, True, ["rate", "isLoggedIn"], ["isLoggedIn"])], "consumer string, name string, source_hook string, hook_node string, derived boolean, refs array<string>, props array<string>"),
        flows=make([("middle", "card", "isLoggedIn", "isLoggedIn"), ("page", "middle", "isLoggedIn", "data.isLoggedIn"), ("page", "card", "title", "TITLE")], "parent string, child string, prop string, expression string"),
        bindings=make([("/card", "TITLE", 2, None), ("/page", "TITLE", 1, "wrong"), ("/page", "plans", 1, "makePlans")], "file string, name string, ord long, call string"),
        loops=make([("loop", "plan", "plans"), ("page", "plan", "farther"), ("page", "row", "rows")], "node string, item string, source string"),
        parents=make([("card", "loop"), ("loop", "page")], "node string, up string"),
        returns=make([("getPageData", "isLoggedIn", None, "session", "on"), ("session", "on", "false", None, None)], "function string, field string, literal string, callee string, callee_field string"),
        calls=make([("load", 1, "api", "GET /me"), ("load", 0, "function", "session()")], "node string, ord long, kind string, label string"),
    )
    asks = [("page", "data.isLoggedIn", None), ("page", "data", None), ("page", "shown", None), ("card", "total", None), ("card", "isLoggedIn", "isLoggedIn"), ("card", "title", "title"), ("card", "plan.name", None), ("card", "row", None), ("card", "user.name", None), ("card", "theme", None), ("card", "cart.n", None), ("card", "nothing.x", None)]
    roots = make(asks, "root string, expression string, prop string")
    got = lineage.value_trace(roots, nodes, edges, expression_lookup(nodes), expression_lookup(nodes, hook_inputs=False), **args).collect()
    trace = {}
    for r in sorted(got, key=lambda r: r.ord):
        trace.setdefault((r.expression, r.origin), []).append((r.role, r.label))
    fetch = [("variable", "data"), ("await-call", "getPageData()"), ("function", "session()"), ("api-call", "GET /me")]
    literal = [("hardcode", "Hard code: false")]
    handed = [("prop", "isLoggedIn")] * 2
    assert trace == {
        ("data.isLoggedIn", "fetch"): fetch + literal,
        ("data", "fetch"): fetch,
        ("shown", "hook-local"): [("variable", "shown"), ("hook", "useUser"), ("hook", "useUserStore")],
        ("total", "derived-local"): [("variable", "total")] + handed + fetch + literal,
        ("isLoggedIn", "fetch"): handed + fetch + literal,
        ("title", "binding"): [("prop", "title"), ("variable", "TITLE")],
        ("plan.name", "loop"): [("variable", "plan.name"), ("variable", "plan"), ("variable", "plans"), ("function", "makePlans()")],
        ("row", "loop"): [("variable", "row"), ("variable", "rows")],
        ("user.name", "hook-field"): [("variable", "user"), ("hook", "(hook) useUser"), ("hook", "(hook) useUserStore")],
        ("theme", "context"): [("context", "ThemeContext")],
        ("cart.n", "store"): [("store", "cart")],
        ("nothing.x", "variable"): [("variable", "nothing")],
    }
    assert {r.node for r in got if r.expression == "plan.name" and r.type == "loop-item"} == {"loop"}
