"""Where properties and values come from: lineage of a property, the steps around a focus, and the trace of a value.

What doesn't depend on a root is worked out once for the whole graph and then joined: what the expression of an edge adds to a chain, which node an input
resolves to, which literal a function's field returns. Loops run over ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions.rules import node_role
from assetloom.operators.resolution import resolve_expression
from assetloom.operators.traversal import nested_dependency_chain, pass_through_chain, trace, visibility_gates
from assetloom.plans.durable import cut, saved
from assetloom.plans.frontier import few, walk
from assetloom.plans.pointers import ancestors, nearest, preorder
from assetloom.plans.ranked import first_by


def _sink(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("prop:"), owner, F.lit(":"), name)


def flow_edges(flows: DataFrame) -> DataFrame:
    """(flow_id, a, b, type, label): what an expression tree adds to a chain. flows: flow_id, node_id, parent_id, ord, kind, name, property, callee, line, expression.

    Ends are structs (kind, name, line): a ``step`` of the expression, a ``sink`` (property of that name of the owner), the ``leaf`` (the node that the edge
    comes from) or the ``target`` (the property asked for). Members, awaits and names with a value pass on to their first child; a name is the target of what is below
    it. Nodes on that way, the name above each and what an await stands for are nearest nodes along pointers, so depth costs rounds in its logarithm only."""
    key = lambda n: F.struct("flow_id", F.col(n).alias("id"))
    first = flows.where("parent_id is not null").groupBy("flow_id", "parent_id").agg(F.min(F.struct("ord", "node_id")).alias("x")).select(F.col("flow_id").alias("c_flow"), F.col("parent_id").alias("c_parent"), F.col("x.node_id").alias("below"))
    f = flows.join(first, (F.col("flow_id") == F.col("c_flow")) & (F.col("node_id") == F.col("c_parent")), "left").drop("c_flow", "c_parent")
    f = saved(f.withColumn("passes", F.col("below").isNotNull() & F.col("kind").isin("await", "member", "identifier")))
    up = f.where("passes").select(F.struct("flow_id", F.col("below").alias("id")).alias("node"), key("node_id").alias("up"), F.col("parent_id").isNull().alias("top"), (F.col("kind") == "identifier").alias("named"))
    on_way = nearest(up, F.col("top")).select(F.col("node").alias("way"))
    above = nearest(up, F.col("named")).select(F.col("node").alias("under"), F.col("hit").alias("name_above"))
    kinds = f.select(key("node_id").alias("k"), ((F.col("kind") == "await") & F.col("passes")).alias("waits"))
    down = f.where("passes").select(key("node_id").alias("node"), F.struct("flow_id", F.col("below").alias("id")).alias("up")).join(kinds, F.col("up") == F.col("k"))
    stands = nearest(down, ~F.col("waits")).select(F.col("node").alias("s_node"), F.col("hit").alias("stands_for"))
    named = F.coalesce(F.col("name") != "", F.lit(False))
    step = lambda name: F.struct(F.lit("step").alias("kind"), name.alias("name"), F.col("line").alias("line"))
    none = F.lit(None).cast("string")
    end = lambda kind, name=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(None).cast(f.schema["line"].dataType).alias("line"))
    own = (
        F.when(F.col("kind").isin("call", "hook_call"), end("leaf"))
        .when((F.col("kind") == "member") & F.col("passes"), step(F.coalesce("property", F.lit("member"))))
        .when((F.col("kind") == "identifier") & F.col("passes"), step(F.coalesce("name", F.lit("binding"))))
        .when((F.col("kind") == "parameter") & named, end("sink", F.col("name")))
        .when((F.col("kind") == "identifier") & named, step(F.col("name")))
        .otherwise(end("leaf"))
    )
    own = saved(f.select(key("node_id").alias("node"), "flow_id", "parent_id", "kind", "passes", "expression", own.alias("own")))
    mine = own.select(F.col("node").alias("m_node"), F.col("own").alias("m_own"))
    at = own.join(on_way, F.col("node") == F.col("way"), "left").where("parent_id is null or way is not null").where("not (kind = 'await' and passes)")
    at = at.join(above, F.col("node") == F.col("under"), "left").join(mine, F.col("name_above") == F.col("m_node"), "left").withColumnRenamed("m_own", "target").drop("m_node")
    at = at.join(stands, F.col("node") == F.col("s_node"), "left").join(mine, F.col("stands_for") == F.col("m_node"), "left")
    out = F.struct(F.col("own").alias("a"), F.coalesce("target", end("target")).alias("b"), F.lit("prop_source").alias("type"), F.when(F.col("own.kind") == "leaf", F.col("expression")).alias("label"))
    within = F.when(F.col("passes") & (F.col("m_own") != F.col("own")), F.struct(F.col("m_own").alias("a"), F.col("own").alias("b"), F.lit("sequence").alias("type"), F.col("expression").alias("label")))
    return at.select("flow_id", F.explode(F.array_compact(F.array(out, within))).alias("x")).select("flow_id", "x.*")


def property_lineage(nodes: DataFrame, edges: DataFrame, flows: DataFrame, roots: DataFrame, max_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, prop, node, type, label, cut) and edges (root, prop, src, dst, type, label) of a property's origin.

    edges: src, dst, type (prop_source, passes_prop, calls, sequence), k, prop, passed_from, flow_id, callee. roots: root, prop. A chain goes from the property through the
    expressions of its value sources; where such an expression is a parameter of the parent that passes it on, or a call that isn't one of the parent's own sources, it goes on with the
    parent's property. A property without sources comes from the edges that pass it. ``cut`` marks properties that are followed no further because they are ``max_depth``
    parents away and have parents of their own. Only edges on a way to the property stay. Properties are compared without case.

    The loop runs over pairs of component and property; what a pair adds is worked out once, however many roots meet it."""
    tops = flows.where("parent_id is null").select(F.col("flow_id").alias("t_flow"), F.when(F.col("kind") == "parameter", F.nullif("name", F.lit(""))).alias("parameter"), F.col("name").alias("top_name"))
    calls = flows.where(F.col("kind").isin("call", "hook_call")).select(F.col("flow_id").alias("tree_id"), "node_id", F.coalesce("callee", "name").alias("called")).where("called is not null")
    placed = preorder(flows.select(F.col("flow_id").alias("tree_id"), "node_id", "parent_id", "ord")).join(calls, ["tree_id", "node_id"])
    callee = placed.groupBy(F.col("tree_id").alias("p_flow")).agg(F.min_by("called", "first").alias("called"))
    source = edges.where("type = 'prop_source'").select("src", F.col("dst").alias("component"), F.lower("prop").alias("low"), "passed_from", "flow_id")
    given = source.select(F.col("src").alias("g_src"), F.col("component").alias("g_dst")).distinct()
    s = source.join(tops, F.col("flow_id") == F.col("t_flow"), "left").join(callee, F.col("flow_id") == F.col("p_flow"), "left")
    s = saved(s.join(given, (F.col("src") == F.col("g_src")) & (F.col("passed_from") == F.col("g_dst")), "left").withColumn("own_source", F.col("g_src").isNotNull()).drop("t_flow", "p_flow", "g_src", "g_dst"))
    on = (F.col("component") == F.col("at")) & (F.col("low") == F.lower("name"))
    onward = F.coalesce("parameter", F.when(F.col("called").isNotNull() & ~F.col("own_source"), F.coalesce("top_name", "name")))

    frontier = cut(roots.select("root", "prop", F.col("root").alias("at"), F.col("prop").alias("name")).distinct())
    seen = frontier.withColumn("cut", F.lit(False))
    for depth in range(max_depth + 1):
        nxt = frontier.join(s, on).where("passed_from is not null").select("root", "prop", F.col("passed_from").alias("at2"), onward.alias("name2"), "at", "name").where("name2 is not null")
        new = saved(nxt.join(seen.select("root", "prop", F.col("at").alias("at2"), F.col("name").alias("name2")), ["root", "prop", "at2", "name2"], "left_anti"))
        if new.isEmpty():
            break
        if depth == max_depth:
            ended = new.select("root", "prop", "at", "name").distinct().withColumn("ended", F.lit(True))
            seen = seen.join(ended, ["root", "prop", "at", "name"], "left").select("root", "prop", "at", "name", F.coalesce("ended", "cut").alias("cut"))
        else:
            frontier = cut(new.select("root", "prop", F.col("at2").alias("at"), F.col("name2").alias("name")).distinct())
            seen = seen.unionByName(frontier.withColumn("cut", F.lit(False)))
    seen = saved(seen)

    pairs = seen.select("at", "name").distinct()
    sink, none = _sink(F.col("at"), F.col("name")), F.lit(None).cast("string")
    met = saved(pairs.join(s, on).withColumn("sink", sink))
    owner = F.coalesce("passed_from", "at")

    def end(x: str) -> Column:
        kind, name = F.col(f"{x}.kind"), F.col(f"{x}.name")
        step = F.concat(F.lit("step:"), owner, F.lit(":"), F.col(f"{x}.line").cast("string"), F.lit(":"), name)
        return F.when(kind == "leaf", F.col("src")).when(kind == "target", F.col("sink")).when(kind == "sink", _sink(owner, name)).otherwise(step)

    def rows(df: DataFrame, a: Column, b: Column, kind: Column | str, label: Column = none) -> DataFrame:
        return df.select("at", "name", a.alias("a"), b.alias("b"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), label.alias("label"))

    walked = met.join(flow_edges(flows).withColumnRenamed("flow_id", "f_flow").withColumnRenamed("a", "f_a").withColumnRenamed("b", "f_b"), F.col("flow_id") == F.col("f_flow"))
    passed = met.where("passed_from is not null")
    local = rows(walked, end("f_a"), end("f_b"), F.col("type"), F.col("label"))
    local = local.unionByName(rows(met.join(tops, F.col("flow_id") == F.col("t_flow"), "left_anti"), F.col("src"), F.col("sink"), "prop_source"))
    local = local.unionByName(rows(passed, F.col("passed_from"), F.col("sink"), "passes_prop"))
    local = local.unionByName(rows(passed.where("parameter is not null"), _sink(F.col("passed_from"), F.col("parameter")), F.col("sink"), "prop_source"))
    links = edges.where(F.col("type").isin("calls", "sequence")).select(F.col("src").alias("l_src"), F.col("dst").alias("l_dst"), F.col("type").alias("l_type"), "k", F.col("callee").alias("l_callee"))
    straight = passed.join(links.where("l_type = 'sequence'").select("l_src", "l_dst").distinct(), (F.col("passed_from") == F.col("l_src")) & (F.col("src") == F.col("l_dst")), "left")
    local = local.unionByName(rows(straight.where("l_src is not null"), F.col("passed_from"), F.col("src"), "sequence"))
    by_name = straight.where("l_src is null and called is not null").drop("l_src", "l_dst").join(links, (F.col("passed_from") == F.col("l_src")) & F.col("l_callee").contains(F.split_part("called", F.lit("."), F.lit(1))))
    local = local.unionByName(rows(by_name.groupBy("at", "name", "passed_from", "src").agg(F.min_by("l_type", F.struct("k", "l_type")).alias("l_type")), F.col("passed_from"), F.col("src"), F.col("l_type")))
    bare = pairs.join(s.select("component", "low").distinct(), on, "left_anti")
    passing = edges.where("type = 'passes_prop'").select("src", F.col("dst").alias("component"), F.lower("prop").alias("low"))
    local = saved(local.unionByName(rows(bare.join(passing, on), F.col("src"), sink, "passes_prop")).groupBy("at", "name", "a", "b", "type").agg(F.min("label").alias("label")))

    every = saved(seen.join(local, ["at", "name"]).groupBy("root", "prop", F.col("a").alias("src"), F.col("b").alias("dst"), "type").agg(F.min("label").alias("label")))
    of = lambda x: F.struct("root", "prop", F.col(x).alias("id"))
    starts = roots.select(F.struct("root", "prop").alias("of"), F.struct("root", "prop", _sink(F.col("root"), F.col("prop")).alias("id")).alias("node")).distinct().withColumnRenamed("of", "root")
    kept = saved(walk(every.select(of("dst").alias("src"), of("src").alias("dst")).distinct(), starts).select("node.*"))
    edges_out = every.join(kept.withColumnRenamed("id", "dst"), ["root", "prop", "dst"], "left_semi").select("root", "prop", "src", "dst", "type", "label")
    kinds = nodes.select(F.col("node").alias("id"), F.col("type").alias("n_type"), F.col("label").alias("n_label"))
    marks = seen.groupBy("root", "prop", sink.alias("id")).agg(F.max("cut").alias("cut"))
    prefix = F.split_part("id", F.lit(":"), F.lit(1))
    type_ = F.when(prefix == "prop", "prop").when(prefix == "step", "variable").when(prefix.isin("builtin", "external"), prefix).otherwise(F.col("n_type"))
    label = F.when(prefix.isin("prop", "step"), F.element_at(F.split("id", ":"), -1)).when(prefix.isin("builtin", "external"), F.replace(F.expr("substring(id, length(split_part(id, ':', 1)) + 2)"), F.lit("#"), F.lit(" · "))).otherwise(F.col("n_label"))
    out = kept.join(kinds, "id", "left").join(marks, ["root", "prop", "id"], "left")
    return out.select("root", "prop", F.col("id").alias("node"), type_.alias("type"), label.alias("label"), F.coalesce("cut", F.lit(False)).alias("cut")), edges_out


def node_inputs(nodes: DataFrame) -> DataFrame:
    """(node, i, expression): what a hook or condition reads, in order. nodes: as for ``expression_lookup``."""
    read = F.when(F.col("type") == "hook", F.transform("inputs", lambda x: F.coalesce(x["source"], x["name"]))).when(F.col("type") == "condition", F.col("reads"))
    return nodes.select("node", F.posexplode(read).alias("i", "expression")).where("trim(expression) <> ''")


def focus_steps(nodes: DataFrame, edges: DataFrame, roots: DataFrame, passes: DataFrame, lookup: DataFrame, priority: dict[str, int], down_types: list[str], down_depth: int = 6, gate: str = "condition", uses: str = "uses_hook", calls: str = "calls", owners: tuple[str, ...] = ("component", "page")) -> DataFrame:
    """(root, ord, node, depth, role, expression, next, link): what feeds a focus, farthest first, the focus, and what is below it, each linked to the next.

    Above a focus are its gates, then the expressions of the properties passed to it (node, ord, expression), of its own inputs if it is a hook, and what it uses and calls. An
    expression stands for the node that it resolves to in ``lookup``; that node's inputs follow one step farther up, and so on. A node comes once, where it is met first in
    that order. Expressions are resolved once for the whole graph, so the walk is over (node, input, node) and each node of a root is opened once, or again where it is met earlier.
    Numbers are given by depth, so that no task sorts all steps of a root."""
    given = node_inputs(nodes)
    texts = given.select("expression").unionByName(passes.select("expression")).distinct()
    answer = saved(resolve_expression(texts.select(F.col("expression").alias("expr_id"), "expression"), lookup).select(F.col("expr_id").alias("asked"), F.col("node").alias("source")))
    feeds = saved(given.join(answer, F.col("expression") == F.col("asked")).select(F.col("node").alias("of"), F.col("i").cast("long").alias("i"), "expression", "source"))
    kinds = nodes.select(F.col("node").alias("id"), F.col("type").alias("kind"))
    w = Window.partitionBy("root").orderBy(F.col("ord").desc())
    has = given.select(F.col("node").alias("g")).distinct().withColumn("has", F.lit(1))
    gates = visibility_gates(edges, nodes, roots, priority, gate).join(has, F.col("gate") == F.col("g"), "left").withColumn("has", F.coalesce("has", F.lit(0)))
    gates = saved(gates.select("root", "gate", (F.row_number().over(w) - 1).cast("long").alias("j"), "has", (-F.row_number().over(w) - F.sum("has").over(w) + F.col("has")).cast("int").alias("depth")))
    below = gates.groupBy("root").agg((-1 - F.count(F.lit(1)) - F.sum("has")).cast("int").alias("base"))
    base = roots.select("root").distinct().join(below, "root", "left").select("root", F.coalesce("base", F.lit(-1)).alias("base"))
    base = saved(base.join(kinds, F.col("root") == F.col("id"), "left").select("root", "base", "kind"))
    path = lambda *xs: F.array(*(x if isinstance(x, Column) else F.lit(x).cast("long") for x in xs))
    none = F.lit(None).cast("string")
    fed = gates.join(feeds, F.col("gate") == F.col("of")).select("root", F.col("source").alias("node"), (F.col("depth") - 1).alias("depth"), path(0, F.col("j"), F.col("i") + 1).alias("key"), "expression")
    props = passes.select(F.col("node").alias("of"), F.col("ord").cast("long").alias("i"), "expression").join(answer, F.col("expression") == F.col("asked"))
    fed = fed.unionByName(base.join(props, F.col("root") == F.col("of")).select("root", F.col("source").alias("node"), F.col("base").alias("depth"), path(1, F.col("i")).alias("key"), "expression"))
    fed = fed.unionByName(base.where("kind = 'hook'").join(feeds, F.col("root") == F.col("of")).select("root", F.col("source").alias("node"), (F.col("base") - 1).alias("depth"), path(2, F.col("i")).alias("key"), "expression"))
    used = base.where(F.col("kind").isin(*owners)).join(edges.where(F.col("type").isin(uses, calls)), F.col("root") == F.col("src")).join(kinds.select("id"), F.col("dst") == F.col("id"), "left_semi")
    plain = used.select("root", F.col("dst").alias("node"), (F.col("base") - F.when(F.col("type") == uses, 1).otherwise(2)).alias("depth"), path(3, F.col("k").cast("long")).alias("key"), F.col("type").alias("expression"))
    plain = plain.unionByName(gates.select("root", F.col("gate").alias("node"), "depth", path(0, F.col("j"), 0).alias("key"), none.alias("expression")))

    first = lambda df: df.groupBy("root", "node").agg(F.min(F.struct("key", "depth", "expression")).alias("x")).select("root", "node", "x.*")
    frontier = saved(first(fed))
    seen = frontier
    while True:
        deeper = frontier.join(feeds, F.col("node") == F.col("of")).select("root", F.col("source").alias("node"), (F.col("depth") - 1).alias("depth"), F.concat("key", F.array("i")).alias("key"), feeds["expression"])
        met = seen.select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("key").alias("old"))
        frontier = saved(first(deeper).join(met, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left").where("old is null or key < old").select("root", "node", "key", "depth", "expression"))
        if frontier.isEmpty():
            break
        seen = saved(first(seen.unionByName(frontier)))
    up = first(seen.unionByName(plain)).where("node <> root")
    role = lambda df: df.join(kinds, F.col("node") == F.col("id"), "left").drop("id")
    down = trace(edges, nodes, roots, down_types, down_depth).where("depth > 0").select("root", "node", "depth", path().cast("array<long>").alias("key"), none.alias("expression"))
    focus = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), path().cast("array<long>").alias("key"), none.alias("expression")).distinct()
    every = saved(role(up.select(*down.columns).unionByName(focus).unionByName(down)))
    before = every.groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("root").orderBy("depth")) - F.col("n")).select("root", "depth", "before")
    level = Window.partitionBy("root", "depth").orderBy("key", "node")
    numbered = saved(every.withColumn("place", F.row_number().over(level)).join(before, ["root", "depth"]).withColumn("ord", (F.col("before") + F.col("place")).cast("int")))
    after = numbered.select(F.col("root").alias("a_root"), (F.col("ord") - 1).alias("a_ord"), F.col("node").alias("next"), F.col("depth").alias("next_depth"))
    linked = numbered.join(after, (F.col("root") == F.col("a_root")) & (F.col("ord") == F.col("a_ord")), "left")
    label = F.coalesce(F.col("label"), F.col("type")) if "label" in edges.columns else F.col("type")
    between = edges.groupBy("src", "dst").agg(F.min_by(label, F.struct("k", "type")).alias("by"))
    there = between.select(F.col("src").alias("t_src"), F.col("dst").alias("t_dst"), F.col("by").alias("there"))
    back = between.select(F.col("src").alias("b_src"), F.col("dst").alias("b_dst"), F.col("by").alias("back"))
    linked = linked.join(there, (F.col("node") == F.col("t_src")) & (F.col("next") == F.col("t_dst")), "left").join(back, (F.col("next") == F.col("b_src")) & (F.col("node") == F.col("b_dst")), "left")
    link = F.when(F.col("next").isNotNull(), F.coalesce("there", "back", F.when(F.col("next_depth") > 0, "renders").otherwise("feeds")))
    return linked.select("root", "ord", "node", "depth", F.when(F.col("node") == F.col("root"), "focus").otherwise(node_role(F.col("kind"))).alias("role"), "expression", "next", link.alias("link"))


def return_literals(returns: DataFrame) -> DataFrame:
    """(function, field, literal): the literal that a function returns in a field, its own or that of the function whose result it passes on.

    returns: function, field, and literal or callee and callee_field. Summaries are worked out from the bottom up along pointers, for all functions at once; recursion without a literal has none."""
    r = saved(first_by(returns, ["function", "field"], [F.col("literal").isNull(), "literal", "callee", "callee_field"]))
    own = r.where("literal is not null").select(F.struct("function", "field").alias("key"), "literal")
    parents = r.where("literal is null and callee is not null").select(F.struct("function", "field").alias("node"), F.struct(F.col("callee").alias("function"), F.col("callee_field").alias("field")).alias("up"))
    found = nearest(parents.join(own.select("key", "literal"), F.col("up") == F.col("key"), "left"), F.col("literal").isNotNull(), "literal")
    return own.select("key.function", "key.field", "literal").unionByName(found.select("node.function", "node.field", "literal"))


def value_trace(roots: DataFrame, nodes: DataFrame, edges: DataFrame, lookup: DataFrame, plain_lookup: DataFrame, locals_: DataFrame, flows: DataFrame, bindings: DataFrame, loops: DataFrame, parents: DataFrame, returns: DataFrame, calls: DataFrame) -> DataFrame:
    """(root, expression, prop, ord, origin, role, type, node, label): where the value of an expression at a consumer comes from, step by step.

    roots: root (the consumer), expression, prop (null if it isn't the value of a property). Origins, the first that applies:

    * ``hook-local``: a local that a hook assigns: the local, the hook, the hooks it depends on;
    * ``derived-local``: a local worked out from others: the local and the first fetch among what it refers to, properties first;
    * ``fetch``: parents that pass the property on, the variable, the call and what it calls, and the literal if the field is one;
    * ``binding``, ``loop``, ``variable``: of a module, by the consumer's file and then any; of the nearest loop around the consumer with that item; or neither;
    * ``hook-field``, ``context``, ``store``: by what the expression resolves to.

    locals_: consumer, name, source_hook, hook_node, derived, refs (names, in order), props (those of them that are properties). flows: parent, child, prop, expression. bindings: file, name, ord, call.
    loops: node, item, source. parents: node, up. returns: as for ``return_literals``. calls: node, ord, kind, label (the call tree of a fetch in preorder). nodes: as for ``expression_lookup``, with path.
    Properties resolve in ``plain_lookup``, which has no inputs of hooks."""
    none = F.lit(None).cast("string")
    field = lambda x: F.when(F.col(x).contains("."), F.expr(f"substring({x}, instr({x}, '.') + 1)"))
    q = saved(roots.select("root", "expression", "prop").distinct().withColumn("q", F.xxhash64("root", "expression", "prop")))
    own = locals_.select("consumer", "name", "source_hook", "hook_node", "derived", "refs", "props")
    own = first_by(own, ["consumer", "name"], [F.col("source_hook").isNull(), F.col("derived").desc(), "source_hook"])
    q = q.join(own, F.col("prop").isNull() & ~F.col("expression").contains(".") & (F.col("root") == F.col("consumer")) & (F.col("expression") == F.col("name")), "left").drop("consumer", "name")
    is_local = F.col("source_hook").isNotNull() | F.coalesce("derived", F.lit(False))

    # what properties are where they are first handed over, for those asked for and those that locals refer to
    ordered = F.expr("concat(filter(refs, x -> array_contains(props, x)), filter(refs, x -> not array_contains(props, x)))")
    refs = q.where("derived and source_hook is null").select("q", "root", "props", F.posexplode(ordered).alias("i", "ref"))
    wanted = q.where("prop is not null").select("root", "prop").unionByName(refs.select("root", F.col("ref").alias("prop"))).distinct()
    through = saved(pass_through_chain(flows, wanted))
    last = through.groupBy(F.col("root").alias("l_root"), F.col("prop").alias("l_prop")).agg(F.max_by("expression", "ord").alias("given"))
    takes = F.col("given").isNotNull() & ((F.col("expression") == F.col("prop")) | (F.col("expression") == F.col("given")) | ~F.col("expression").contains("."))
    q = q.join(last, (F.col("root") == F.col("l_root")) & (F.col("prop") == F.col("l_prop")), "left").drop("l_root", "l_prop")
    q = saved(q.withColumn("traced", F.when(takes, F.col("given")).otherwise(F.col("expression"))))
    refs = refs.join(last, (F.col("root") == F.col("l_root")) & (F.col("ref") == F.col("l_prop")), "left").withColumn("traced", F.coalesce("given", "ref"))
    refs = saved(refs.select("q", "root", "i", "ref", "traced", F.array_contains("props", F.col("ref")).alias("is_prop")))

    # all expressions are resolved at once
    texts = lambda df: df.select(F.col("traced").alias("expr_id"), F.col("traced").alias("expression")).distinct()
    with_prop = resolve_expression(texts(q.where("prop is not null").select("traced").unionByName(refs.select("traced"))), plain_lookup).select(F.lit(True).alias("plain"), "expr_id", "node")
    without = resolve_expression(texts(q.where("prop is null").where(~is_local)), lookup).select(F.lit(False).alias("plain"), "expr_id", "node")
    catalog = nodes.select(F.col("node").alias("n_node"), F.col("type").alias("n_type"), F.col("label").alias("n_label"), F.col("name").alias("n_name"), F.col("outputs").alias("n_outputs"), F.col("path").alias("n_path"))
    answer = cut(with_prop.unionByName(without))
    answer = saved(few(answer, answer.count()).join(catalog, F.col("node") == F.col("n_node")).withColumnRenamed("node", "source"))
    by_ref = refs.join(answer.where("plain and n_type = 'data-fetch'"), F.col("traced") == F.col("expr_id"))
    by_ref = first_by(by_ref, ["q"], ["i"]).select("q", "root", "traced", F.when(F.col("is_prop"), F.col("ref")).alias("via"), "source", "n_name", "n_outputs")
    at = saved(q.where(~is_local).join(answer, (F.col("traced") == F.col("expr_id")) & (F.col("prop").isNotNull() == F.col("plain")), "left"))

    literals = saved(return_literals(returns))

    def steps(df: DataFrame, section: int, role: str, kind: str, node: Column, label: Column, pos: Column | int = 0) -> DataFrame:
        return df.select("q", F.lit(section).alias("section"), (pos if isinstance(pos, Column) else F.lit(pos)).cast("int").alias("pos"), F.lit(role).alias("role"), F.lit(kind).alias("type"), node.alias("node"), label.alias("label"))

    def handing(df: DataFrame, prop: str, section: int) -> DataFrame:
        way = through.select(F.col("root").alias("w_root"), F.col("prop").alias("w_prop"), F.col("ord").alias("w_ord"), F.col("node").alias("w_node"))
        return steps(df.join(way, (F.col("root") == F.col("w_root")) & (F.col(prop) == F.col("w_prop"))), section, "prop", "prop", F.col("w_node"), F.col(prop), F.col("w_ord"))

    def fetched(df: DataFrame, prop: str) -> DataFrame:
        variable = F.coalesce(F.try_element_at("n_outputs", F.lit(1)), F.split_part("traced", F.lit("."), F.lit(1)))
        out = handing(df.where(F.col(prop).isNotNull()), prop, 10).unionByName(steps(df, 11, "variable", "variable", F.col("source"), variable))
        out = out.unionByName(steps(df, 12, "await-call", "data-fetch", F.col("source"), F.concat("n_name", F.lit("()"))))
        tree = df.select("q", "source").join(calls.select(F.col("node").alias("c_node"), F.col("ord").alias("c_ord"), F.col("kind").alias("c_kind"), F.col("label").alias("c_label")), F.col("source") == F.col("c_node"))
        for kind, role in (("api", "api-call"), ("function", "function")):
            part = tree.where(F.col("c_kind") == kind) if kind == "api" else tree.where("c_kind <> 'api'")
            out = out.unionByName(steps(part, 13, role, kind, F.col("source"), F.col("c_label"), F.col("c_ord")))
        known = literals.select(F.col("function").alias("r_function"), F.col("field").alias("r_field"), "literal")
        told = df.withColumn("f", field("traced")).join(known, (F.col("n_name") == F.col("r_function")) & (F.col("f") == F.col("r_field")))
        return out.unionByName(steps(told, 14, "hardcode", "hardcode", F.col("source"), F.concat(F.lit("Hard code: "), "literal")))

    def nested(df: DataFrame, hook: str, name: str, section: int, mark: str = "") -> DataFrame:
        chain = nested_dependency_chain(edges, df.select(F.col(hook).alias("root"), F.col(name).alias("field")).distinct()).select(F.col("root").alias("d_root"), F.col("field").alias("d_field"), F.col("ord").alias("d_ord"), F.col("node").alias("d_node"))
        found = df.join(chain, (F.col(hook) == F.col("d_root")) & (F.col(name) == F.col("d_field"))).join(catalog, F.col("d_node") == F.col("n_node"))
        return steps(found, section, "hook", "hook", F.col("d_node"), F.concat(F.lit(mark), "n_label"), F.col("d_ord"))

    def bound(df: DataFrame, name: str, section: int) -> DataFrame:
        out = steps(df, section, "variable", "binding", F.col("b_node"), F.col(name))
        return out.unionByName(steps(df.where("b_call is not null"), section + 1, "function", "function", F.col("b_node"), F.concat("b_call", F.lit("()"))))

    def with_binding(df: DataFrame, name: str) -> DataFrame:
        """The first binding of that name in the consumer's file, or else in any."""
        b = bindings.select(F.col("file").alias("b_file"), F.col("name").alias("b_name"), F.col("ord").alias("b_ord"), F.col("call").alias("b_call"))
        here = first_by(b, ["b_file", "b_name"], ["b_ord"]).select("b_file", "b_name", F.struct("b_file", "b_call").alias("here"))
        any_ = first_by(b, ["b_name"], ["b_ord", "b_file"]).select(F.col("b_name").alias("y_name"), F.struct("b_file", "b_call").alias("anywhere"))
        joined = df.join(here, (F.col("r_path") == F.col("b_file")) & (F.col(name) == F.col("b_name")), "left").join(any_, F.col(name) == F.col("y_name"), "left")
        hit = F.coalesce("here", "anywhere")
        return joined.withColumns({"b_node": F.concat(hit["b_file"], F.lit("#"), F.col(name)), "b_call": hit["b_call"]}).drop("b_file", "b_name", "y_name", "here", "anywhere")

    parts = []
    hooked = q.where("source_hook is not null").join(nodes.select(F.col("node").alias("k_node"), F.col("type").alias("k_type"), F.col("label").alias("k_label")), (F.col("hook_node") == F.col("k_node")) & (F.col("k_type") == "hook"), "left")
    by_label = nodes.where("type = 'hook'").groupBy(F.col("label").alias("y_label")).agg(F.min_by("node", "ord").alias("y_node"))
    hooked = saved(hooked.join(by_label, F.col("source_hook") == F.col("y_label"), "left").withColumn("hook_at", F.coalesce("k_node", "y_node")))
    parts.append(("hook-local", steps(hooked, 0, "variable", "local", F.col("root"), F.col("expression"))))
    parts.append(("hook-local", steps(hooked.where("hook_at is not null"), 1, "hook", "hook", F.col("hook_at"), F.col("source_hook"))))
    parts.append(("hook-local", nested(hooked.where("hook_at is not null").select("q", "hook_at", "expression"), "hook_at", "expression", 2)))
    parts.append(("derived-local", steps(q.where("derived and source_hook is null"), 0, "variable", "local", F.col("root"), F.col("expression"))))
    parts.append(("derived-local", fetched(saved(by_ref), "via")))
    parts.append(("fetch", fetched(at.where("n_type = 'data-fetch'"), "prop")))
    name = F.split_part("traced", F.lit("."), F.lit(1))
    consumers = cut(q.select(F.col("root").alias("p_node")).distinct())
    paths = nodes.select(F.col("node").alias("p_node"), F.col("path").alias("r_path")).join(few(consumers, consumers.count()), "p_node", "left_semi")
    rest = at.where("coalesce(n_type, '') <> 'data-fetch' and (prop is not null or source is null)").withColumn("name", name).join(paths, F.col("root") == F.col("p_node"), "left")
    rest = saved(with_binding(rest, "name"))
    parts.append(("binding", bound(rest.where("b_node is not null"), "name", 11)))
    open_ = rest.where("b_node is null").drop("b_node", "b_call")
    around = ancestors(parents.select("node", "up"), open_.select("root", F.col("root").alias("node")).distinct())
    held = around.join(loops.select(F.col("node").alias("o_node"), "item", F.col("source").alias("o_source")), F.col("node") == F.col("o_node")).where("dist > 0").select(F.col("root").alias("o_root"), "o_node", "item", "o_source", "dist")
    held = first_by(held, ["o_root", "item"], ["dist", "o_source"])
    looped = saved(open_.join(held, (F.col("root") == F.col("o_root")) & (F.col("name") == F.col("item")), "left").withColumn("f", field("traced")))
    inside = with_binding(looped.where("o_node is not null and o_source is not null"), "o_source")
    inside = saved(inside)
    parts.append(("loop", steps(inside.where("f is not null"), 11, "variable", "member", F.col("root"), F.col("traced"))))
    parts.append(("loop", steps(inside, 12, "variable", "loop-item", F.col("o_node"), F.col("name"))))
    parts.append(("loop", bound(inside.where("b_node is not null"), "o_source", 13)))
    parts.append(("loop", steps(inside.where("b_node is null"), 13, "variable", "binding", F.col("root"), F.col("o_source"))))
    parts.append(("variable", steps(looped.where("o_node is null and prop is null"), 11, "variable", "variable", F.col("root"), F.col("name"))))
    for origin, part in (("binding", rest.where("b_node is not null")), ("loop", looped.where("o_node is not null")), ("variable", looped.where("o_node is null"))):
        parts.append((origin, handing(part.where("prop is not null"), "prop", 10)))
    hook = saved(at.where("n_type = 'hook' and prop is null").withColumn("name", name))
    parts.append(("hook-field", steps(hook.where("name <> n_label and array_contains(n_outputs, name)"), 11, "variable", "field", F.col("source"), F.col("name"))))
    parts.append(("hook-field", steps(hook, 12, "hook", "hook", F.col("source"), F.concat(F.lit("(hook) "), "n_label"))))
    parts.append(("hook-field", nested(hook.select("q", "source", "name"), "source", "name", 13, "(hook) ")))
    for kind in ("context", "store"):
        parts.append((kind, steps(at.where(f"n_type = '{kind}' and prop is null"), 11, kind, kind, F.col("source"), F.col("n_label"))))
    every = None
    for origin, part in parts:
        part = part.withColumn("origin", F.lit(origin))
        every = part if every is None else every.unionByName(part)
    of = q.select(F.col("q").alias("of"), "root", "expression", "prop")
    numbered = every.withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy("section", "pos", "node", "label")))
    return numbered.join(of, F.col("q") == F.col("of")).select("root", "expression", "prop", "ord", "origin", "role", "type", "node", "label")
