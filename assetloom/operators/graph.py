"""Graph construction and clean-up: edges are (type, src, dst, k), k being the natural key that orders them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.plans.durable import saved
from assetloom.plans.frontier import adjacency, looked_up, walk
from assetloom.plans.pointers import lifted, nearest
from assetloom.plans.ranked import first_by


def edge_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", F.concat("src", F.lit("->"), "dst", F.lit(":"), "type", F.lit(":"), F.col("k").cast("string")))


def dedupe_edges_by_id(edges: DataFrame, ident: list[str]) -> DataFrame:
    """One row for each id: the last value and the first position."""
    return edges.groupBy(*ident).agg(F.min("k").alias("position"), F.max("k").alias("k"))


def collapse_parallel_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (type, src, dst): the first."""
    return edges.groupBy("type", "src", "dst").agg(F.min("k").alias("k"))


def prefer_type_per_pair(edges: DataFrame, preferred: list[str]) -> DataFrame:
    """One edge for each pair: the last of a preferred type, else the first."""
    wanted = F.col("type").isin(preferred)
    best = F.max(F.when(wanted, F.struct("k", "type"))).alias("p")
    return edges.groupBy("src", "dst").agg(best, F.min(F.struct("k", "type")).alias("f")).select("src", "dst", F.coalesce("p.type", "f.type").alias("type"), F.coalesce("p.k", "f.k").alias("k"))


def priority_edge_per_pair(edges: DataFrame, priorities: dict[str, int], unknown: int = 99) -> DataFrame:
    """One edge for each pair: that of the least priority, then the first."""
    p = F.create_map(*(x for t, n in priorities.items() for x in (F.lit(t), F.lit(n))))
    rank = F.coalesce(F.try_element_at(p, F.col("type")), F.lit(unknown))
    return edges.groupBy("src", "dst").agg(F.min(F.struct(rank.alias("priority"), "k", "type")).alias("x")).select("src", "dst", "x.type", "x.k", "x.priority")


def drop_implied_edges(edges: DataFrame, sequence: list[str], implied: list[str]) -> DataFrame:
    """Without edges of the implied types whose target is reached from their source along sequence edges.

    Sequences are chains and trees nearly always: there a node's ancestors are told apart by their distance from the top, so "reached" means that the source is the ancestor of the
    target at the source's own distance, which pointer doubling finds. Nodes that nothing follows and no pair ends at are left out. Only where nodes have several predecessors, or go
    round in circles, is what the comparison doesn't settle walked for, from the sources of those pairs."""
    e = saved(edges)
    pairs = saved(e.where(F.col("type").isin(implied) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    steps = saved(adjacency(e, "out", sequence).where("src <> dst"))
    asked = steps.select(F.col("src").alias("dst")).unionByName(pairs.select("dst")).distinct()
    first = saved(steps.join(asked, "dst", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("up"), F.count(F.lit(1)).alias("n")))
    has = first.select(F.col("node").alias("h"))
    tops = saved(nearest(first.join(has, F.col("up") == F.col("h"), "left"), F.col("h").isNull()))
    below = saved(pairs.join(tops.select(F.col("node").alias("dst"), F.col("hit").alias("top"), F.col("dist").alias("far")), "dst"))
    inner = below.where("src <> top").join(tops.select(F.col("node").alias("src"), F.col("dist").alias("near")), "src").where("far > near")
    met = lifted(first.join(tops.select("node"), "node", "left_semi"), inner.select("src", "dst", F.col("dst").alias("node"), (F.col("far") - F.col("near")).alias("steps")))
    gone = below.where("src = top").select("src", "dst").unionByName(met.where("src = node").select("src", "dst"))
    if not (first.where("n > 1").isEmpty() and first.join(tops, "node", "left_anti").isEmpty()):
        gone = saved(gone)
        open_ = saved(pairs.join(gone, ["src", "dst"], "left_anti"))
        met = walk(steps, open_.select(F.col("src").alias("root")).distinct()).where("depth > 0")
        gone = gone.unionByName(open_.join(met, (open_["src"] == met["root"]) & (open_["dst"] == met["node"]), "left_semi"))
    return e.where(~F.col("type").isin(implied)).unionByName(e.where(F.col("type").isin(implied)).join(gone, ["src", "dst"], "left_anti"))


def build_nodes(*writes: DataFrame) -> DataFrame:
    """Nodes (node, type, label, path) written one frame after the other: the last write of an id wins."""
    out = None
    for i, w in enumerate(writes):
        w = w.select("node", "type", "label", "path", F.lit(i).alias("write"))
        out = w if out is None else out.unionByName(w)
    return out.groupBy("node").agg(F.max(F.struct("write", "type", "label", "path")).alias("x")).select("node", "x.type", "x.label", "x.path")


def edges_sequence(steps: DataFrame, drop_kinds: list[str]) -> DataFrame:
    """Steps of an owner in order, without dropped kinds and steps on itself, the first of each (kind, target), ranked from 1."""
    s = steps.where(~F.col("kind").isin(drop_kinds) & F.col("target").isNotNull() & (F.col("target") != F.col("owner").cast("string")))
    s = first_by(s, ["owner", "kind", "target"], ["ts", "ord"])
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("owner").orderBy("ts", "ord")))


def merge_steps(ranks: dict[str, int], *steps: DataFrame) -> DataFrame:
    """Steps of several kinds as one numbered sequence per owner, by place, rank of the kind, order and kind."""
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    p = F.create_map(*(x for t, n in ranks.items() for x in (F.lit(t), F.lit(n))))
    out = out.withColumn("rank", F.coalesce(F.try_element_at(p, F.col("kind")), F.lit(len(ranks))))
    return out.withColumn("number", F.row_number().over(Window.partitionBy("owner").orderBy("place", "rank", "ord", "kind")))


def edges_dynamic(refs: DataFrame, symbols: DataFrame, prefer: str = "component") -> DataFrame:
    """From the owner of a lazy reference (owner, asset, line) to the first symbol of the preferred type in that asset, else to the asset."""
    first = symbols.where(F.col("type") == prefer).groupBy("asset").agg(F.min(F.struct("ord", "symbol")).alias("x")).select("asset", F.col("x.symbol").alias("symbol"))
    return refs.join(first, "asset", "left").select(F.col("owner").alias("src"), F.coalesce("symbol", "asset").alias("dst"), F.lit("dynamic_imports").alias("type"), F.col("line").alias("k"))


def edges_calls(calls: DataFrame, hooks: DataFrame) -> DataFrame:
    """Call edges (owner, target, kind, line) without calls whose root is a hook of the owner and without calls of itself."""
    root = F.split_part("name", F.lit("."), F.lit(1))
    own = hooks.select(F.col("owner").alias("hook_owner"), F.col("hook").alias("hook_name")).distinct()
    left = calls.withColumn("root", root).join(own, (F.col("owner") == F.col("hook_owner")) & (F.col("root") == F.col("hook_name")), "left_anti")
    return left.where("owner <> target").groupBy(F.col("owner").alias("src"), F.col("target").alias("dst"), F.col("line").alias("k")).agg(F.min("kind").alias("kind")).withColumn("type", F.lit("calls"))


def edges_imports(refs: DataFrame) -> DataFrame:
    """From the owner of a resolved reference (owner, target, path) to the asset, or to the target as it is written where there is none."""
    return refs.select(F.col("owner").alias("src"), F.coalesce("path", "target").alias("dst"), F.lit("imports").alias("type")).distinct()


def _to_symbols(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """References (ref_id, owner, source, name) with the symbol that they render, where there is one."""
    from assetloom.operators.resolution import resolve_render_target

    return refs.join(resolve_render_target(refs.select("ref_id", "source", "name"), imports, symbols).select("ref_id", "symbol"), "ref_id")


def edges_renders(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """From the owner of an element (ref_id, owner, source, name) to the symbol of its name: by imports, then anywhere."""
    return _to_symbols(refs, imports, symbols).select(F.col("owner").alias("src"), F.col("symbol").alias("dst"), F.lit("renders").alias("type")).distinct()


def edges_uses(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """From the owner of a call (ref_id, owner, source, name) to the hook of its name."""
    hooks = symbols.where("type = 'hook'").select("symbol").distinct()
    return _to_symbols(refs, imports, symbols).join(hooks, "symbol", "left_semi").select(F.col("owner").alias("src"), F.col("symbol").alias("dst"), F.lit("uses_hook").alias("type")).distinct()


def edges_passes(passes: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """From the owner of an element with properties (ref_id, owner, source, name, ord, names, values) to the symbol of its name, with the properties as text."""
    summary = F.array_join(F.transform(F.arrays_zip("names", "values"), lambda x: F.concat(x["names"], F.lit("="), x["values"])), ", ")
    return _to_symbols(passes, imports, symbols).select(F.col("owner").alias("src"), F.col("symbol").alias("dst"), F.lit("passes_prop").alias("type"), F.col("ord").alias("k"), summary.alias("summary"))


def resolved_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame, hooks: DataFrame) -> DataFrame:
    """Call edges of calls as they are written: ref_id, owner, source, callee, line."""
    from assetloom.operators.resolution import resolve_call_target

    found = resolve_call_target(calls.select("ref_id", "source", "callee"), imports, symbols)
    return edges_calls(calls.join(found, "ref_id").select("owner", F.col("dst").alias("target"), "kind", "line", F.col("callee").alias("name")), hooks)


def resolved_value_sources(flows: DataFrame, trees: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Value-source edges of flows (flow_id, child, prop, value, line, owner, source) whose expressions are ``trees`` (tree_id, the flow's; node_id, parent_id, ord, kind, name)."""
    from assetloom.operators.resolution import resolve_flow_target

    found = resolve_flow_target(trees, flows.select(F.col("flow_id").alias("tree_id"), "source"), imports, symbols)
    return edges_value_source(flows, found.select(F.col("tree_id").alias("flow_id"), "dst"))


def build_edges(symbols: DataFrame, imports: DataFrame, refs: DataFrame | None = None, renders: DataFrame | None = None, uses: DataFrame | None = None, passes: DataFrame | None = None, calls: DataFrame | None = None, hooks: DataFrame | None = None) -> DataFrame:
    """All edges (type, src, dst, k) of a catalog whose names are looked up in ``symbols`` by ``imports``. What isn't given has no edges; the frames are those of the builders above."""
    made = [] if refs is None else [edges_imports(refs)]
    made += [build(f, imports, symbols) for build, f in ((edges_renders, renders), (edges_uses, uses), (edges_passes, passes)) if f is not None]
    if calls is not None:
        made.append(resolved_calls(calls, imports, symbols, calls.select("owner", F.lit("").alias("hook")).limit(0) if hooks is None else hooks))
    out = [e.select("type", "src", "dst", (F.col("k") if "k" in e.columns else F.lit(0)).cast("long").alias("k")) for e in made]
    if not out:
        raise ValueError("nothing to build edges from")
    all_ = out[0]
    for e in out[1:]:
        all_ = all_.unionByName(e)
    return all_


def edges_value_source(flows: DataFrame, targets: DataFrame) -> DataFrame:
    """From the source of a value to the child that takes it: flows (flow_id, child, prop, value, line, owner) with targets (flow_id, dst)."""
    return flows.join(targets, "flow_id").select(F.col("dst").alias("src"), F.col("child").alias("dst"), F.lit("prop_source").alias("type"), "prop", "value", F.col("line").alias("k"), "owner")


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes. Targets are looked up first: where few edges lead to a node, they rule out more than sources do, so less is brought together for the second lookup."""
    ids = looked_up(nodes.select("node"))
    kept = edges.join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept.join(ids.withColumnRenamed("node", "src"), "src", "left_semi")


def filter_layer(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label or path holds the text, and the edges among them."""
    hit = nodes.where(F.lower("label").contains(text.lower()) | F.lower("path").contains(text.lower()))
    return hit, among(edges, hit)


def layer_component(nodes: DataFrame, edges: DataFrame, visible: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of visible types and the edges with both ends among them."""
    shown = nodes.where(F.col("type").isin(visible))
    return shown, among(edges, shown)


def layer_chain(entries: DataFrame, key: str, order: list[str], first_type: str, other_type: str) -> DataFrame:
    """Edges between consecutive entries of each key; the first edge may have a type of its own."""
    w = Window.partitionBy(key).orderBy(*order)
    out = entries.withColumns({"next": F.lead("node").over(w), "place": F.row_number().over(w)}).where(F.col("next").isNotNull())
    return out.select(key, F.col("node").alias("src"), F.col("next").alias("dst"), F.when(F.col("place") == 1, first_type).otherwise(other_type).alias("type"), F.col("place").alias("k"))


#: Node types of the data and logic layers; others are in the layer of views.
CATEGORIES = {"data": ["data-fetch", "context", "store"], "logic": ["hook", "condition", "loop"]}


def node_category(nodes: DataFrame, categories: dict[str, list[str]] = CATEGORIES, default: str = "ui", without: tuple[str, ...] = ("page", "route", "layout")) -> DataFrame:
    """(node, category): the category that a node states (``category``, where it is a known one), else that of its type."""
    c = F.lit(default)
    for name, types in categories.items():
        c = F.when(F.col("type").isin(types), name).otherwise(c)
    if "category" in nodes.columns:
        c = F.when(F.col("category").isin([*categories, default]), F.col("category")).otherwise(c)
    return nodes.where(~F.col("type").isin(list(without))).select("node", c.alias("category"))


def layer_dependency(refs: DataFrame, internal: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Files and the modules they refer to, as nodes (node, type, label) and edges (src, dst, type).

    refs: owner (a file), target (as it is written), path (of the file it leads to, or null). A module that leads to a file from any
    owner is of the workspace, one that looks ``internal`` is a module, others are external; each is linked to all files it leads to."""
    if internal is None:
        internal = F.col("target").startswith(".") | F.col("target").startswith("@/")
    r = refs.where("target IS NOT NULL").select("owner", "target", "path").distinct()
    file, module = (lambda c: F.concat(F.lit("file:"), c)), F.concat(F.lit("module:"), "target")
    files = r.select(F.explode(F.array("owner", "path")).alias("path")).where("path IS NOT NULL").distinct()
    kind = F.when(F.max(F.col("path").isNotNull()), "workspace").when(F.max(internal), "module").otherwise("external")
    modules = r.groupBy("target").agg(kind.alias("type"))
    nodes = files.select(file(F.col("path")).alias("node"), F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("label"))
    nodes = nodes.unionByName(modules.select(module.alias("node"), "type", F.col("target").alias("label")))
    used = r.select(file(F.col("owner")).alias("src"), module.alias("dst"), F.lit("imports").alias("type"))
    led = r.where("path IS NOT NULL").select(module.alias("src"), file(F.col("path")).alias("dst"), F.lit("resolved-to").alias("type"))
    return nodes, used.where("src IS NOT NULL").unionByName(led).distinct()


def layer_data_source(fetches: DataFrame, calls: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch nodes (node, label), who calls them first (calls: src, dst, awaited, k) and their outputs (node, name), as nodes and edges; the first write of an id wins."""
    p = "data-source:"
    tag = lambda c: F.concat(F.lit(p), c)
    first = calls.join(fetches.select(F.col("node").alias("dst")), "dst", "left_semi").groupBy("dst").agg(F.min(F.struct("k", "src", "awaited")).alias("x"))
    callers = first.select(tag(F.col("x.src")).alias("src"), tag(F.col("dst")).alias("dst"), F.when(F.col("x.awaited"), "awaits").otherwise("calls").alias("type"))
    out = outputs.join(fetches.select("node"), "node", "left_semi")
    given = out.select(tag(F.col("node")).alias("src"), tag(F.concat_ws("#", "node", "name")).alias("dst"), F.lit("outputs").alias("type")).distinct()
    nodes = fetches.select(tag(F.col("node")).alias("node"), F.lit("fetch").alias("kind"), "label")
    nodes = nodes.unionByName(callers.select(F.col("src").alias("node"), F.lit("caller").alias("kind"), F.col("src").alias("label")))
    nodes = nodes.unionByName(given.select(F.col("dst").alias("node"), F.lit("output").alias("kind"), F.col("dst").alias("label")))
    rank = F.when(F.col("kind") == "fetch", 0).when(F.col("kind") == "caller", 1).otherwise(2)
    nodes = nodes.groupBy("node").agg(F.min(F.struct(rank.alias("r"), "kind", "label")).alias("x")).select("node", "x.kind", "x.label")
    return nodes, callers.unionByName(given).distinct()


def layer_state(holders: DataFrame, usages: DataFrame, derived: str = r"^(is|has|can|should|filtered|sorted|total|count)[A-Z]") -> tuple[DataFrame, DataFrame]:
    """State holders (node, name) with names that look derived marked, and who uses them (src, node)."""
    nodes = holders.select(F.concat(F.lit("state:"), "node").alias("node"), "name", F.when(F.col("name").rlike(derived), "derived").otherwise("state").alias("kind")).distinct()
    used = usages.join(holders.select("node").distinct(), "node", "left_semi")
    return nodes, used.select(F.concat(F.lit("state:"), "node").alias("src"), F.concat(F.lit("state:"), F.col("src")).alias("dst"), F.lit("used-by").alias("type")).distinct()


def layer_events(handlers: DataFrame) -> DataFrame:
    """Element to event, event to handler and handler to action of event attributes (node, prop, value): src, dst, type."""
    from assetloom.functions.rules import event_action_class

    h = handlers.where(F.col("prop").rlike("^on[A-Z]"))
    inline = F.col("value").contains("=>") | F.col("value").contains("(")
    e = h.select("node", F.concat_ws("#", "node", "prop").alias("event"), F.when(inline, F.concat_ws("#", F.lit("inline"), "node", "prop")).otherwise(F.col("value")).alias("handler"), event_action_class(F.col("value")).alias("action"), F.when(inline, "inline-handler").otherwise("callback").alias("how"))
    one = e.select(F.col("node").alias("src"), F.col("event").alias("dst"), F.lit("emits").alias("type"))
    two = e.select(F.col("event").alias("src"), F.col("handler").alias("dst"), F.col("how").alias("type"))
    three = e.select(F.col("handler").alias("src"), F.col("action").alias("dst"), F.lit("performs").alias("type"))
    return one.unionByName(two).unionByName(three).distinct()
