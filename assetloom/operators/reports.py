"""Trace reports: joins and unions over the traversal operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.operators import traversal
from assetloom.plans.durable import saved
from assetloom.plans.frontier import adjacency, clustered, few, steps_of, walk
from assetloom.plans.reach import members_of, reach


def degree_badges(edges: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Outgoing edges of each node by group of types."""
    return edges.groupBy(F.col("src").alias("node")).agg(*(F.count_if(F.col("type").isin(t)).alias(g) for g, t in groups.items()))


def child_refs(nodes: DataFrame, edges: DataFrame, passing: str) -> DataFrame:
    """Children of a node by label, with the types of all edges to them."""
    types = F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")
    g = edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("child")).agg(types, F.max(F.col("type") == passing).alias("passing"))
    g = g.join(nodes.select(F.col("node").alias("child"), "label"), "child")
    return g.select("node", "child", "types", "passing", "label", F.row_number().over(Window.partitionBy("node").orderBy("label", "child")).alias("ord"))


def parent_names(nodes: DataFrame, edges: DataFrame, parents: list[str], users: list[str]) -> DataFrame:
    """Labels of the parents and of other users of each node, as sorted lists."""
    e = edges.join(nodes.select(F.col("node").alias("src"), "label"), "src")

    def names(types: list[str]) -> Column:
        found = F.collect_set(F.when(F.col("type").isin(types), F.col("label")))
        return F.when(F.size(found) > 0, F.array_join(F.sort_array(found), ","))

    return e.groupBy(F.col("dst").alias("node")).agg(names(parents).alias("parents"), names(users).alias("users"))


#: What an edge of a type is called where that isn't its own name.
LABELS = {"renders": "render", "routes_to": "render", "wraps": "children", "shows_loading": "loading", "shows_error": "error", "shows_not_found": "404", "passes_prop": "pass props", "prop_source": "feeds prop", "uses_hook": "hook"}


#: Fixed value: characters of a label with properties.
LABEL_LENGTH = 42


def edge_label(edges: DataFrame, labels: dict[str, str] = LABELS, ordered: list[str] = ("sequence",), passing: list[str] = ("passes_prop",), feeding: list[str] = ("prop_source",)) -> DataFrame:
    """``label``: one that is given and says more than the type, else by type, with passed properties, the fed property, or order and kind of a step. Columns label, props, prop, order and step may be left out."""
    has = lambda c: F.col(c).cast("string") if c in edges.columns else F.lit(None).cast("string")
    plain = F.replace("type", F.lit("_"), F.lit(" "))
    name = plain
    for t, x in labels.items():
        name = F.when(F.col("type") == t, x).otherwise(name)
    props = F.concat(F.lit("pass props: {"), F.nullif(has("props"), F.lit("")), F.lit("}"))
    props = F.when(F.char_length(props) > LABEL_LENGTH, F.concat(F.substring(props, 1, LABEL_LENGTH - 1), F.lit("…"))).otherwise(props)
    order = F.nullif(F.nullif(has("order"), F.lit("0")), F.lit(""))
    for types, shown in ((passing, props), (feeding, F.concat(F.lit("→ "), F.nullif(has("prop"), F.lit("")))), (ordered, F.concat(order, F.lit(". "), F.coalesce(has("step"), F.lit("step"))))):
        name = F.when(F.col("type").isin(list(types)) & shown.isNotNull(), shown).otherwise(name)
    given = F.nullif(F.nullif(has("label"), F.lit("")), plain)
    return edges.withColumn("label", F.coalesce(given, name))


def node_from_id(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Type and label of node ids, from the catalog or else from the id itself."""
    known = nodes.select("node", "type", "label", F.lit(True).alias("known"))
    rest = F.expr("substring(node, instr(node, ':') + 1)")
    return ids.join(known, "node", "left").select("node", F.coalesce("type", F.split_part("node", F.lit(":"), F.lit(1))).alias("type"), F.coalesce("label", rest).alias("label"), F.coalesce("known", F.lit(False)).alias("traceable"))


def passed_in_subtree(edges: DataFrame, roots: DataFrame, types: list[str], passing: list[str]) -> DataFrame:
    """Passing edges that leave any node below a root."""
    below = walk(adjacency(edges, "out", types), roots)
    e = edges.where(F.col("type").isin(passing))
    return e.join(below, e["src"] == below["node"]).select("root", "type", "src", "dst", "k").distinct()


def trace_node(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """The nodes around a root with how many edges of its expansion (by pair) touch each: root, node, type, label, degree."""
    pairs = saved(traversal.expand_khop(edges, roots, depth).select("root", "src", "dst").distinct())
    ends = pairs.select("root", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    ends = ends.groupBy("root", "node").agg(F.count(F.lit(1)).alias("degree"))
    lone = roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("degree"))
    every = ends.unionByName(lone).groupBy("root", "node").agg(F.max("degree").alias("degree"))
    return every.join(nodes.select("node", "type", "label"), "node").select("root", "node", "type", "label", "degree")


def trace_data_flow(edges: DataFrame, focus: DataFrame, types: list[str], without: list[str], usage: dict[str, list[str]] = traversal.FLOW_TYPES) -> DataFrame:
    """The focused flow without edges that touch nodes of some types (by id)."""
    flow = traversal.focused_flow(edges, focus, types, usage=usage)
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).isin(without)
    return flow.where(~kind("src") & ~kind("dst"))


def trace_composition(nodes: DataFrame, edges: DataFrame, roots: DataFrame, up_types: list[str], down_types: list[str]) -> DataFrame:
    """The neighbourhood's edges, one for each (type, src, dst), whose ends are both in the catalog, with labels."""
    e = traversal.composition_neighborhood(edges, roots, up_types, down_types)
    e = e.groupBy("root", "type", "src", "dst").agg(F.min("k").alias("k"))
    a, b = nodes.select(F.col("node").alias("src"), F.col("label").alias("src_label")), nodes.select(F.col("node").alias("dst"), F.col("label").alias("dst_label"))
    return e.join(a, "src").join(b, "dst").select("root", "type", "src", "dst", "k", "src_label", "dst_label")


def sections(**frames: DataFrame) -> DataFrame:
    """Section frames (root, ord, subject, value) as one long table with the section's name."""
    out = None
    for name, f in frames.items():
        f = f.select("root", F.lit(name).alias("section"), F.col("ord").cast("long").alias("ord"), "subject", F.col("value").cast("string").alias("value"))
        out = f if out is None else out.unionByName(f)
    return out


def trace_symbol(nodes: DataFrame, edges: DataFrame, roots: DataFrame, down_types: list[str], up_types: list[str], call_types: list[str], depth: int = 3, passing: tuple[str, ...] = (), hooks: tuple[str, ...] = (), lazy: tuple[str, ...] = (), flags: DataFrame | None = None, used_by: tuple[str, ...] = (), routes: tuple[str, list[str]] | None = None) -> DataFrame:
    """The report on a symbol in long form: entry, boundary, tree, passed and received properties, calls, dynamic references, hooks, usage, consumers and their routes, related assets and warnings.

    ``used_by`` are the edge types from consumers. ``routes`` is the type of route nodes and the edge types along which they lead to what they show: a row for each consumer and route, from one propagation for all routes. The edges at a root are found once for all sections, and names and assets of what the sections list are looked up together.

    ``passing``, ``hooks`` and ``lazy`` are the edge types of handed down properties, dependencies and dynamic references. ``flags``
    (path, client) tells which assets are marked for clients; a symbol with dependencies in an asset without the mark is warned of."""
    near = few(roots, roots.count())
    own, given = (saved(edges.join(near, F.col(end) == F.col("root"))) for end in ("src", "dst"))
    passed = own.where(F.col("type").isin(*passing)).select("root", F.col("k").alias("ord"), F.col("dst").alias("subject"), F.col("type").alias("value"))
    received = given.where(F.col("type").isin(*passing)).select("root", F.col("k").alias("ord"), F.col("src").alias("subject"), F.col("type").alias("value"))
    dynamic = given.where(F.col("type").isin(*lazy)).select("root", F.col("k").alias("ord"), F.col("src").alias("subject"), F.col("type").alias("value"))
    uses = own.where(F.col("type").isin(*hooks)).select("root", F.col("dst").alias("subject")).distinct()
    entry = roots.join(nodes, F.col("root") == F.col("node")).select("root", F.lit(0).alias("ord"), F.col("node").alias("subject"), F.col("label").alias("value"))
    below = clustered(steps_of(edges, "out", down_types))
    tree = traversal.containment_tree(below, roots, depth)
    tree = tree.select("root", F.row_number().over(Window.partitionBy("root").orderBy("path")).alias("ord"), F.col("node").alias("subject"), F.col("line").alias("value"))
    calls = traversal.callees(below if set(call_types) == set(down_types) else edges, roots, call_types)
    below.clear()
    usage = saved(traversal.impact(edges, roots, up_types))
    used = usage.select("root", F.col("depth").alias("ord"), F.col("node").alias("subject"), F.col("depth").cast("string").alias("value"))
    around = roots.select("root", F.col("root").alias("node")).unionByName(traversal.neighbors(own.unionByName(given), roots, "both"))
    asked = {"calls": calls.select("root", F.col("depth").alias("ord"), F.col("node").alias("subject")), "hooks": uses.select("root", F.lit(0).alias("ord"), "subject"), "related": around.select("root", F.lit(0).alias("ord"), F.col("node").alias("subject"))}
    needed = usage.select("root").unionByName(dynamic.select("root")).distinct()
    unused = roots.join(needed, "root", "left_anti").select("root", F.lit(0).alias("ord"), F.col("root").alias("subject"), F.lit("nothing uses it").alias("value"))
    more = {}
    if flags is not None:
        at = roots.join(nodes, F.col("root") == F.col("node")).join(flags.select("path", "client"), "path", "left").join(uses.select("root", F.lit(True).alias("uses")).distinct(), "root", "left")
        client, using = F.coalesce("client", F.lit(False)), F.coalesce("uses", F.lit(False))
        more["boundary"] = at.select("root", F.lit(0).alias("ord"), F.col("path").alias("subject"), F.when(client, "client").when(using, "client by use").otherwise("server").alias("value"))
        unmarked = at.where(using & ~client).select("root", F.lit(1).alias("ord"), F.col("root").alias("subject"), F.lit("uses hooks without a client mark").alias("value"))
        unused = unused.unionByName(unmarked)
    if used_by:
        consumers = saved(given.where(F.col("type").isin(*used_by)).groupBy("root", F.col("src").alias("subject")).agg(F.min("k").alias("ord")))
        asked["consumers"] = consumers
        if routes is not None:
            kind, along = routes
            starts = nodes.where(F.col("type") == kind).select(F.col("node").alias("member"), "node")
            sets, numbers = reach(edges.where(F.col("type").isin(along)), starts)
            at = consumers.join(sets, F.col("subject") == F.col("node")).select("root", "subject", "word", "bits")
            more["routes"] = members_of(at, numbers, "root", "subject").select("root", F.lit(0).alias("ord"), "subject", F.col("member").alias("value"))
    every = reduce(DataFrame.unionByName, (f.select(F.lit(name).alias("part"), "root", F.col("ord").cast("long").alias("ord"), "subject") for name, f in asked.items()))
    known = saved(every.join(nodes.select(F.col("node").alias("subject"), "label", "path", F.lit(True).alias("known")), "subject", "left"))
    named = lambda part, value: known.where(F.col("part") == part).select("root", "ord", "subject", value.alias("value"))
    related = known.where("part = 'related' and path is not null").select("root", F.col("path").alias("subject")).distinct().select("root", F.lit(0).alias("ord"), "subject", F.col("subject").alias("value"))
    if used_by:
        more["consumers"] = known.where("part = 'consumers' and known").select("root", "ord", "subject", F.col("label").alias("value"))
    return sections(entry=entry, tree=tree, passed=passed, received=received, calls=named("calls", F.coalesce("label", "subject")), dynamic=dynamic, hooks=named("hooks", F.col("label")), usage=used, related=related, warnings=unused, **more)


def received_properties(passes: DataFrame, declared: DataFrame) -> DataFrame:
    """Properties that a node is given (node, giver, prop, value), flagged as declared (node, prop) or not."""
    d = declared.select("node", "prop", F.lit(True).alias("declared")).distinct()
    return passes.join(d, ["node", "prop"], "left").select("node", "giver", "prop", "value", F.coalesce("declared", F.lit(False)).alias("declared"))


def property_origins(sources: DataFrame, passes: DataFrame) -> DataFrame:
    """Value sources of a node's properties (node, prop, origin); for nodes without any, who passes them."""
    rest = passes.join(sources.select("node").distinct(), "node", "left_anti").select("node", "prop", F.col("giver").alias("origin"))
    return sources.select("node", "prop", "origin", F.lit("source").alias("kind")).unionByName(rest.withColumn("kind", F.lit("passed")))


def symbol_usage_sites(sites: DataFrame, names: DataFrame, references) -> DataFrame:
    """Sites (owner, kind, expression, line) of an owner that read one of its names (owner, name). ``references(expression, name)`` is the predicate."""
    return sites.join(names, "owner").where(references(F.col("expression"), F.col("name"))).select("owner", "name", "kind", "line").distinct()


def pass_downs(passes: DataFrame, names: DataFrame, references) -> DataFrame:
    """Properties of children fed by a name of the giver, renamed or not; events and values of providers don't count."""
    p = passes.where(~F.col("prop").rlike("^on[A-Z]") & ~(F.col("node").endswith("Provider") & (F.col("prop") == "value")))
    p = p.join(names.select(F.col("owner").alias("giver"), "name"), "giver").where(references(F.col("value"), F.col("name")))
    return p.select("giver", "name", F.col("node").alias("child"), "prop", (F.col("prop") != F.col("name")).alias("renamed")).distinct()
