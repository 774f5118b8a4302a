"""Queries on the commerce graph (G1) and on ordered steps (G3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.operators import graph, traversal
from assetloom.plans.frontier import adjacency

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


E = f"e AS ({fx.G1_SQL})"
N = f"n AS ({fx.G1_NODES_SQL})"


def some(*types):
    return f"e AS (SELECT * FROM ({fx.G1_SQL}) WHERE type IN ({', '.join(repr(t) for t in types)}))"


@register("dedupe_edges_by_id", f"WITH {E} SELECT type || ':' || src || '->' || dst AS edge_id, min(k) AS position, max(k) AS k FROM e GROUP BY ALL")
def _(s, d):
    e = fx.g1_edges(s, d).withColumn("edge_id", F.concat("type", F.lit(":"), "src", F.lit("->"), "dst"))
    return graph.dedupe_edges_by_id(e, ["edge_id"])


@register("collapse_parallel_edges", f"WITH {E} SELECT type, src, dst, min(k) AS k FROM e GROUP BY ALL")
def _(s, d):
    return graph.collapse_parallel_edges(fx.g1_edges(s, d))


@register("prefer_type_per_pair", f"""WITH {E}, r AS (SELECT type, src, dst, k FROM e UNION ALL SELECT 'links', src, dst, k + 1000 FROM e WHERE k % 3 = 0)
SELECT src, dst, coalesce(max({{'k': k, 't': type}}) FILTER (WHERE type IN ('links', 'places')), min({{'k': k, 't': type}})).t AS type,
 coalesce(max({{'k': k, 't': type}}) FILTER (WHERE type IN ('links', 'places')), min({{'k': k, 't': type}})).k AS k FROM r GROUP BY src, dst""")
def _(s, d):
    e = fx.g1_edges(s, d)
    more = e.where("k % 3 = 0").select(F.lit("links").alias("type"), "src", "dst", (F.col("k") + 1000).alias("k"))
    return graph.prefer_type_per_pair(e.unionByName(more), ["links", "places"])


_PRIO = " ".join(f"WHEN '{t}' THEN {p}" for t, p in fx.G1_PRIORITY.items())


@register("priority_edge_per_pair", f"""WITH {E}, r AS (SELECT type, src, dst, k FROM e UNION ALL SELECT 'links', src, dst, k - 1000 FROM e WHERE k % 3 = 0),
x AS (SELECT src, dst, min({{'p': CASE type {_PRIO} ELSE 99 END, 'k': k, 't': type}}) AS m FROM r GROUP BY src, dst)
SELECT src, dst, m.t AS type, m.k AS k, m.p::INTEGER AS priority FROM x""")
def _(s, d):
    e = fx.g1_edges(s, d)
    more = e.where("k % 3 = 0").select(F.lit("links").alias("type"), "src", "dst", (F.col("k") - 1000).alias("k"))
    return graph.priority_edge_per_pair(e.unionByName(more), fx.G1_PRIORITY)


@register("build_nodes", f"""WITH {N}, w AS (SELECT node, type, label, path, 0 AS w FROM n UNION ALL SELECT node, 'hub', label, path || '/hub', 1 FROM n WHERE type = 'nation'
 UNION ALL SELECT DISTINCT 'external:' || c_mktsegment, 'external', c_mktsegment, '', 2 FROM customer)
SELECT node, arg_max(type, w) AS type, arg_max(label, w) AS label, arg_max(path, w) AS path FROM w GROUP BY node""")
def _(s, d):
    n = fx.g1_nodes(s, d)
    over = n.where("type = 'nation'").select("node", F.lit("hub").alias("type"), "label", F.concat("path", F.lit("/hub")).alias("path"))
    virtual = fx.read(s, d, "customer").select("c_mktsegment").distinct().select(F.concat(F.lit("external:"), "c_mktsegment").alias("node"), F.lit("external").alias("type"), F.col("c_mktsegment").alias("label"), F.lit("").alias("path"))
    return graph.build_nodes(n, over, virtual)


_SEQ = f"""s AS (SELECT * FROM ({fx.STEPS_SQL}) WHERE kind <> 'error'),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY owner, kind, target ORDER BY ts, ord) = 1)"""


@register("edges_sequence", f"WITH {_SEQ} SELECT owner, ord, kind, target, row_number() OVER (PARTITION BY owner ORDER BY ts, ord)::INTEGER AS rank FROM f")
def _(s, d):
    return graph.edges_sequence(fx.steps(s, d), ["error"]).select("owner", "ord", "kind", "target", "rank")


@register("merge_steps", f"""WITH s AS (SELECT owner, date_diff('day', TIMESTAMP '1970-01-01', ts) AS place, ord, kind FROM ({fx.STEPS_SQL})),
r AS (SELECT *, CASE kind WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rank FROM s)
SELECT owner, place, ord, kind, row_number() OVER (PARTITION BY owner ORDER BY place, rank, ord, kind)::INTEGER AS number FROM r""")
def _(s, d):
    t = fx.steps(s, d).select("owner", F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("place"), "ord", "kind")
    kinds = [t.where(F.col("kind") == "error"), t.where(F.col("kind") != "error")]
    return graph.merge_steps({"error": 0, "purchase": 1, "click": 2}, *kinds).select("owner", "place", "ord", "kind", "number")


_SUP = f"SELECT type, src, dst, k FROM ({fx.G1_SQL}) WHERE type IN ('has_customer', 'places', 'contains')"


@register("drop_implied_edges", f"""WITH RECURSIVE b AS ({_SUP}), e AS (SELECT * FROM b UNION ALL SELECT 'calls', 'region:' || n_regionkey, 'customer:' || c_custkey, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'calls', 'customer:' || o_custkey, 'customer:' || (o_custkey + 1), o_orderkey FROM orders),
w(root, node) AS (SELECT DISTINCT src, src FROM e WHERE type = 'calls' UNION SELECT w.root, b.dst FROM w JOIN b ON w.node = b.src),
g AS (SELECT DISTINCT src, dst FROM e WHERE type = 'calls' AND EXISTS (SELECT 1 FROM w WHERE w.root = e.src AND w.node = e.dst AND w.root <> w.node))
SELECT type, src, dst, k FROM e WHERE type <> 'calls' OR (src, dst) NOT IN (SELECT (src, dst) FROM g)""")
def _(s, d):
    b = fx.g1_edges(s, d, ["has_customer", "places", "contains"])
    c, n, o = fx.read(s, d, "customer"), fx.read(s, d, "nation"), fx.read(s, d, "orders")
    one = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lit("calls").alias("type"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("dst"), F.col("c_custkey").alias("k"))
    two = o.select(F.lit("calls").alias("type"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), (F.col("o_custkey") + 1).cast("string")).alias("dst"), F.col("o_orderkey").alias("k"))
    return graph.drop_implied_edges(b.unionByName(one).unionByName(two), ["has_customer", "places", "contains"], ["calls"])


@register("layer_component", f"""WITH {E}, {N}, v AS (SELECT node FROM n WHERE type IN ('customer', 'order'))
SELECT type, src, dst, k FROM e WHERE src IN (FROM v) AND dst IN (FROM v)""")
def _(s, d):
    return graph.layer_component(fx.g1_nodes(s, d), fx.g1_edges(s, d), ["customer", "order"])[1]


@register("filter_layer", f"""WITH {E}, {N}, v AS (SELECT node FROM n WHERE contains(lower(label), 'a') AND type <> 'part' OR contains(lower(path), 'supp'))
SELECT type, src, dst, k FROM e WHERE src IN (SELECT node FROM n WHERE contains(lower(label), 'a') OR contains(lower(path), 'a')) AND dst IN (SELECT node FROM n WHERE contains(lower(label), 'a') OR contains(lower(path), 'a'))""")
def _(s, d):
    return graph.filter_layer(fx.g1_nodes(s, d), fx.g1_edges(s, d), "A")[1]


@register("node_category", f"""WITH {N} SELECT node, CASE WHEN type IN ('region', 'nation') THEN 'data' WHEN type IN ('customer', 'supplier') THEN 'logic' WHEN type IN ('order', 'part') THEN 'ui' END AS category FROM n""")
def _(s, d):
    return graph.node_category(fx.g1_nodes(s, d), {"data": ["region", "nation"], "logic": ["customer", "supplier"]})


@register("layer_value_flow", f"""WITH s AS (SELECT owner, ord AS node, ts FROM ({fx.STEPS_SQL})),
x AS (SELECT owner, node AS src, lead(node) OVER w AS dst, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY owner ORDER BY ts, node))
SELECT owner, src, dst, CASE WHEN k = 1 THEN 'assigned-to' ELSE 'depends-on' END AS type, k::INTEGER AS k FROM x WHERE dst IS NOT NULL""")
def _(s, d):
    return graph.layer_chain(fx.steps(s, d).withColumn("node", F.col("ord")), "owner", ["ts", "node"], "assigned-to", "depends-on")


_C = fx.g1_roots_sql("customer")
_P = fx.g1_roots_sql("part")


@register("incident_edges", f"WITH {E}, r AS ({_C}) SELECT DISTINCT root, type, src, dst, k FROM e JOIN r ON root = src OR root = dst")
def _(s, d):
    return traversal.incident_edges(fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"))


@register("neighbors", f"WITH {E}, r AS ({_C}) SELECT DISTINCT root, dst AS node FROM e JOIN r ON root = src")
def _(s, d):
    return traversal.neighbors(fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"))


def _walk_sql(types, roots, depth, direction="out", tail="SELECT root, node, depth FROM v"):
    a, b = ("src", "dst") if direction != "in" else ("dst", "src")
    both = " UNION SELECT dst, src FROM e" if direction == "both" else ""
    return f"""WITH RECURSIVE {some(*types)}, p AS (SELECT {a} AS a, {b} AS b FROM e{both}), r AS ({roots}),
w(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, b, depth + 1 FROM w JOIN p ON node = a WHERE depth < {depth}),
v AS (SELECT root, node, min(depth)::INTEGER AS depth FROM w GROUP BY root, node) {tail}"""


_OP = ["places", "contains_part"]


@register("expand_khop", _walk_sql(_OP, _C, 2, "both", "SELECT DISTINCT root, type, src, dst, k FROM e JOIN v ON src = node OR dst = node"))
def _(s, d):
    return traversal.expand_khop(fx.g1_edges(s, d, _OP), fx.g1_roots(s, d, "customer"), 3)


@register("edges_within_depth", _walk_sql(_OP, _C, 1, "both", "SELECT DISTINCT root, type, src, dst, k FROM e JOIN v ON src = node OR dst = node"))
def _(s, d):
    return traversal.expand_khop(fx.g1_edges(s, d, _OP), fx.g1_roots(s, d, "customer"), 2)


@register("reachable", _walk_sql(_OP, _C, 99))
def _(s, d):
    return traversal.reachable(fx.g1_edges(s, d, _OP), fx.g1_roots(s, d, "customer"))


def _trace_sql(types, roots, depth, against):
    a, b, sign = ("dst", "src", "-") if against else ("src", "dst", "")
    return f"""WITH RECURSIVE {some(*types)}, {N}, r AS ({roots}),
w(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, {b}, depth + 1 FROM w JOIN e ON node = {a} WHERE depth < {depth}),
v AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node)
SELECT v.root, v.node, ({sign}v.depth)::INTEGER AS depth, (SELECT min(e.type) FROM e JOIN v u ON u.node = e.{a} AND u.root = v.root AND u.depth = v.depth - 1 WHERE e.{b} = v.node) AS via, n.type AS role
FROM v LEFT JOIN n ON v.node = n.node"""


@register("trace_downstream", _trace_sql(_OP, _C, 6, False))
def _(s, d):
    return traversal.trace(fx.g1_edges(s, d), fx.g1_nodes(s, d), fx.g1_roots(s, d, "customer"), _OP, 6)


_UP = ["contains", "has_customer", "places", "contains_part"]


@register("trace_upstream", _trace_sql(_UP, _P, 99, True))
def _(s, d):
    return traversal.trace(fx.g1_edges(s, d), fx.g1_nodes(s, d), fx.g1_roots(s, d, "part"), _UP, None, True)


@register("containment_tree", f"""WITH RECURSIVE {some('contains', 'has_customer', 'places')}, p AS (SELECT DISTINCT src, dst, dst = max(dst) OVER (PARTITION BY src) AS is_last FROM e),
w(root, node, depth, path, is_last) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0, 'region:' || r_regionkey, true FROM region
 UNION ALL SELECT root, dst, depth + 1, path || ' > ' || dst, p.is_last FROM w JOIN p ON node = src WHERE depth < 3)
SELECT root, node, depth::INTEGER AS depth, path, is_last, repeat('  ', depth) || node AS line FROM w""")
def _(s, d):
    roots = fx.read(s, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root"))
    return traversal.containment_tree(fx.g1_edges(s, d, ["contains", "has_customer", "places"]), roots)


@register("call_chain", _walk_sql(_OP, _C, 6, "out", f", {N} SELECT root, v.node, depth, CASE WHEN starts_with(v.node, 'order:') THEN 'order' ELSE 'internal' END AS kind, coalesce(label, v.node) AS label FROM v LEFT JOIN n ON n.node = v.node WHERE depth BETWEEN 1 AND 1"))
def _(s, d):
    return traversal.call_chain(fx.g1_nodes(s, d), fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"), _OP, 6, ("order:",))


@register("impact", _walk_sql(_UP, _P, 6, "in", "SELECT root, count(*) FILTER (WHERE depth = 1) AS direct, count(*) AS consumers, count(*) FILTER (WHERE starts_with(node, 'nation:')) AS nations, count(*) FILTER (WHERE starts_with(node, 'region:')) AS regions, max(depth)::INTEGER AS depth FROM v WHERE depth > 0 GROUP BY root"))
def _(s, d):
    found = traversal.impact(fx.g1_edges(s, d, _UP), fx.g1_roots(s, d, "part"))
    count = lambda c: F.count_if(c)
    return found.groupBy("root").agg(count(F.col("depth") == 1).alias("direct"), F.count(F.lit(1)).alias("consumers"), count(F.col("node").startswith("nation:")).alias("nations"), count(F.col("node").startswith("region:")).alias("regions"), F.max("depth").alias("depth"))


@register("unused_symbols", f"WITH {E}, {N} SELECT node, type FROM n WHERE node NOT IN (SELECT dst FROM e WHERE type IN ('places', 'supplies'))")
def _(s, d):
    return traversal.unused_symbols(fx.g1_nodes(s, d), fx.g1_edges(s, d), ["places", "supplies"]).select("node", "type")


@register("hook_usage", f"""WITH {E}, r AS ({_P}), u AS (SELECT DISTINCT root, src AS consumer FROM e JOIN r ON root = dst WHERE type = 'contains_part'),
a AS (SELECT x.dst AS node, 'nation:' || c_nationkey AS route FROM e x JOIN customer ON x.src = 'customer:' || c_custkey WHERE x.type = 'places')
SELECT DISTINCT root, consumer, route FROM u LEFT JOIN a ON consumer = node""")
def _(s, d):
    return traversal.hook_usage(fx.g1_edges(s, d, ["has_customer", "places", "contains_part"]), fx.g1_roots(s, d, "part"), "contains_part", ["has_customer", "places"], lambda c: c.startswith("nation:"), 4)


_PART_UP = ["has_customer", "places", "contains_part"]


@register("related_assets", _walk_sql(_PART_UP, _P, 6, "in", f""", {N}, al AS ({fx.G1_SQL}), m AS (SELECT root, root AS node FROM r UNION SELECT root, dst FROM al JOIN r ON root = src UNION SELECT root, src FROM al JOIN r ON root = dst)
SELECT root, path FROM m JOIN n USING (node) UNION SELECT root, '/nation/' || split_part(node, ':', 2) || '/page' FROM v WHERE starts_with(node, 'nation:')"""))
def _(s, d):
    e, r, n = fx.g1_edges(s, d), fx.g1_roots(s, d, "part"), fx.g1_nodes(s, d)
    nations = n.where("type = 'nation'").select("node", F.concat(F.lit("/nation/"), F.split_part("node", F.lit(":"), F.lit(2))).alias("route"))
    used = traversal.impact(fx.g1_edges(s, d, _PART_UP), r)
    return traversal.related_assets(n, e, r, used.join(nations, "node").select("root", "route"), nations.select("route", F.concat("route", F.lit("/page")).alias("path")))


_CUST_UP, _CUST_DOWN = ["contains", "has_customer"], ["places", "contains_part"]


@register("composition_neighborhood", f"""WITH RECURSIVE {E}, r AS ({_C}),
u(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, src, depth + 1 FROM u JOIN e ON node = dst WHERE depth < 3 AND type IN ('contains', 'has_customer')),
w(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 1 AND type IN ('places', 'contains_part'))
SELECT DISTINCT root, type, src, dst, k FROM e JOIN u ON dst = node WHERE type IN ('contains', 'has_customer')
UNION SELECT root, type, src, dst, k FROM e JOIN w ON src = node WHERE type IN ('places', 'contains_part')""")
def _(s, d):
    return traversal.composition_neighborhood(fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"), _CUST_UP, _CUST_DOWN)


@register("upstream_edges", f"""WITH RECURSIVE {some('contains', 'has_customer', 'places', 'contains_part')}, r AS ({_P}), b AS (SELECT 'nation:' || n_nationkey AS node FROM nation),
w(root, node) AS (SELECT root, root FROM r UNION SELECT root, src FROM w JOIN e ON node = dst WHERE src NOT IN (FROM b))
SELECT DISTINCT root, type, src, dst, k FROM e JOIN w ON dst = node""")
def _(s, d):
    roots = fx.g1_roots(s, d, "part")
    nations = fx.read(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    return traversal.upstream_edges(fx.g1_edges(s, d), roots.select("root", F.col("root").alias("node")), roots.crossJoin(F.broadcast(nations)), _UP)


_FOCUS = f"f AS (SELECT root, root AS owner, CASE WHEN root LIKE '%40' OR root LIKE '%80' THEN 'call' ELSE 'prop' END AS kind, CASE WHEN root LIKE '%40' OR root LIKE '%80' THEN 'order:1' ELSE 'places' END AS text FROM ({_C}))"


def _focus(s, d):
    zero = F.col("root").endswith("40") | F.col("root").endswith("80")
    return fx.g1_roots(s, d, "customer").select("root", F.col("root").alias("owner"), F.when(zero, "call").otherwise("prop").alias("kind"), F.when(zero, "order:1").otherwise("places").alias("text"))


#: A customer's calls are its orders; every third customer is fed a property of the focus's name.
_USAGE = {"source": ["has_customer"], "hook": [], "call": ["places"]}
_USED = "u AS (SELECT DISTINCT root, type, src, dst, k FROM e JOIN f ON src = owner WHERE type = 'places' AND (kind = 'prop' OR contains(lower(dst), text)) UNION SELECT root, type, src, dst, k FROM e JOIN f ON dst = owner WHERE type = 'has_customer' AND kind = 'prop' AND k % 3 = 0)"


def _fed(s, d):
    return fx.g1_edges(s, d).withColumns({"prop": F.when((F.col("type") == "has_customer") & (F.col("k") % 3 == 0), "Places"), "passed_from": F.when(F.col("type") == "has_customer", F.col("dst"))})


@register("focus_usage_edges", f"WITH {E}, {_FOCUS}, {_USED} SELECT root, type, src, dst, k FROM u")
def _(s, d):
    return traversal.focus_usage_edges(_fed(s, d), _focus(s, d), _USAGE)


@register("focused_flow", f"""WITH RECURSIVE {E}, {_FOCUS}, {_USED}, x AS (SELECT root, src AS node FROM u UNION SELECT root, dst FROM u), g AS (SELECT * FROM e WHERE type IN ('contains', 'has_customer', 'places', 'contains_part', 'supplies')),
w(root, node, depth) AS (SELECT root, node, 0 FROM x WHERE node <> root UNION SELECT root, src, depth + 1 FROM w JOIN g ON node = dst WHERE src <> root AND depth < 4)
SELECT root, type, src, dst, k FROM u UNION SELECT root, type, src, dst, k FROM g JOIN w ON dst = node""")
def _(s, d):
    return traversal.focused_flow(_fed(s, d), _focus(s, d), ["contains", "has_customer", "places", "contains_part", "supplies"], usage=_USAGE)


@register("prune_to_sink", f"""WITH RECURSIVE {E}, r AS ({_P}),
w(root, node) AS (SELECT root, root FROM r UNION SELECT root, src FROM w JOIN e ON node = dst)
SELECT DISTINCT a.root, type, src, dst, k FROM e JOIN w a ON src = a.node JOIN w b ON dst = b.node AND a.root = b.root""")
def _(s, d):
    return traversal.prune_to_sink(fx.g1_edges(s, d), fx.g1_roots(s, d, "part")).select("root", "type", "src", "dst", "k")


@register("nearest_ancestor", f"""WITH RECURSIVE {some('contains', 'has_customer', 'places', 'contains_part')}, p AS (SELECT dst, min({{'t': type, 's': src}}).s AS up FROM e GROUP BY dst), r AS ({_P}),
w(root, node, depth) AS (SELECT root, root, 0 FROM r UNION ALL SELECT root, up, depth + 1 FROM w JOIN p ON node = dst WHERE depth = 0 OR NOT starts_with(node, 'nation:'))
SELECT root, node AS ancestor, depth::INTEGER AS depth FROM w WHERE depth > 0 AND starts_with(node, 'nation:')""")
def _(s, d):
    return traversal.nearest_ancestor(fx.g1_edges(s, d, _UP), fx.g1_nodes(s, d), fx.g1_roots(s, d, "part"), "nation")


@register("visibility_gates", f"""WITH RECURSIVE {E}, p AS (SELECT dst, min({{'p': CASE type {_PRIO} ELSE 99 END, 'k': k, 's': src, 't': type}}) AS x FROM e GROUP BY dst), r AS ({_P}),
w(root, ord, node, branch) AS (SELECT root, 0, root, '' FROM r UNION ALL SELECT root, ord + 1, x.s, x.t FROM w JOIN p ON node = dst)
SELECT root, ord::INTEGER AS ord, node AS gate, branch FROM w WHERE ord > 0 AND starts_with(node, 'customer:')""")
def _(s, d):
    return traversal.visibility_gates(fx.g1_edges(s, d), fx.g1_nodes(s, d), fx.g1_roots(s, d, "part"), fx.G1_PRIORITY, "customer")


_VT = "e AS (SELECT * FROM (" + fx.G1_SQL + ") WHERE type IN ('contains', 'has_customer', 'places', 'contains_part'))"
_TREE = f"""{_VT}, {N}, h AS (SELECT node FROM n WHERE type = 'order'),
w(top, node, d) AS (SELECT src, dst, 1 FROM e WHERE src NOT IN (FROM h) UNION SELECT top, dst, d + 1 FROM w JOIN e ON node = src WHERE node IN (FROM h)),
t AS (SELECT n.node, min({{'d': d, 't': top}}).t AS parent FROM n LEFT JOIN w ON n.node = w.node AND top <> w.node WHERE n.type <> 'order' GROUP BY n.node)"""


def _tree(s, d):
    return traversal.visible_tree(fx.g1_edges(s, d, _UP), fx.g1_nodes(s, d), ["order"])


@register("visible_tree", f"WITH RECURSIVE {_TREE} SELECT node, parent FROM t")
def _(s, d):
    return _tree(s, d)


@register("tree_path", f"""WITH RECURSIVE {_TREE}, r AS ({_P}), q(root, ord, node) AS (SELECT root, 0, root FROM r UNION ALL SELECT root, ord - 1, parent FROM q JOIN t USING (node) WHERE parent IS NOT NULL)
SELECT root, ord::INTEGER AS ord, node FROM q""")
def _(s, d):
    return traversal.tree_path(_tree(s, d), fx.g1_roots(s, d, "part"))


@register("tree_descendants", f"""WITH RECURSIVE {_TREE}, q(root, node, depth) AS (SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey, 0 FROM nation UNION ALL SELECT root, t.node, depth + 1 FROM q JOIN t ON parent = q.node)
SELECT root, node, depth::INTEGER AS depth FROM q WHERE depth > 0""")
def _(s, d):
    roots = fx.read(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root"))
    return traversal.tree_descendants(_tree(s, d), roots)


@register("tree_levels", f"""WITH RECURSIVE {E}, {N}, w(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM w JOIN e ON node = src)
SELECT node, min(level)::INTEGER AS level FROM w GROUP BY node""")
def _(s, d):
    return traversal.tree_levels(fx.g1_nodes(s, d), fx.g1_edges(s, d))


@register("component_of", f"""WITH RECURSIVE {some('contains', 'has_customer')}, {N}, p AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w(node, c) AS (SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region UNION SELECT b, c FROM w JOIN p ON node = a),
m AS (SELECT n.node, coalesce((SELECT min(x.node) FROM w x WHERE x.c = w.c), n.node) AS component FROM n LEFT JOIN w ON n.node = w.node)
SELECT node, component, component = (SELECT component FROM m GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) AS attached FROM m""")
def _(s, d):
    return traversal.component_of(fx.g1_nodes(s, d), fx.g1_edges(s, d, ["contains", "has_customer"]))


_GROUPS = {"view": "data", "click": "logic", "purchase": "focus"}


@register("step_groups", f"""WITH s AS (SELECT owner, ts, ord, CASE kind WHEN 'view' THEN 'data' WHEN 'click' THEN 'logic' WHEN 'purchase' THEN 'focus' ELSE 'ui' END AS bucket, kind || '#' || ord AS label FROM ({fx.STEPS_SQL})),
g AS (SELECT owner, bucket, count(*) AS n, list(label ORDER BY ts, ord) AS l FROM s GROUP BY ALL)
SELECT owner, bucket, n, array_to_string(l[:2], ', ') || CASE WHEN n > 2 THEN ' +' || (n - 2) ELSE '' END AS summary, n > 1 AS collapsed FROM g""")
def _(s, d):
    t = fx.steps(s, d).select("owner", F.col("ts").alias("place"), "ord", "kind", F.concat("kind", F.lit("#"), F.col("ord").cast("string")).alias("label"))
    return traversal.step_groups(t, _GROUPS)


@register("trace_origin", f"""WITH s AS (SELECT owner, ts, ord, kind, CASE kind WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 END AS r FROM ({fx.STEPS_SQL})),
g AS (SELECT owner, min({{'r': r, 't': ts, 'o': ord, 'k': kind}}) FILTER (WHERE r IS NOT NULL) AS b, max({{'t': ts, 'o': ord, 'k': kind}}) AS l FROM s GROUP BY owner)
SELECT owner, coalesce(b.o, l.o) AS ord, coalesce(b.k, l.k) AS kind FROM g""")
def _(s, d):
    return traversal.trace_origin(fx.steps(s, d).withColumn("place", F.col("ts")), ["purchase", "error"])


@register("degree_badges", f"""WITH {E} SELECT src AS node, count(*) FILTER (WHERE type IN ('contains', 'has_customer', 'has_supplier')) AS children, count(*) FILTER (WHERE type = 'places') AS hooks, count(*) FILTER (WHERE type IN ('contains_part', 'supplies')) AS calls FROM e GROUP BY src""")
def _(s, d):
    from assetloom.operators import reports

    return reports.degree_badges(fx.g1_edges(s, d), {"children": ["contains", "has_customer", "has_supplier"], "hooks": ["places"], "calls": ["contains_part", "supplies"]})


@register("child_refs", f"""WITH {E}, {N}, g AS (SELECT src AS node, dst AS child, string_agg(DISTINCT type, ',' ORDER BY type) AS types, bool_or(type = 'supplies') AS passing FROM e WHERE type <> 'contains_part' GROUP BY src, dst)
SELECT g.node, child, types, passing, label, row_number() OVER (PARTITION BY g.node ORDER BY label, child)::INTEGER AS ord FROM g JOIN n ON child = n.node""")
def _(s, d):
    from assetloom.operators import reports

    return reports.child_refs(fx.g1_nodes(s, d), fx.g1_edges(s, d).where("type <> 'contains_part'"), "supplies")


@register("parent_names", f"""WITH {E}, {N} SELECT dst AS node, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE e.type IN ('contains', 'has_customer', 'has_supplier', 'places')) AS parents, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE e.type IN ('supplies')) AS users
FROM e JOIN n ON src = n.node GROUP BY dst""")
def _(s, d):
    from assetloom.operators import reports

    return reports.parent_names(fx.g1_nodes(s, d), fx.g1_edges(s, d), ["contains", "has_customer", "has_supplier", "places"], ["supplies"])


@register("edge_label", f"""WITH {E} SELECT type, src, dst, k, CASE type WHEN 'contains' THEN 'children' WHEN 'places' THEN 'render' WHEN 'contains_part' THEN (k % 8) || '. step' ELSE replace(type, '_', ' ') END AS label FROM e""")
def _(s, d):
    from assetloom.operators import reports

    return reports.edge_label(fx.g1_edges(s, d).withColumn("order", F.when(F.col("type") == "contains_part", F.col("k") % 8)), {"contains": "children", "places": "render"}, ["contains_part"]).drop("order")


@register("node_from_id", f"""WITH {E}, {N}, i AS (SELECT DISTINCT dst AS node FROM e UNION SELECT 'external:unknown#' || n_name FROM nation UNION SELECT 'builtin:' || r_name FROM region)
SELECT i.node, coalesce(n.type, split_part(i.node, ':', 1)) AS type, coalesce(n.label, substr(i.node, strpos(i.node, ':') + 1)) AS label, n.node IS NOT NULL AS traceable FROM i LEFT JOIN n ON i.node = n.node""")
def _(s, d):
    from assetloom.operators import reports

    ids = fx.g1_edges(s, d).select(F.col("dst").alias("node")).distinct()
    ids = ids.unionByName(fx.read(s, d, "nation").select(F.concat(F.lit("external:unknown#"), "n_name").alias("node"))).unionByName(fx.read(s, d, "region").select(F.concat(F.lit("builtin:"), "r_name").alias("node")))
    return reports.node_from_id(ids, fx.g1_nodes(s, d))


@register("passed_in_subtree", _walk_sql(_OP, _C, 99, "out", f", f AS ({fx.G1_SQL}) SELECT DISTINCT root, f.type, f.src, f.dst, f.k FROM v JOIN f ON f.src = node WHERE f.type = 'contains_part'"))
def _(s, d):
    from assetloom.operators import reports

    return reports.passed_in_subtree(fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"), _OP, ["contains_part"])


@register("trace_node", _walk_sql(_OP, _C, 1, "both", f", {N}, x AS (SELECT DISTINCT root, src, dst FROM e JOIN v ON src = node OR dst = node), y AS (SELECT root, src AS node FROM x UNION SELECT root, dst FROM x UNION SELECT root, root FROM r) SELECT y.root, y.node, n.type, n.label, (SELECT count(*) FROM x WHERE x.root = y.root AND (x.src = y.node OR x.dst = y.node)) AS degree FROM y JOIN n USING (node)"))
def _(s, d):
    from assetloom.operators import reports

    return reports.trace_node(fx.g1_nodes(s, d), fx.g1_edges(s, d, _OP), fx.g1_roots(s, d, "customer"), 2)


@register("trace_data_flow", f"""WITH RECURSIVE {E}, {_FOCUS}, {_USED}, x AS (SELECT root, src AS node FROM u UNION SELECT root, dst FROM u), g AS (SELECT * FROM e WHERE type IN ('contains', 'has_customer', 'places', 'contains_part', 'supplies')),
w(root, node, depth) AS (SELECT root, node, 0 FROM x WHERE node <> root UNION SELECT root, src, depth + 1 FROM w JOIN g ON node = dst WHERE src <> root AND depth < 4),
a AS (SELECT root, type, src, dst, k FROM u UNION SELECT root, type, src, dst, k FROM g JOIN w ON dst = node)
SELECT root, type, src, dst, k FROM a WHERE NOT starts_with(src, 'nation:') AND NOT starts_with(dst, 'nation:')""")
def _(s, d):
    from assetloom.operators import reports

    return reports.trace_data_flow(_fed(s, d), _focus(s, d), ["contains", "has_customer", "places", "contains_part", "supplies"], ["nation"], _USAGE)


_COMP = f"""e0 AS (SELECT DISTINCT root, type, src, dst, min(k) AS k FROM (SELECT root, e.type, e.src, e.dst, e.k FROM e JOIN u ON e.dst = u.node WHERE e.type IN ('contains', 'has_customer') UNION SELECT root, e.type, e.src, e.dst, e.k FROM e JOIN w ON e.src = w.node WHERE e.type IN ('places', 'contains_part')) GROUP BY ALL)"""


@register("trace_composition", f"""WITH RECURSIVE {E}, {N}, r AS ({_C}),
u(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, src, depth + 1 FROM u JOIN e ON node = dst WHERE depth < 3 AND type IN ('contains', 'has_customer')),
w(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, dst, depth + 1 FROM w JOIN e ON node = src WHERE depth < 1 AND type IN ('places', 'contains_part')),
{_COMP} SELECT root, e0.type, src, dst, k, a.label AS src_label, b.label AS dst_label FROM e0 JOIN n a ON src = a.node JOIN n b ON dst = b.node""")
def _(s, d):
    from assetloom.operators import reports

    return reports.trace_composition(fx.g1_nodes(s, d), fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"), _CUST_UP, _CUST_DOWN)


@register("retrieve_context", _walk_sql(_OP, _C, 1, "both", f", {N}, x AS (SELECT DISTINCT root, type, src, dst, k FROM e JOIN v ON src = node OR dst = node), y AS (SELECT root, src AS node, min({{'t': type, 'k': k}}) AS o FROM x GROUP BY ALL UNION ALL SELECT root, dst, min({{'t': type, 'k': k}}) FROM x GROUP BY ALL), z AS (SELECT root, node, node <> root AS other, min(o) AS o FROM y GROUP BY ALL), q AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY other, o, node) AS ord FROM z) SELECT root, ord::INTEGER AS ord, q.node, label, path FROM q JOIN n USING (node) WHERE ord <= 8"))
def _(s, d):
    from assetloom.operators import search

    return search.retrieve_context(fx.g1_nodes(s, d), fx.g1_edges(s, d, _OP), fx.g1_roots(s, d, "customer"))


@register("context_document", f"""WITH {E}, {N}, r AS ({_C}), x AS (SELECT DISTINCT root, type, src, dst, k FROM e JOIN r ON src = root OR dst = root),
g AS (SELECT root, string_agg('- ' || src || ' ' || type || ' ' || dst, chr(10) ORDER BY type, src, dst, k) AS edges FROM x GROUP BY root)
SELECT r.root, '# ' || n.label || chr(10) || chr(10) || 'Type: ' || n.type || chr(10) || chr(10) || 'Edges:' || chr(10) || coalesce(g.edges, '- none') AS document FROM r JOIN n ON r.root = n.node LEFT JOIN g ON g.root = r.root""")
def _(s, d):
    from assetloom.operators import search

    return search.context_document(fx.g1_nodes(s, d), fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"))
