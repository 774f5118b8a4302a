"""Queries on property, value and call lineage and on reports, over graphs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.functions.rules import references_identifier
from assetloom.operators import extraction, graph, reports, resolution, traversal
from assetloom.queries.graph import N, E, _walk_sql

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def node(kind, key):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


CR = fx.g1_roots_sql("customer")


@register("deep_call_chain", f"""WITH RECURSIVE {E}, {N}, r AS ({CR}), st AS (SELECT root, dst AS via FROM r JOIN e ON root = src WHERE type = 'places' UNION SELECT root, root FROM r WHERE root NOT IN (SELECT src FROM e WHERE type = 'places') UNION SELECT root, src FROM r JOIN e ON root = dst WHERE type = 'has_customer')
SELECT DISTINCT st.root, via, e.dst AS node, 1 AS depth, 'internal' AS kind, coalesce(n.label, e.dst) AS label FROM st JOIN e ON via = src AND e.type = 'contains_part' LEFT JOIN n ON n.node = e.dst""")
def _(s, d):
    return traversal.deep_call_chain(fx.g1_nodes(s, d), fx.g1_edges(s, d), fx.g1_roots(s, d, "customer"), ["contains_part"], "places", "has_customer")


@register("composition_scope_given", f"""WITH {E}, r AS ({CR}), sc AS (SELECT root, type, src, dst, k FROM r JOIN e ON root = dst WHERE root LIKE '%00'),
rest AS (SELECT root FROM r WHERE root NOT IN (SELECT root FROM sc)), u AS (SELECT root, type, src, dst, k FROM rest JOIN e ON dst = root WHERE type = 'has_customer'),
v AS (SELECT rest.root, e.type, e.src, e.dst, e.k FROM rest JOIN e p ON p.src = root AND p.type = 'places' JOIN e ON e.src = p.dst AND e.type = 'places' UNION SELECT root, type, src, dst, k FROM rest JOIN e ON src = root WHERE type = 'places')
SELECT * FROM sc UNION SELECT * FROM u UNION SELECT * FROM v""")
def _(s, d):
    r, e = fx.g1_roots(s, d, "customer"), fx.g1_edges(s, d)
    scopes = r.where(F.col("root").endswith("00")).join(e, F.col("root") == F.col("dst"))
    return traversal.composition_scope(e, r, scopes, ["has_customer"], ["places"])


def _segment_flows(s, d):
    """A customer's segment comes from its nation, whose segment comes from its region's name."""
    c, n, r = (fx.read(s, d, t) for t in ("customer", "nation", "region"))
    one = c.select(node("customer", "c_custkey").alias("child"), F.lit("segment").alias("prop"), node("nation", "c_nationkey").alias("owner"), F.lit("parameter").alias("kind"), F.lit("segment").alias("source"))
    two = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(node("nation", "n_nationkey").alias("child"), F.lit("segment").alias("prop"), node("region", "r_regionkey").alias("owner"), F.lit("literal").alias("kind"), F.col("r_name").alias("source"))
    return one.unionByName(two)


@register("pass_through_chain", """WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0)
SELECT 'customer:' || c_custkey AS root, 'segment' AS prop, 1 AS ord, 'nation:' || c_nationkey AS node, 'segment' AS expression FROM c UNION ALL SELECT 'customer:' || c_custkey, 'segment', 2, 'region:' || n_regionkey, 'region.segment' FROM c""")
def _(s, d):
    f = _segment_flows(s, d).select(F.col("owner").alias("parent"), "child", "prop", F.when(F.col("kind") == "literal", "region.segment").otherwise("segment").alias("expression"))
    return traversal.pass_through_chain(f, fx.g1_roots(s, d, "customer").withColumn("prop", F.lit("segment")))


@register("nested_dependency_chain", f"""WITH {E}, a AS (SELECT src AS root, dst AS node, contains(split_part(dst, ':', 2), '17') OR contains('17', substr(split_part(dst, ':', 2), 1, 5)) AS hit FROM e WHERE type = 'contains'),
b AS (SELECT root, node FROM a QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY root)),
c AS (SELECT root, node AS parent, dst AS node, contains(split_part(dst, ':', 2), '17') OR contains('17', substr(split_part(dst, ':', 2), 1, 5)) AS hit FROM b JOIN e ON node = src WHERE type = 'has_customer'),
d AS (SELECT root, node FROM c QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY root, parent))
SELECT root, '17' AS field, 1 AS ord, node FROM b UNION ALL SELECT root, '17', 2, node FROM d""")
def _(s, d):
    roots = fx.read(s, d, "region").select(node("region", "r_regionkey").alias("root"), F.lit("17").alias("field"))
    return traversal.nested_dependency_chain(fx.g1_edges(s, d, ["contains", "has_customer"]), roots)


@register("field_writers", """SELECT DISTINCT 'nation:' || c_nationkey AS root, 'write' AS role, 'order:' || o_orderkey AS owner, o_orderkey % 100 AS line, o_orderpriority AS context FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END""")
def _(s, d):
    o = fx.read(s, d, "orders")
    sites = o.select(node("order", "o_orderkey").alias("owner"), F.col("o_orderstatus").alias("field"), F.lit("write").alias("role"), (F.col("o_orderkey") % 100).alias("line"), F.col("o_orderpriority").alias("context"))
    roots = fx.read(s, d, "nation").select(node("nation", "n_nationkey").alias("root"), F.when(F.col("n_nationkey") % 2 == 0, "F").otherwise("O").alias("field"))
    return traversal.field_writers(fx.g1_edges(s, d, ["has_customer", "places"]), sites, roots)


@register("first_of_kind_in_tree", "SELECT o_custkey AS tree_id, min(o_orderkey) AS node_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def _(s, d):
    o = fx.read(s, d, "orders")
    child = o.select(F.col("o_custkey").alias("tree_id"), F.col("o_orderkey").alias("node_id"), F.lit(-1).cast("long").alias("parent_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("kind"))
    top = child.select("tree_id", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ord"), F.lit("root").alias("kind")).distinct()
    return traversal.first_of_kind_in_tree(top.unionByName(child), ["F"])


@register("edges_value_source", "SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'prop_source' AS type, 'status' AS prop, o_orderstatus AS value, o_orderkey AS k, o_orderpriority AS owner FROM orders")
def _(s, d):
    o = fx.read(s, d, "orders")
    flows = o.select(F.col("o_orderkey").alias("flow_id"), node("order", "o_orderkey").alias("child"), F.lit("status").alias("prop"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("owner"))
    return graph.edges_value_source(flows, o.select(F.col("o_orderkey").alias("flow_id"), node("customer", "o_custkey").alias("dst")))


def _v(i, tail=""):
    return f"'v' || (k + {i}) || 'x{tail}'"


_TIERS = [  # kind, by, key, tier
    (0, "root", _v(2), 0), (0, "whole", _v(5, ".f"), 1), (0, "root", _v(4), 1), (1, "root", _v(2), 2), (1, "root", _v(1), 2),
    (2, "root", _v(2), 3), (2, "root", _v(1), 3), (3, "root", _v(2), 4), (3, "root", _v(1), 4),
    (4, "whole", _v(1, ".f"), 5), (4, "root", _v(2), 5), (5, "whole", _v(6, ".f.g"), 6), (5, "root", _v(6), 6), (6, "whole", _v(3), 7), (6, "root", _v(3), 7),
]


@register("resolve_expression", f"""WITH n AS (SELECT p_partkey AS k, p_partkey % 7 AS m, 'part:' || p_partkey AS node FROM part),
x AS (SELECT k AS expr_id, 'v' || k || 'x' AS root, 'v' || k || 'x' || CASE WHEN k % 2 = 0 THEN '.f' ELSE '' END AS whole FROM n),
l AS ({" UNION ALL ".join(f"SELECT '{by}' AS kind, {key} AS key, {t} AS tier, k, node FROM n WHERE m = {m}" for m, by, key, t in _TIERS)}),
h AS (SELECT expr_id, tier, k, node FROM x JOIN l ON kind = 'whole' AND key = whole UNION ALL SELECT expr_id, tier, k, node FROM x JOIN l ON kind = 'root' AND key = root
UNION ALL SELECT expr_id, 2, k, node FROM x JOIN n ON m = 1 AND contains('load ' || {_v(0)} || ' now', root))
SELECT expr_id, node, tier::INTEGER AS tier FROM h QUALIFY row_number() OVER (PARTITION BY expr_id ORDER BY tier, k) = 1""")
def _(s, d):
    k, m = F.col("p_partkey"), F.col("p_partkey") % 7
    v = lambda i, tail="": F.concat(F.lit("v"), (k + i).cast("string"), F.lit(f"x{tail}"))
    kinds = F.array(*map(F.lit, ["hook", "data-fetch", "context", "store", "condition", "loop", "view"]))
    label = F.when(m == 1, F.concat(F.lit("load "), v(0), F.lit(" now"))).when(m == 6, v(3)).otherwise(F.concat(F.lit("n"), k.cast("string")))
    part = fx.read(s, d, "part")
    nodes = part.select(node("part", "p_partkey").alias("node"), k.alias("ord"), kinds[m.cast("int")].alias("type"), label.alias("label"), v(1).alias("name"), F.array(v(2)).alias("outputs"), F.array(F.struct(v(4).alias("name"), v(5, ".f").alias("source"))).alias("inputs"), F.when(m == 4, v(1, ".f")).when(m == 5, v(6, ".f.g")).alias("expression"), F.array(v(2)).alias("reads"))
    asked = part.select(k.alias("expr_id"), F.concat(F.lit(" "), v(0), F.when(k % 2 == 0, ".f").otherwise("")).alias("expression"))
    return resolution.resolve_expression(asked, resolution.expression_lookup(nodes))


def _attributes(s, d):
    a = extraction.element_attributes(fx.read(s, d, "pages"), "page_id", content="html")
    a = a.select("page_id", "tag", F.explode(F.arrays_zip("names", "values")).alias("x"))
    return a.select(F.concat(F.lit("tag:"), "tag").alias("node"), node("page", "page_id").alias("giver"), F.col("x.names").alias("prop"), F.col("x.values").alias("value")).distinct()


_AT = """x AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][^<>]*)>', 1)) AS e FROM pages), y AS (SELECT page_id, lower(regexp_extract(e, '^([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, unnest(regexp_extract_all(regexp_replace(e, '^[a-zA-Z][a-zA-Z0-9-]*', ''), '([a-zA-Z][a-zA-Z0-9-]*(?:="[^"]*")?)', 1)) AS a FROM x),
at1 AS (SELECT DISTINCT 'tag:' || tag AS node, 'page:' || page_id AS giver, split_part(a, '=', 1) AS prop, CASE WHEN contains(a, '=') THEN substr(regexp_replace(a, '^[^=]*="|"$', '', 'g'), 1, 100) ELSE 'true' END AS value FROM y)"""


@register("received_properties", f"WITH {_AT} SELECT node, giver, prop, value, node = 'tag:a' AND prop = 'href' AS declared FROM at1")
def _(s, d):
    a = _attributes(s, d)
    return reports.received_properties(a, a.where("node = 'tag:a' AND prop = 'href'").select("node", "prop").distinct())


@register("property_origins", f"WITH {_AT}, o AS (SELECT DISTINCT node, prop, value AS origin FROM at1 WHERE node = 'tag:html') SELECT node, prop, origin, 'source' AS kind FROM o UNION ALL SELECT node, prop, giver, 'passed' FROM at1 WHERE node <> 'tag:html'")
def _(s, d):
    a = _attributes(s, d)
    return reports.property_origins(a.where("node = 'tag:html'").select("node", "prop", F.col("value").alias("origin")).distinct(), a)


@register("pass_downs", f"WITH {_AT} SELECT DISTINCT giver, 'utf' AS name, node AS child, prop, true AS renamed FROM at1 WHERE regexp_matches(value, '(^|[^A-Za-z0-9_$.])utf($|[^A-Za-z0-9_$])')")
def _(s, d):
    a = _attributes(s, d)
    return reports.pass_downs(a, a.select(F.col("giver").alias("owner"), F.lit("utf").alias("name")).distinct(), references_identifier)


@register("symbol_usage_sites", "SELECT DISTINCT user_id AS owner, event_type AS name, event_type AS kind, event_id AS line FROM events WHERE event_id % 3 = 0")
def _(s, d):
    e = fx.read(s, d, "events")
    expr = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("f("), "event_type", F.lit(".x)"))).otherwise(F.concat(F.lit("a."), "event_type", F.lit("s")))
    sites = e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("kind"), expr.alias("expression"), F.col("event_id").alias("line"))
    return reports.symbol_usage_sites(sites, e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("name")).distinct(), references_identifier)


@register("node_context", f"""WITH {E}, {N}, r AS (SELECT 'order:' || o_orderkey AS root FROM orders WHERE o_orderkey % 20 = 0),
c AS (SELECT root, 'gates' AS section, 1::BIGINT AS ord, src AS related FROM r JOIN e ON dst = root WHERE type = 'places' UNION SELECT root, 'sources', k, src FROM r JOIN e ON dst = root WHERE type = 'places' UNION SELECT root, 'children', k, dst FROM r JOIN e ON src = root WHERE type = 'contains_part')
SELECT root, section, ord, label, related FROM c JOIN n ON node = related""")
def _(s, d):
    return traversal.node_context(fx.g1_edges(s, d), fx.g1_nodes(s, d), fx.g1_roots(s, d, "order"), fx.G1_PRIORITY, "customer", ["supplies"], ["places"], ["contains_part"])


@register("trace_identifier", f"""WITH RECURSIVE {E}, {N}, r AS ({CR}), w(root, node, depth, via) AS (SELECT root, root, 0, NULL::VARCHAR FROM r UNION SELECT root, src, depth - 1, type FROM w JOIN e ON node = dst WHERE type IN ('contains', 'has_customer'))
SELECT split_part(root, ':', 2)::BIGINT AS expr_id, 'c' || split_part(root, ':', 2) || '.name' AS identifier, w.node, depth::INTEGER AS depth, via, n.type AS role FROM w JOIN n ON w.node = n.node""")
def _(s, d):
    c = fx.read(s, d, "customer")
    lookup = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.lit(0).alias("tier"), F.lit(0).alias("ord"), node("customer", "c_custkey").alias("node"))
    exprs = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("expr_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".name")).alias("expression"))
    return traversal.trace_identifier(fx.g1_edges(s, d), fx.g1_nodes(s, d), exprs, lookup, ["contains", "has_customer"])


@register("layer_data_source", """SELECT 'data-source:customer:' || arg_min(o_custkey, o_orderkey) AS src, 'data-source:order:' || o_orderkey AS dst, CASE WHEN any_value(o_orderstatus) = 'F' THEN 'awaits' ELSE 'calls' END AS type FROM orders GROUP BY o_orderkey
UNION ALL SELECT DISTINCT 'data-source:order:' || l_orderkey, 'data-source:order:' || l_orderkey || '#' || l_linestatus, 'outputs' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def _(s, d):
    o, li = fx.read(s, d, "orders"), fx.read(s, d, "lineitem")
    calls = o.select(node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst"), (F.col("o_orderstatus") == "F").alias("awaited"), F.col("o_orderkey").alias("k"))
    outputs = li.select(node("order", "l_orderkey").alias("node"), F.col("l_linestatus").alias("name"))
    return graph.layer_data_source(o.select(node("order", "o_orderkey").alias("node"), F.col("o_orderpriority").alias("label")), calls, outputs)[1]


@register("layer_state", """SELECT DISTINCT 'state:customer:' || c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN 'isBuilding' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'derived' ELSE 'state' END AS kind FROM customer""")
def _(s, d):
    c = fx.read(s, d, "customer")
    holders = c.select(node("customer", "c_custkey").alias("node"), F.when(F.col("c_custkey") % 2 == 0, "isBuilding").otherwise(F.col("c_mktsegment")).alias("name"))
    o = fx.read(s, d, "orders").select(node("order", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("node"))
    return graph.layer_state(holders, o)[0]


@register("layer_events", """WITH h AS (SELECT 'u:' || user_id AS node, CASE event_type WHEN 'click' THEN 'onClick' WHEN 'view' THEN 'onView' ELSE 'title' END AS prop, CASE WHEN event_id % 2 = 0 THEN 'setView' ELSE 'router.push(x)' END AS value FROM events),
e AS (SELECT node, node || '#' || prop AS ev, CASE WHEN contains(value, '(') THEN 'inline#' || node || '#' || prop ELSE value END AS handler, CASE WHEN contains(value, '(') THEN 'router-action' ELSE 'state-update' END AS action, CASE WHEN contains(value, '(') THEN 'inline-handler' ELSE 'callback' END AS how FROM h WHERE prop <> 'title')
SELECT node AS src, ev AS dst, 'emits' AS type FROM e UNION SELECT ev, handler, how FROM e UNION SELECT handler, action, 'performs' FROM e""")
def _(s, d):
    e = fx.read(s, d, "events")
    prop = F.when(F.col("event_type") == "click", "onClick").when(F.col("event_type") == "view", "onView").otherwise("title")
    return graph.layer_events(e.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("node"), prop.alias("prop"), F.when(F.col("event_id") % 2 == 0, "setView").otherwise("router.push(x)").alias("value")))


_SECT = """entry AS (SELECT root, 'entry' AS section, 0::BIGINT AS ord, node AS subject, label AS value FROM r JOIN n ON root = node),
t(root, node, depth, path) AS (SELECT root, root, 0, root FROM r UNION ALL SELECT root, dst, depth + 1, path || ' > ' || dst FROM t JOIN (SELECT DISTINCT src, dst FROM e WHERE type IN ({down})) p ON node = src WHERE depth < 3),
tree AS (SELECT root, 'tree', row_number() OVER (PARTITION BY root ORDER BY path), node, repeat('  ', depth) || node FROM t),
cl(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, dst, depth + 1 FROM cl JOIN e ON node = src WHERE depth < 6 AND type IN ({call})),
calls AS (SELECT root, 'calls', min(depth), cl.node, coalesce(any_value(label), cl.node) FROM cl LEFT JOIN n ON n.node = cl.node WHERE depth > 0 GROUP BY root, cl.node),
ps AS (SELECT root, 'passed', k, dst, type FROM r JOIN e ON root = src WHERE type IN ({passing})),
rc AS (SELECT root, 'received', k, src, type FROM r JOIN e ON root = dst WHERE type IN ({passing})),
dy AS (SELECT root, 'dynamic', k, src, type FROM r JOIN e ON root = dst WHERE type IN ({lazy})),
hk AS (SELECT DISTINCT root, 'hooks', 0, dst, n.label FROM r JOIN e ON root = src LEFT JOIN n ON dst = n.node WHERE e.type IN ({hooks})),
bd AS (SELECT root, 'boundary', 0, path, CASE WHEN length(path) % 2 = 0 THEN 'client' WHEN root IN (SELECT root FROM hk) THEN 'client by use' ELSE 'server' END FROM r JOIN n ON root = node),
uc AS (SELECT root, 'warnings', 1, root, 'uses hooks without a client mark' FROM r JOIN n ON root = node WHERE length(path) % 2 <> 0 AND root IN (SELECT root FROM hk)),
us(root, node, depth) AS (SELECT root, root, 0 FROM r UNION SELECT root, src, depth + 1 FROM us JOIN e ON node = dst WHERE depth < 6 AND type IN ({up})),
usage AS (SELECT root, 'usage', min(depth), node, min(depth)::VARCHAR FROM us WHERE node <> root GROUP BY root, node),
rel AS (SELECT DISTINCT root, 'related', 0, path, path FROM (SELECT root, root AS node FROM r UNION SELECT root, dst FROM r JOIN e ON root = src UNION SELECT root, src FROM r JOIN e ON root = dst) JOIN n USING (node)),
warn AS (SELECT root, 'warnings', 0, root, 'nothing uses it' FROM r WHERE root NOT IN (SELECT root FROM usage) AND root NOT IN (SELECT root FROM dy))
SELECT * FROM entry UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM calls UNION ALL SELECT * FROM usage UNION ALL SELECT * FROM rel UNION ALL SELECT * FROM warn
UNION ALL SELECT * FROM ps UNION ALL SELECT * FROM rc UNION ALL SELECT * FROM dy UNION ALL SELECT * FROM hk UNION ALL SELECT * FROM bd UNION ALL SELECT * FROM uc"""


_SHOWN = """cons AS (SELECT root, src AS subject, min(k) AS ord FROM r JOIN e ON root = dst WHERE type IN ({used_by}) GROUP BY ALL),
sh(member, node) AS (SELECT node, node FROM n WHERE type = '{route}' UNION SELECT member, dst FROM sh JOIN e ON node = src WHERE type IN ({along})),
"""


def _report(kind, down, up, call, passing, hooks, lazy, used_by=(), shows=None):
    q = lambda x: ", ".join(repr(t) for t in x)
    sql = f"WITH RECURSIVE {E}, {N}, r AS ({fx.g1_roots_sql(kind)}), " + _SECT.format(down=q(down), up=q(up), call=q(call), passing=q(passing), hooks=q(hooks), lazy=q(lazy))
    if used_by:
        sql = sql.replace("entry AS (", _SHOWN.format(used_by=q(used_by), route=shows[0], along=q(shows[1])) + "entry AS (", 1)
        sql += "\nUNION ALL SELECT root, 'consumers', ord, subject, label FROM cons JOIN n ON subject = node UNION ALL SELECT root, 'routes', 0, subject, member FROM cons JOIN sh ON subject = node"

    def run(s, d):
        n = fx.g1_nodes(s, d)
        flags = n.select("path", (F.char_length("path") % 2 == 0).alias("client")).distinct()
        return reports.trace_symbol(n, fx.g1_edges(s, d), fx.g1_roots(s, d, kind), down, up, call, passing=passing, hooks=hooks, lazy=lazy, flags=flags, used_by=used_by, routes=shows)

    return sql, run


for _name, _args in {
    "trace_component": ("customer", ["places", "contains_part"], ["contains", "has_customer"], ["places", "contains_part"], ("places", "has_customer"), ("places",), ("has_supplier",)),
    "trace_hook": ("part", ["supplies"], ["places", "contains_part"], ["supplies"], ("contains_part",), ("places",), ("supplies",), ("contains_part",), ("nation", ["has_customer", "places"])),
    "trace_route": ("nation", ["has_customer"], ["contains"], ["has_customer", "has_supplier"], ("has_customer", "contains"), ("has_supplier",), ("contains",)),
}.items():
    _sql, _f = _report(*_args)
    register(_name, _sql)(_f)


@register("impact_routes", _walk_sql(["has_customer", "places", "contains_part"], fx.g1_roots_sql("part"), 6, "in", "SELECT DISTINCT root, '/nation/' || split_part(node, ':', 2) AS route FROM v WHERE starts_with(node, 'nation:')"))
def _(s, d):
    e, r = fx.g1_edges(s, d, ["has_customer", "places", "contains_part"]), fx.g1_roots(s, d, "part")
    nations = fx.read(s, d, "nation").select(node("nation", "n_nationkey").alias("node"), node("nation", "n_nationkey").alias("asset"))
    touching = nations.select("asset", F.concat(F.lit("/nation/"), F.split_part("node", F.lit(":"), F.lit(2))).alias("route"))
    return traversal.impact_routes(traversal.impact(e, r), r, nations, touching)
