"""Queries on the lineage of properties and values and on the steps around a focus: a customer is a component, orders are hooks or fetches, nations and regions what is above it."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.operators import lineage, search, traversal
from assetloom.operators.resolution import expression_lookup

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def key(kind, column):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def text(prefix, column, suffix=""):
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix))


_INPUTS = "array<struct<name: string, source: string>>"


def _node(df, kind, column, type_, label, name=None, outputs=None, reads=None, inputs=None, path=None):
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    return df.select(key(kind, column).alias("node"), F.col(column).cast("long").alias("ord"), F.lit(type_).alias("type"), label.alias("label"), (none if name is None else name).alias("name"), (empty if outputs is None else F.array(outputs)).alias("outputs"), (empty if reads is None else F.array(reads)).alias("reads"), (F.array().cast(_INPUTS) if inputs is None else inputs).alias("inputs"), none.alias("expression"), F.lit(path or f"/{kind}").alias("path"))


def _customers(s, d):
    """Customers whose key is divisible by 20, with the region and the first order of each."""
    c, n = fx.read(s, d, "customer").where(F.col("c_custkey") % fx.EVERY == 0), fx.read(s, d, "nation")
    o = fx.read(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_first"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("m", (F.col("c_custkey") / fx.EVERY).cast("long"))


_C = "c AS (SELECT *, c_custkey // 20 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_first FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE c_custkey % 20 = 0)"


def _property_tables(s, d):
    """A customer's segment comes from its nation: as a parameter, by a call, as a member of a name, or without an expression; the nation's region from its region's passed world or a call."""
    c, n = fx.read(s, d, "customer").withColumn("m", (F.col("c_custkey") / fx.EVERY).cast("long") % 4), fx.read(s, d, "nation")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("long")

    def edge(df, src, dst, kind, k, prop=none, passed=none, flow=none, callee=none):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), k.cast("long").alias("k"), prop.alias("prop"), passed.alias("passed_from"), flow.alias("flow_id"), callee.alias("callee"))

    seg = text("service:", "c_mktsegment")
    edges = edge(c, seg, key("customer", "c_custkey"), "prop_source", F.col("c_custkey"), F.lit("Segment"), key("nation", "c_nationkey"), F.when(F.col("m") < 3, text("c", "c_custkey")))
    edges = edges.unionByName(edge(n, F.lit("service:region"), key("nation", "n_nationkey"), "prop_source", F.col("n_nationkey"), F.lit("region"), key("region", "n_regionkey"), text("n", "n_nationkey")))
    r = fx.read(s, d, "region")
    edges = edges.unionByName(edge(r, F.lit("world:1"), key("region", "r_regionkey"), "passes_prop", F.col("r_regionkey"), F.lit("World")))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    links = n.withColumn("segment", F.explode(F.array(*(F.lit(x) for x in segments))))
    edges = edges.unionByName(edge(links.where("n_nationkey % 3 = 0"), key("nation", "n_nationkey"), text("service:", "segment"), "sequence", F.col("n_nationkey")))
    edges = edges.unionByName(edge(n.where("n_nationkey % 3 = 1"), key("nation", "n_nationkey"), F.lit("service:any"), "calls", F.col("n_nationkey"), callee=F.lit("my.useSeg")))

    def flow(df, of, node_id, parent, kind, name=none, prop=none, callee=none, line=1):
        return df.select(of.alias("flow_id"), F.lit(node_id).cast("long").alias("node_id"), (no if parent is None else F.lit(parent).cast("long")).alias("parent_id"), F.lit(0).alias("ord"), F.lit(kind).alias("kind"), name.alias("name"), prop.alias("property"), callee.alias("callee"), F.lit(line).alias("line"), F.lit(kind).alias("expression"))

    one, two, three, f = c.where("m = 0"), c.where("m = 1"), c.where("m = 2"), text("c", "c_custkey")
    flows = flow(one, f, 1, None, "parameter", F.lit("region"))
    flows = flows.unionByName(flow(two, f, 1, None, "identifier", F.lit("seg"), line=2)).unionByName(flow(two, f, 2, 1, "await")).unionByName(flow(two, f, 3, 2, "call", callee=F.lit("useSeg.get")))
    flows = flows.unionByName(flow(three, f, 1, None, "member", prop=F.lit("name"), line=3)).unionByName(flow(three, f, 2, 1, "identifier", F.lit("data"), line=4))
    even, odd, g = n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 2 = 1"), text("n", "n_nationkey")
    flows = flows.unionByName(flow(even, g, 1, None, "parameter", F.lit("world"))).unionByName(flow(odd, g, 1, None, "hook_call", callee=F.lit("fetchRegion")))
    return fx.g1_nodes(s, d), edges, flows, fx.g1_roots(s, d, "customer").withColumn("prop", F.lit("segment"))


@register(
    "property_lineage",
    f"""WITH {_C}, x AS (SELECT 'customer:' || c_custkey AS root, 'prop:customer:' || c_custkey || ':segment' AS sink, 'nation:' || n_nationkey AS n, 'region:' || r_regionkey AS r, 'service:' || c_mktsegment AS src, m % 4 AS m, n_nationkey AS k FROM c),
up AS (SELECT root, n, r, k, 'prop:' || n || ':region' AS ps FROM x WHERE m = 0)
SELECT root, 'segment' AS prop, src, dst, type, label FROM (
  SELECT root, n AS src, sink AS dst, 'passes_prop' AS type, NULL AS label FROM x
  UNION ALL SELECT root, 'prop:' || n || ':region', sink, 'prop_source', NULL FROM x WHERE m = 0
  UNION ALL SELECT root, r, ps, 'passes_prop', NULL FROM up
  UNION ALL SELECT root, 'prop:' || r || ':world', ps, 'prop_source', NULL FROM up WHERE k % 2 = 0
  UNION ALL SELECT root, 'world:1', 'prop:' || r || ':world', 'passes_prop', NULL FROM up WHERE k % 2 = 0
  UNION ALL SELECT root, 'service:region', ps, 'prop_source', 'hook_call' FROM up WHERE k % 2 = 1
  UNION ALL SELECT root, src, 'step:' || n || ':2:seg', 'prop_source', 'call' FROM x WHERE m = 1
  UNION ALL SELECT root, src, 'step:' || n || ':2:seg', 'sequence', 'identifier' FROM x WHERE m = 1
  UNION ALL SELECT root, 'step:' || n || ':2:seg', sink, 'prop_source', NULL FROM x WHERE m = 1
  UNION ALL SELECT root, n, src, 'calls', NULL FROM x WHERE m = 1 AND k % 3 = 1
  UNION ALL SELECT root, 'step:' || n || ':4:data', 'step:' || n || ':3:name', 'sequence', 'member' FROM x WHERE m = 2
  UNION ALL SELECT root, 'step:' || n || ':' || s, sink, 'prop_source', NULL FROM x, (VALUES ('4:data'), ('3:name')) t(s) WHERE m = 2
  UNION ALL SELECT root, src, sink, 'prop_source', NULL FROM x WHERE m = 3
  UNION ALL SELECT root, n, src, 'sequence', NULL FROM x WHERE m IN (1, 3) AND k % 3 = 0)""",
)
def _(s, d):
    return lineage.property_lineage(*_property_tables(s, d))[1]


@register(
    "property_lineage_nodes",
    f"""WITH {_C}, x AS (SELECT 'customer:' || c_custkey AS root, 'prop:customer:' || c_custkey || ':segment' AS sink, 'nation:' || n_nationkey AS n, n_name, 'region:' || r_regionkey AS r, r_name, 'service:' || c_mktsegment AS src, m % 4 AS m, n_nationkey AS k FROM c)
SELECT root, 'segment' AS prop, node, type, label, false AS cut FROM (
  SELECT root, sink AS node, 'prop' AS type, 'segment' AS label FROM x
  UNION ALL SELECT root, n, 'nation', n_name FROM x
  UNION ALL SELECT root, 'prop:' || n || ':region', 'prop', 'region' FROM x WHERE m = 0
  UNION ALL SELECT root, r, 'region', r_name FROM x WHERE m = 0
  UNION ALL SELECT root, 'prop:' || r || ':world', 'prop', 'world' FROM x WHERE m = 0 AND k % 2 = 0
  UNION ALL SELECT root, 'world:1', NULL, NULL FROM x WHERE m = 0 AND k % 2 = 0
  UNION ALL SELECT root, 'service:region', NULL, NULL FROM x WHERE m = 0 AND k % 2 = 1
  UNION ALL SELECT root, 'step:' || n || ':2:seg', 'variable', 'seg' FROM x WHERE m = 1
  UNION ALL SELECT root, 'step:' || n || ':' || s, 'variable', split_part(s, ':', 2) FROM x, (VALUES ('4:data'), ('3:name')) t(s) WHERE m = 2
  UNION ALL SELECT root, src, NULL, NULL FROM x WHERE m IN (1, 3))""",
)
def _(s, d):
    return lineage.property_lineage(*_property_tables(s, d))[0]


_W = "a AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), p AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS i FROM lineitem GROUP BY ALL)"


@register(
    "focus_steps",
    f"""WITH {_C}, {_W}, s AS (
  SELECT c_custkey AS c, 'nation:' || n_nationkey AS node, -1 AS depth, 'visibility-condition' AS role, NULL AS expression, 0 AS k FROM c
  UNION ALL SELECT c_custkey, 'region:' || r_regionkey, -2, 'data-source', 'r' || r_regionkey || '.name', 0 FROM c
  UNION ALL SELECT c_custkey, 'order:' || o_first, -3, 'hook-logic', 'o' || o_first || '.total', 0 FROM c WHERE o_first IS NOT NULL
  UNION ALL SELECT c_custkey, 'part:' || p, -4, 'data-source', 'p' || p || '.price', i * 1000000000000 + p FROM c JOIN p ON o = o_first
  UNION ALL SELECT c_custkey, 'order:' || o, -4, 'hook-logic', 'places', 1000000000000000 + o FROM c JOIN a ON c = c_custkey WHERE rn > 1
  UNION ALL SELECT c_custkey, 'customer:' || c_custkey, 0, 'focus', NULL, 0 FROM c
  UNION ALL SELECT c_custkey, 'order:' || o, 1, 'hook-logic', NULL, 0 FROM c JOIN a ON c = c_custkey),
n AS (SELECT *, row_number() OVER w AS ord, lead(node) OVER w AS next, lead(depth) OVER w AS nd FROM s WINDOW w AS (PARTITION BY c ORDER BY depth, k, node))
SELECT 'customer:' || c AS root, ord::INTEGER AS ord, node, depth, role, expression, next, CASE WHEN next IS NULL THEN NULL WHEN depth = -2 THEN 'contains' WHEN depth = -1 THEN 'has_customer' WHEN depth = 0 THEN 'places' WHEN nd > 0 THEN 'renders' ELSE 'feeds' END AS link FROM n""",
)
def _(s, d):
    line = fx.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("of")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))  # at most seven lines an order
    inputs = F.transform("x", lambda x: F.struct(F.lit("part").alias("name"), F.concat(F.lit("p"), x["l_partkey"].cast("string"), F.lit(".price")).alias("source")))
    o = fx.read(s, d, "orders").join(line, F.col("o_orderkey") == F.col("of"), "left")
    nodes = _node(fx.read(s, d, "region"), "region", "r_regionkey", "store", F.col("r_name"), outputs=text("r", "r_regionkey"))
    nodes = nodes.unionByName(_node(fx.read(s, d, "nation"), "nation", "n_nationkey", "condition", F.col("n_name"), reads=text("r", "n_regionkey", ".name")))
    nodes = nodes.unionByName(_node(fx.read(s, d, "customer"), "customer", "c_custkey", "component", F.col("c_name")))
    nodes = nodes.unionByName(_node(o, "order", "o_orderkey", "hook", text("HOOK#", "o_orderkey"), outputs=text("o", "o_orderkey"), inputs=inputs))
    nodes = nodes.unionByName(_node(fx.read(s, d, "part"), "part", "p_partkey", "data-fetch", text("PART#", "p_partkey"), text("FETCH#", "p_partkey"), outputs=text("p", "p_partkey")))
    c = _customers(s, d).where("o_first is not null")
    passes = c.select(key("customer", "c_custkey").alias("node"), F.lit(0).alias("ord"), text("o", "o_first", ".total").alias("expression"))
    return lineage.focus_steps(nodes, fx.g1_edges(s, d, ["contains", "has_customer", "places"]), fx.g1_roots(s, d, "customer"), passes, expression_lookup(nodes, hook_inputs=False), fx.G1_PRIORITY, ["places"], uses="places")


@register(
    "value_trace",
    f"""WITH {_C}, x AS (SELECT *, m % 9 AS kind, 'customer:' || c_custkey AS root, 'nation:' || n_nationkey AS n, 'region:' || r_regionkey AS r, 'n' || n_nationkey AS nv, 'o' || o_first AS ov, 'order:' || o_first AS o FROM c LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders) ON o_orderkey = o_first),
e AS (SELECT *, CASE kind WHEN 0 THEN 'loc' WHEN 1 THEN 'der' WHEN 2 THEN coalesce(ov || '.status', 'missing') WHEN 3 THEN 'market' WHEN 4 THEN 'item.name' WHEN 5 THEN nv || '.name' WHEN 6 THEN 's' || (c_nationkey % 5 + 1) || '.name' WHEN 7 THEN 'r' || r_regionkey || '.x' ELSE 'status' END AS expression, CASE WHEN kind = 8 THEN 'status' END AS prop FROM x),
f AS (SELECT * FROM e WHERE kind IN (1, 2, 8) AND o_first IS NOT NULL),
t AS (
  SELECT c_custkey, 0 AS sec, 'hook-local' AS origin, 'variable' AS role, 'local' AS type, root AS node, 'loc' AS label FROM e WHERE kind = 0
  UNION ALL SELECT c_custkey, 1, 'hook-local', 'hook', 'hook', n, 'useNation' || n_nationkey FROM e WHERE kind = 0
  UNION ALL SELECT c_custkey, 2, 'hook-local', 'hook', 'hook', r, r_name FROM e WHERE kind = 0
  UNION ALL SELECT c_custkey, 0, 'derived-local', 'variable', 'local', root, 'der' FROM e WHERE kind = 1
  UNION ALL SELECT c_custkey, 10, CASE kind WHEN 1 THEN 'derived-local' ELSE 'fetch' END, 'prop', 'prop', n, 'status' FROM f WHERE kind <> 2
  UNION ALL SELECT c_custkey, 11, CASE kind WHEN 1 THEN 'derived-local' ELSE 'fetch' END, 'variable', 'variable', o, ov FROM f
  UNION ALL SELECT c_custkey, 12, CASE kind WHEN 1 THEN 'derived-local' ELSE 'fetch' END, 'await-call', 'data-fetch', o, 'FETCH#' || o_first || '()' FROM f
  UNION ALL SELECT c_custkey, 13, CASE kind WHEN 1 THEN 'derived-local' ELSE 'fetch' END, 'api-call', 'api', o, 'GET ' || o_first FROM f
  UNION ALL SELECT c_custkey, 14, CASE kind WHEN 1 THEN 'derived-local' ELSE 'fetch' END, 'hardcode', 'hardcode', o, 'Hard code: ' || o_orderstatus FROM f
  UNION ALL SELECT c_custkey, 11, 'variable', 'variable', 'variable', root, 'missing' FROM e WHERE kind = 2 AND o_first IS NULL
  UNION ALL SELECT c_custkey, 11, 'binding', 'variable', 'binding', '/customer#market', 'market' FROM e WHERE kind = 3
  UNION ALL SELECT c_custkey, 12, 'binding', 'function', 'function', '/customer#market', 'loadMarket()' FROM e WHERE kind = 3
  UNION ALL SELECT c_custkey, 11, 'loop', 'variable', 'member', root, 'item.name' FROM e WHERE kind = 4
  UNION ALL SELECT c_custkey, 12, 'loop', 'variable', 'loop-item', n, 'item' FROM e WHERE kind = 4
  UNION ALL SELECT c_custkey, 13, 'loop', 'variable', 'binding', CASE WHEN n_nationkey % 2 = 0 THEN '/customer#market' ELSE root END, CASE WHEN n_nationkey % 2 = 0 THEN 'market' ELSE 'rows' END FROM e WHERE kind = 4
  UNION ALL SELECT c_custkey, 14, 'loop', 'function', 'function', '/customer#market', 'loadMarket()' FROM e WHERE kind = 4 AND n_nationkey % 2 = 0
  UNION ALL SELECT c_custkey, 11, 'hook-field', 'variable', 'field', n, nv FROM e WHERE kind = 5
  UNION ALL SELECT c_custkey, 12, 'hook-field', 'hook', 'hook', n, '(hook) useNation' || n_nationkey FROM e WHERE kind = 5
  UNION ALL SELECT c_custkey, 13, 'hook-field', 'hook', 'hook', r, '(hook) ' || r_name FROM e WHERE kind = 5
  UNION ALL SELECT c_custkey, 11, 'context', 'context', 'context', 'supplier:' || (c_nationkey % 5 + 1), 'SUP#' || (c_nationkey % 5 + 1) FROM e WHERE kind = 6
  UNION ALL SELECT c_custkey, 11, 'store', 'store', 'store', r, r_name FROM e WHERE kind = 7)
SELECT root, expression, prop, (row_number() OVER (PARTITION BY c_custkey ORDER BY sec))::INTEGER AS ord, origin, role, type, node, label FROM t JOIN e USING (c_custkey)""",
)
def _(s, d):
    orders, nation, region = fx.read(s, d, "orders"), fx.read(s, d, "nation"), fx.read(s, d, "region")
    nodes = _node(region, "region", "r_regionkey", "store", F.col("r_name"), outputs=text("r", "r_regionkey"))
    nodes = nodes.unionByName(_node(nation, "nation", "n_nationkey", "hook", text("useNation", "n_nationkey"), outputs=text("n", "n_nationkey")))
    nodes = nodes.unionByName(_node(fx.read(s, d, "customer"), "customer", "c_custkey", "component", F.col("c_name")))
    nodes = nodes.unionByName(_node(fx.read(s, d, "supplier"), "supplier", "s_suppkey", "context", text("SUP#", "s_suppkey"), outputs=text("s", "s_suppkey")))
    nodes = nodes.unionByName(_node(orders, "order", "o_orderkey", "data-fetch", text("ORDER#", "o_orderkey"), text("FETCH#", "o_orderkey"), outputs=text("o", "o_orderkey")))
    c = _customers(s, d).withColumn("kind", F.col("m") % 9)
    e = F.when(F.col("kind") == 0, "loc").when(F.col("kind") == 1, "der").when(F.col("kind") == 2, F.coalesce(text("o", "o_first", ".status"), F.lit("missing"))).when(F.col("kind") == 3, "market").when(F.col("kind") == 4, "item.name")
    e = e.when(F.col("kind") == 5, text("n", "c_nationkey", ".name")).when(F.col("kind") == 6, F.concat(F.lit("s"), (F.col("c_nationkey") % 5 + 1).cast("string"), F.lit(".name"))).when(F.col("kind") == 7, text("r", "n_regionkey", ".x")).otherwise("status")
    roots = c.where("kind <> 8 or o_first is not null").select(key("customer", "c_custkey").alias("root"), e.alias("expression"), F.when(F.col("kind") == 8, "status").alias("prop"))
    hooked = F.col("kind") == 0
    locals_ = c.where("kind < 2").select(key("customer", "c_custkey").alias("consumer"), F.when(hooked, "loc").otherwise("der").alias("name"), F.when(hooked, text("useNation", "c_nationkey")).alias("source_hook"), F.when(hooked & (F.col("m") % 2 == 0), key("nation", "c_nationkey")).alias("hook_node"), (~hooked).alias("derived"), F.array(F.lit("other"), F.lit("status")).alias("refs"), F.array(F.lit("status")).alias("props"))
    flows = c.where("o_first is not null").select(key("nation", "c_nationkey").alias("parent"), key("customer", "c_custkey").alias("child"), F.lit("status").alias("prop"), text("o", "o_first", ".status").alias("expression"))
    bindings = s.createDataFrame([("/customer", "market", 5, "loadMarket"), ("/order", "market", 1, "wrong")], "file string, name string, ord long, call string")
    loops = nation.select(key("nation", "n_nationkey").alias("node"), F.lit("item").alias("item"), F.when(F.col("n_nationkey") % 2 == 0, "market").otherwise("rows").alias("source"))
    loops = loops.unionByName(region.select(key("region", "r_regionkey").alias("node"), F.lit("item").alias("item"), F.lit("farther").alias("source")))
    parents = fx.read(s, d, "customer").select(key("customer", "c_custkey").alias("node"), key("nation", "c_nationkey").alias("up")).unionByName(nation.select(key("nation", "n_nationkey").alias("node"), key("region", "n_regionkey").alias("up")))
    none = F.lit(None).cast("string")
    returns = orders.select(text("FETCH#", "o_orderkey").alias("function"), F.lit("status").alias("field"), none.alias("literal"), text("state", "o_orderstatus").alias("callee"), F.lit("value").alias("callee_field"))
    returns = returns.unionByName(orders.select(text("state", "o_orderstatus").alias("function"), F.lit("value").alias("field"), F.col("o_orderstatus").alias("literal"), none.alias("callee"), none.alias("callee_field")).distinct())
    calls = orders.select(key("order", "o_orderkey").alias("node"), F.lit(0).alias("ord"), F.lit("api").alias("kind"), text("GET ", "o_orderkey").alias("label"))
    depends = nation.select(F.lit("uses_hook").alias("type"), key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"), F.col("n_nationkey").cast("long").alias("k"))
    return lineage.value_trace(roots, nodes, depends, expression_lookup(nodes), expression_lookup(nodes, hook_inputs=False), locals_, flows, bindings, loops, parents, returns, calls)


def _retrieval_tables(s, d):
    """Customers are components, orders hooks, a nation is a route with its own file and its region's as layout. Orders have no file. Every fifth kind of request asks for what isn't there."""
    c, n, r, o = (fx.read(s, d, t) for t in ("customer", "nation", "region", "orders"))

    def nodes_of(df, kind, column, type_, label):
        return df.select(key(kind, column).alias("node"), F.lit(type_).alias("type"), label.alias("label"), text(f"/{kind}/", column).alias("path"), F.lit(2).alias("start"), F.lit(3).alias("end"))

    nodes = nodes_of(c, "customer", "c_custkey", "component", F.col("c_name")).unionByName(nodes_of(n, "nation", "n_nationkey", "layout", F.col("n_name"))).unionByName(nodes_of(r, "region", "r_regionkey", "layout", F.col("r_name"))).unionByName(nodes_of(o, "order", "o_orderkey", "hook", text("useOrder", "o_orderkey")))
    file = lambda df, kind, column, label: df.select(text(f"/{kind}/", column).alias("path"), F.concat(F.lit("first\n"), F.col(label), F.lit("\nthird\nfourth")).alias("content"))
    assets = file(c, "customer", "c_custkey", "c_name").unionByName(file(n, "nation", "n_nationkey", "n_name")).unionByName(file(r, "region", "r_regionkey", "r_name"))
    routes = n.select(text("/n/", "n_nationkey").alias("route"), F.explode(F.array(text("/nation/", "n_nationkey"), text("/region/", "n_regionkey"))).alias("asset"))
    q = _customers(s, d).withColumn("kind", F.col("m") % 5)
    intent = F.when(F.col("kind") < 1, "component_trace").when(F.col("kind") == 1, "hook_trace").when(F.col("kind") == 2, "route_trace").when(F.col("kind") == 3, "component_trace").otherwise("other")
    target = F.when(F.col("kind") < 1, F.col("c_name")).when(F.col("kind") == 1, text("useOrder", "o_first")).when(F.col("kind") == 2, text("n/", "c_nationkey", "/")).otherwise("nobody")
    requests = q.select(F.col("c_custkey").alias("query_id"), intent.alias("intent"), target.alias("target"))
    return requests, nodes, fx.g1_edges(s, d, ["contains", "has_customer", "places"]), assets, routes


_RET = f"""{_C}, e AS (SELECT * FROM ({fx.G1_SQL}) WHERE type IN ('contains', 'has_customer', 'places')),
nd AS (SELECT 'customer:' || c_custkey AS node, 'component' AS type, c_name AS label, '/customer/' || c_custkey AS path FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'layout', n_name, '/nation/' || n_nationkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'layout', r_name, '/region/' || r_regionkey FROM region UNION ALL SELECT 'order:' || o_orderkey, 'hook', 'useOrder' || o_orderkey, '/order/' || o_orderkey FROM orders),
fs AS (SELECT '/customer/' || c_custkey AS path, c_name AS line FROM customer UNION ALL SELECT '/nation/' || n_nationkey, n_name FROM nation UNION ALL SELECT '/region/' || r_regionkey, r_name FROM region),
q AS (SELECT c_custkey AS query_id, m % 5 AS kind, CASE m % 5 WHEN 1 THEN 'hook_trace' WHEN 2 THEN 'route_trace' WHEN 4 THEN 'other' ELSE 'component_trace' END AS intent, CASE m % 5 WHEN 0 THEN c_name WHEN 1 THEN 'useOrder' || o_first WHEN 2 THEN 'n/' || n_nationkey || '/' ELSE 'nobody' END AS target,
  CASE m % 5 WHEN 0 THEN 'customer:' || c_custkey WHEN 1 THEN 'order:' || o_first END AS root, n_nationkey, r_regionkey FROM c),
v AS (SELECT query_id, root, root AS node FROM q WHERE root IS NOT NULL UNION SELECT query_id, root, dst FROM q JOIN e ON src = root UNION SELECT query_id, root, src FROM q JOIN e ON dst = root),
x AS (SELECT DISTINCT query_id, root, type, src, dst, k FROM v JOIN e ON node = src OR node = dst),
y AS (SELECT query_id, root, src AS node, min({{'t': type, 'k': k}}) AS o FROM x GROUP BY ALL UNION ALL SELECT query_id, root, dst, min({{'t': type, 'k': k}}) FROM x GROUP BY ALL),
z AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY node <> root, min(o), node) AS ord FROM y GROUP BY query_id, root, node),
rt AS (SELECT query_id, unnest(['nation:' || n_nationkey, 'region:' || r_regionkey]) AS node, unnest([1, 2]) AS ord FROM q WHERE kind = 2),
sy AS (SELECT query_id, node, ord FROM z WHERE ord <= 8 UNION ALL FROM (SELECT query_id, node, ord FROM rt)),
ff AS (SELECT DISTINCT query_id, path, dense_rank() OVER (PARTITION BY query_id ORDER BY path) AS rank FROM sy JOIN nd USING (node)),
ret AS (
  SELECT query_id, 'symbols' AS section, ord::BIGINT AS ord, node AS subject, '- ' || label || chr(10) || '  - id: ' || node || chr(10) || '  - type: ' || type || chr(10) || '  - file: ' || path || chr(10) || '  - lines: 2-3' AS value FROM sy JOIN nd USING (node)
  UNION ALL SELECT query_id, 'edges', k, src, '- ' || src || ' --' || type || '--> ' || dst FROM (SELECT query_id, type, src, dst, k FROM x UNION SELECT query_id, type, src, dst, k FROM rt JOIN e ON node = src OR node = dst)
  UNION ALL SELECT query_id, 'snippets', 2, path, '### ' || path || ':2-3' || chr(10) || chr(10) || '```tsx' || chr(10) || line || chr(10) || 'third' || chr(10) || '```' FROM ff JOIN fs USING (path)
  UNION ALL SELECT query_id, 'warnings', 0, path, '- ' || path || ' can''t be read' FROM ff WHERE path NOT IN (SELECT path FROM fs)
  UNION ALL SELECT query_id, 'warnings', 0, coalesce(target, 'unknown'), CASE WHEN kind = 4 THEN '- intent other isn''t supported' ELSE '- ' || coalesce(target, 'unknown') || ' not found' END FROM q WHERE kind > 2 OR (kind = 1 AND root IS NULL))"""


@register("retrieval", f"WITH {_RET} SELECT * FROM ret")
def _(s, d):
    return search.retrieval(*_retrieval_tables(s, d))


@register(
    "retrieval_document",
    f"""WITH {_RET}, m AS (SELECT query_id, list_position(['symbols', 'edges', 'snippets', 'warnings'], section) AS no, ord, subject, value,
  ('0x' || substr(md5(coalesce(subject, '')), 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY query_id, section) / {10 * search.PART})::BIGINT AS bucket FROM ret),
b AS (SELECT *, (row_number() OVER (PARTITION BY query_id, no, bucket ORDER BY ord, subject, value) - 1) // {search.PART} AS block FROM m),
p AS (SELECT query_id, no, bucket, block, string_agg(value, chr(10) ORDER BY ord, subject, value) AS text FROM b GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY no, bucket, block))::INTEGER AS part, text FROM (
  SELECT query_id, 0 AS no, 0 AS bucket, 0 AS block, '# Code Trace Context' || chr(10) || chr(10) || '## Intent' || chr(10) || chr(10) || intent || chr(10) || chr(10) || '## Target' || chr(10) || chr(10) || coalesce(target, 'unknown') AS text FROM q
  UNION ALL SELECT query_id, no, -1, 0, '## ' || title FROM q, (VALUES (1, 'Symbols'), (2, 'Graph Edges'), (3, 'Source Snippets'), (4, 'Warnings')) t(no, title)
  UNION ALL SELECT query_id, t.no, coalesce(bucket, 0), coalesce(block, 0), coalesce(p.text, '- none') FROM q CROSS JOIN (VALUES (1), (2), (3), (4)) t(no) LEFT JOIN p USING (query_id, no))""",
)
def _(s, d):
    return search.retrieved_documents(*_retrieval_tables(s, d))


@register(
    "impact_chains",
    """WITH lo AS (SELECT DISTINCT l_partkey AS p, 'order:' || l_orderkey AS o FROM lineitem WHERE l_partkey % 20 = 0),
w2 AS (SELECT p, 'customer:' || o_custkey AS c, min(lo.o) AS o FROM lo JOIN orders ON lo.o = 'order:' || o_orderkey GROUP BY ALL),
w3 AS (SELECT p, 'nation:' || c_nationkey AS n, min(w2.c) AS c FROM w2 JOIN customer ON w2.c = 'customer:' || c_custkey GROUP BY ALL)
SELECT 'part:' || p AS root, n AS node, 3 AS depth, 'part:' || p || ' <- ' || w2.o || ' <- ' || w3.c || ' <- ' || n AS chain FROM w3 JOIN w2 USING (p, c)""",
)
def _(s, d):
    types = ["has_customer", "places", "contains_part"]
    ends = fx.read(s, d, "nation").select(key("nation", "n_nationkey").alias("node"))
    return traversal.impact_chains(fx.g1_edges(s, d, types), fx.g1_roots(s, d, "part"), types, ends)


@register(
    "traced_field_writers",
    """WITH o AS (SELECT 'nation:' || c_nationkey AS root, CASE WHEN c_nationkey % 2 = 0 THEN 'status' ELSE 'HIGH' END AS field, 'order:' || o_orderkey AS owner, o_orderkey % 100 AS line, o_orderstatus AS st, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT DISTINCT root, field, 'write' AS role, owner, line, 'event' AS context FROM o WHERE st = 'O' OR (st = 'F' AND field = 'status')
UNION SELECT root, field, 'trigger', owner, line, 'effect' FROM o WHERE (p LIKE '%HIGH' AND field = 'HIGH')""",
)
def _(s, d):
    o = fx.read(s, d, "orders").select(key("order", "o_orderkey").alias("owner"), (F.col("o_orderkey") % 100).alias("line"), "o_orderstatus", "o_orderpriority")
    callee = F.when(F.col("o_orderstatus") == "F", "api.setStatus").when(F.col("o_orderstatus") == "O", "store.set").otherwise("other")
    calls = o.select("owner", callee.alias("callee"), F.lit("event").alias("context"), "line", callee.alias("expression"))
    effects = o.select("owner", F.array(F.element_at(F.split("o_orderpriority", "-"), -1), F.lit("more")).alias("deps"), F.lit("effect").alias("context"), "line")
    roots = fx.read(s, d, "nation").select(key("nation", "n_nationkey").alias("root"), F.when(F.col("n_nationkey") % 2 == 0, "status").otherwise("HIGH").alias("field"))
    return traversal.traced_field_writers(fx.g1_edges(s, d, ["has_customer", "places"]), calls, effects, roots)
