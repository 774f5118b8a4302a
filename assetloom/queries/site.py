"""Queries on routes, reference resolution, layers and merges over the site graph (G2) and the commerce graph (G1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.functions import rules
from assetloom.operators import extraction, graph, resolution, routes, traversal, versioning
from assetloom.sources import assets as src

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


P = f"p AS ({fx.PAGES_SQL})"


def site_files(s, d):
    """Route files of the site: a page for each path (some in groups), a layout for the root and each first segment, some others."""
    p = fx.pages(s, d).select("page_id", F.when(F.col("path") == "/", "").otherwise(F.col("path")).alias("tail"))
    group = F.when(F.col("page_id") % 5 == 0, "/(shop)").when(F.col("page_id") % 7 == 0, "/@side").otherwise("")
    page = p.select(F.concat(F.lit("src/app"), group, "tail", F.lit("/page.tsx")).alias("path"))
    seg = p.where("tail <> ''").select(F.split_part("tail", F.lit("/"), F.lit(2)).alias("seg")).distinct()
    out = page.unionByName(seg.select(F.concat(F.lit("src/app/"), "seg", F.lit("/layout.tsx")).alias("path")))
    out = out.unionByName(p.select(F.lit("src/app/layout.tsx").alias("path")).distinct())
    for k, name in ((11, "loading.tsx"), (13, "error.tsx"), (17, "not-found.tsx"), (19, "route.ts"), (23, "notes.md")):
        out = out.unionByName(p.where(F.col("page_id") % k == 0).select(F.concat(F.lit("src/app"), "tail", F.lit(f"/{name}")).alias("path")))
    return out.distinct()


FILES = f"""{P}, t AS (SELECT page_id, CASE WHEN path = '/' THEN '' ELSE path END AS tail FROM p), f AS (
SELECT 'src/app' || CASE WHEN page_id % 5 = 0 THEN '/(shop)' WHEN page_id % 7 = 0 THEN '/@side' ELSE '' END || tail || '/page.tsx' AS path FROM t UNION SELECT 'src/app/' || split_part(tail, '/', 2) || '/layout.tsx' FROM t WHERE tail <> ''
UNION SELECT 'src/app/layout.tsx' FROM t {"".join(f"UNION SELECT 'src/app' || tail || '/{n}' FROM t WHERE page_id % {k} = 0 " for k, n in ((11, "loading.tsx"), (13, "error.tsx"), (17, "not-found.tsx"), (19, "route.ts"), (23, "notes.md")))})"""
_ROLE = "CASE regexp_extract(path, '([^/]+)$', 1) WHEN 'page.tsx' THEN 'page' WHEN 'layout.tsx' THEN 'layout' WHEN 'loading.tsx' THEN 'loading' WHEN 'error.tsx' THEN 'error' WHEN 'not-found.tsx' THEN 'not-found' WHEN 'route.ts' THEN 'route' END"
RP = f"""rp AS (SELECT path, {_ROLE} AS role, CASE WHEN {_ROLE} IS NOT NULL THEN '/' || array_to_string(list_filter(string_split(substr(path, 9), '/')[:-2], lambda x: NOT regexp_matches(x, '^\\(.*\\)$') AND NOT starts_with(x, '@') AND NOT starts_with(x, '_')), '/') END AS route FROM f)"""
R = f"""{FILES}, {RP}, r AS (SELECT route, max(path) FILTER (WHERE role = 'page') AS page, coalesce(list(path ORDER BY path) FILTER (WHERE role = 'layout'), []) AS layouts, max(path) FILTER (WHERE role = 'loading') AS loading,
max(path) FILTER (WHERE role = 'error') AS error, max(path) FILTER (WHERE role = 'not-found') AS not_found, max(path) FILTER (WHERE role = 'route') AS handler FROM rp WHERE route IS NOT NULL GROUP BY route)"""
_PARTS = "list_filter(string_split({c}, '/'), lambda x: x <> '')"
UP = f"""up AS (SELECT route, n::INTEGER AS depth, '/' || array_to_string(({_PARTS.format(c="route")})[:n], '/') AS anc FROM (SELECT route, unnest(range(0, len({_PARTS.format(c="route")}) + 1)) AS n FROM r))"""
CHAIN = f"""{UP}, ch AS (SELECT route, layout, min(depth) AS depth FROM up JOIN (SELECT route AS anc, unnest(layouts) AS layout FROM r) USING (anc) GROUP BY ALL), chain AS (SELECT route, (row_number() OVER (PARTITION BY route ORDER BY depth, layout) - 1)::INTEGER AS ord, layout FROM ch)"""


def site_routes(s, d):
    return routes.detect_routes(site_files(s, d))


@register("route_path", f"WITH {FILES}, {RP} SELECT path, route FROM rp")
def _(s, d):
    return site_files(s, d).select("path", rules.route_path(F.col("path")).alias("route"))


@register("detect_routes", f"WITH {R} SELECT route, page, array_to_string(layouts, ',') AS layouts, loading, error, not_found, handler FROM r")
def _(s, d):
    return site_routes(s, d).select("route", "page", F.array_join("layouts", ",").alias("layouts"), "loading", "error", "not_found", "handler")


@register("load_routes", f"WITH {R} SELECT route, page, len(layouts)::INTEGER AS n_layouts, coalesce(layouts[1], '') AS first FROM r")
def _(s, d):
    stored = site_routes(s, d).select("route", "page", F.when(F.size("layouts") > 0, F.to_json("layouts")).alias("layouts_json"))
    return src.load_routes(stored).select("route", "page", F.size("layouts").alias("n_layouts"), F.coalesce(F.try_element_at("layouts", F.lit(1)), F.lit("")).alias("first"))


@register("ancestor_paths", f"WITH {R}, {UP} SELECT route AS path, anc AS ancestor, depth FROM up")
def _(s, d):
    return routes.ancestor_paths(site_routes(s, d).select(F.col("route").alias("path")))


@register("layout_chain", f"WITH {R}, {CHAIN} SELECT route, ord, layout FROM chain")
def _(s, d):
    return routes.layout_chain(site_routes(s, d))


@register("path_rollup", f"""WITH {P}, q AS (SELECT path, length(html) AS size, {_PARTS.format(c="path")} AS l FROM p), x AS (SELECT path, size, l, unnest(range(0, len(l) + 1)) AS n FROM q)
SELECT '/' || array_to_string(l[:n], '/') AS ancestor, n::INTEGER AS depth, count(*) AS assets, sum(size)::BIGINT AS size FROM x GROUP BY ALL""")
def _(s, d):
    return routes.path_rollup(fx.pages(s, d), F.char_length("html").cast("long"))


_FQ = f"q AS (SELECT page_id AS query_id, CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN substr(path, 2) WHEN 2 THEN 'src/app' || CASE WHEN path = '/' THEN '' ELSE path END || '/page.tsx' ELSE '/none/' || page_id END AS query FROM p)"


@register("find_route", f"""WITH {R}, {_FQ}, h AS (SELECT query_id, route, 1 AS tier, 'exact' AS how FROM q JOIN r ON query = route UNION ALL SELECT query_id, route, 2, 'normalized' FROM q JOIN r ON CASE WHEN starts_with(query, '/') THEN query ELSE '/' || query END = route UNION ALL SELECT query_id, route, 3, 'page' FROM q JOIN r ON query = page),
b AS (SELECT query_id, min({{'t': tier, 'r': route, 'h': how}}) AS x FROM h GROUP BY query_id) SELECT query_id, x.r AS route, x.h AS how FROM q LEFT JOIN b USING (query_id)""")
def _(s, d):
    k = F.col("page_id") % 4
    tail = F.when(F.col("path") == "/", "").otherwise(F.col("path"))
    q = F.when(k == 0, F.col("path")).when(k == 1, F.expr("substring(path, 2)")).when(k == 2, F.concat(F.lit("src/app"), tail, F.lit("/page.tsx"))).otherwise(F.concat(F.lit("/none/"), F.col("page_id").cast("string")))
    return routes.find_route(site_routes(s, d), fx.pages(s, d).select(F.col("page_id").alias("query_id"), q.alias("query")))


@register("route_chain_mode", f"WITH {R}, {CHAIN}, st AS (SELECT route, min(ord) AS o FROM chain WHERE layout = 'src/app/en/layout.tsx' GROUP BY route) SELECT chain.route, ord, layout FROM chain LEFT JOIN st ON chain.route = st.route WHERE ord >= coalesce(o, 0)")
def _(s, d):
    return routes.route_chain_mode(routes.layout_chain(site_routes(s, d)), "from", "src/app/en/layout.tsx")


_RF = "rf AS (SELECT route, role, asset FROM (UNPIVOT (SELECT route, page, loading, error, not_found, handler FROM r) ON page, loading, error, not_found, handler INTO NAME role VALUE asset) UNION ALL SELECT route, 'layout', unnest(layouts) FROM r)"


@register("routes_touching_asset", f"WITH {R}, {_RF} SELECT DISTINCT asset, route FROM rf JOIN f ON asset = path")
def _(s, d):
    return routes.routes_touching_asset(site_routes(s, d), site_files(s, d))


@register("asset_route_paths", f"WITH {R} SELECT f.path, route FROM f JOIN r ON f.path = page UNION SELECT path, route FROM rp WHERE route IS NOT NULL")
def _(s, d):
    return routes.asset_route_paths(site_files(s, d), site_routes(s, d))


_ER = f"""{CHAIN}, {_RF}, fin AS (SELECT route, arg_max(layout, ord) AS e FROM chain GROUP BY route),
er AS (SELECT coalesce(lag(layout) OVER (PARTITION BY route ORDER BY ord), 'route:' || route) AS src, layout AS dst, 'wraps' AS type, route FROM chain
UNION ALL SELECT coalesce(e, 'route:' || rf.route), asset, CASE role WHEN 'page' THEN 'routes_to' WHEN 'loading' THEN 'shows_loading' WHEN 'error' THEN 'shows_error' WHEN 'not_found' THEN 'shows_not_found' ELSE 'routes_to' END, rf.route FROM rf LEFT JOIN fin ON rf.route = fin.route WHERE role <> 'layout')"""


@register("edges_route", f"WITH {R}, {_ER} SELECT src, dst, type, route FROM er")
def _(s, d):
    return routes.edges_route(site_routes(s, d))


@register("layer_route", f"WITH {R}, {CHAIN} SELECT * FROM (SELECT route, layout AS src, lead(layout) OVER (PARTITION BY route ORDER BY ord) AS dst, 'children-slot' AS type FROM chain) WHERE dst IS NOT NULL")
def _(s, d):
    return routes.layer_route(routes.layout_chain(site_routes(s, d)))


_HREFS = "h AS (SELECT page_id, unnest(range(0, len(l)))::INTEGER AS ord, unnest(l) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages))"


@register("route_subgraph", f"""WITH RECURSIVE {R}, {_ER}, {_HREFS}, g AS (SELECT DISTINCT 'src/app' || CASE WHEN path = '/' THEN '' ELSE path END || '/page.tsx' AS src, 'src/app' || target || '/page.tsx' AS dst FROM p JOIN h USING (page_id)),
w(root, node) AS (SELECT route, dst FROM er UNION SELECT root, g.dst FROM w JOIN g ON node = g.src)
SELECT route, type, src, dst FROM er UNION SELECT root, 'renders', g.src, g.dst FROM w JOIN g ON node = g.src""")
def _(s, d):
    p = fx.pages(s, d)
    refs = extraction.extract_refs(p, 'href="([^"]*)"', "page_id", "path", content="html")
    page = lambda c: F.concat(F.lit("src/app"), F.when(F.col(c) == "/", "").otherwise(F.col(c)), F.lit("/page.tsx"))
    target = F.concat(F.lit("src/app"), "target", F.lit("/page.tsx"))
    e = refs.select(F.lit("renders").alias("type"), page("path").alias("src"), target.alias("dst")).distinct()
    return routes.route_subgraph(site_routes(s, d), e, ["renders"])


@register("composition_scope", f"""WITH RECURSIVE {R}, {_ER}, {_HREFS}, g AS (SELECT DISTINCT 'src/app' || CASE WHEN path = '/' THEN '' ELSE path END || '/page.tsx' AS src, 'src/app' || target || '/page.tsx' AS dst FROM p JOIN h USING (page_id)),
w(root, node) AS (SELECT route, dst FROM er UNION SELECT root, g.dst FROM w JOIN g ON node = g.src),
have AS (SELECT DISTINCT 'src/app' || CASE WHEN path = '/' THEN '' ELSE path END || '/page.tsx' AS node FROM p),
ask AS (SELECT DISTINCT 'src/app' || CASE WHEN path = '/' THEN '' ELSE path END || '/page.tsx' AS root FROM p WHERE page_id % {fx.EVERY} = 0 UNION SELECT 'src/app' || target || '/page.tsx' FROM p JOIN h USING (page_id) WHERE page_id % {fx.EVERY} = 0),
shows AS (SELECT ask.root, er.route FROM ask JOIN g ON g.dst = ask.root JOIN have ON have.node = g.src JOIN er ON er.dst = g.src UNION SELECT ask.root, route FROM ask JOIN er ON er.dst = ask.root WHERE type = 'routes_to'),
sc AS (SELECT shows.root, 'renders' AS type, g.src, g.dst, 1::BIGINT AS k FROM shows JOIN w ON w.root = shows.route JOIN g ON g.src = w.node UNION SELECT shows.root, type, src, dst, 0 FROM shows JOIN er USING (route) WHERE type = 'wraps'),
rest AS (SELECT root FROM ask WHERE root NOT IN (SELECT root FROM sc)),
above4(root, node, d) AS (SELECT root, root, 0 FROM rest UNION SELECT root, g.src, d + 1 FROM above4 JOIN g ON node = g.dst WHERE d < 3),
below2(root, node, d) AS (SELECT root, root, 0 FROM rest UNION SELECT root, g.dst, d + 1 FROM below2 JOIN g ON node = g.src WHERE d < 1)
SELECT * FROM sc UNION SELECT root, 'renders', g.src, g.dst, 1 FROM above4 JOIN g ON g.dst = node UNION SELECT root, 'renders', g.src, g.dst, 1 FROM below2 JOIN g ON g.src = node""")
def _(s, d):
    p = fx.pages(s, d)
    page = lambda c: F.concat(F.lit("src/app"), F.when(F.col(c) == "/", "").otherwise(F.col(c)), F.lit("/page.tsx"))
    refs = extraction.extract_refs(p, 'href="([^"]*)"', "page_id", "path", content="html")
    target = F.concat(F.lit("src/app"), "target", F.lit("/page.tsx"))
    e = refs.select("page_id", F.lit("renders").alias("type"), page("path").alias("src"), target.alias("dst"), F.lit(1).cast("long").alias("k"))
    some = F.col("page_id") % fx.EVERY == 0
    roots = p.where(some).select(page("path").alias("root")).unionByName(e.where(some).select(F.col("dst").alias("root"))).distinct()
    e = e.drop("page_id").distinct()
    nodes = p.select(page("path").alias("node"), page("path").alias("path")).distinct()
    scopes = routes.route_scopes(nodes, e, roots, site_routes(s, d), ["renders", "wraps"])
    return traversal.composition_scope(e, roots, scopes, ["renders"], ["renders"])


# Resolution: references are links of pages; assets are files named after pages.

_AS = "ar AS (SELECT DISTINCT 'src/app' || CASE WHEN path = '/' THEN '/index' ELSE path END || CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.tsx' ELSE '.jsx' END AS path FROM p)"
_RF2 = f"{P}, {_AS}, {_HREFS}, x AS (SELECT page_id * 1000 + ord AS ref_id, page_id, ord, target, p.path FROM h JOIN p USING (page_id))"
_CAND = "(VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.ts'), (6, '/index.tsx'), (7, '/index.js'), (8, '/index.jsx')) c(pos, c)"


def site_assets(s, d):
    p = fx.pages(s, d)
    end = F.when(F.col("page_id") % 3 == 0, ".ts").when(F.col("page_id") % 3 == 1, "/index.tsx").otherwise(".jsx")
    return p.select(F.concat(F.lit("src/app"), F.when(F.col("path") == "/", "/index").otherwise(F.col("path")), end).alias("path")).distinct()


def site_refs(s, d):
    """ref_id, source, target: relative, alias, package and plain forms of the links and of the pages' own paths."""
    p = fx.pages(s, d)
    r = extraction.extract_refs(p, 'href="([^"]*)"', "page_id", "path", content="html").select((F.col("page_id") * 1000 + F.col("ord")).alias("ref_id"), "page_id", "path", "target")
    own = p.select((F.col("page_id") * 1000 + 900).alias("ref_id"), "page_id", "path", F.col("path").alias("target"))
    k = F.col("page_id") % 4
    t = F.when(k == 0, F.concat(F.lit("../app"), "target")).when(k == 1, F.concat(F.lit("@/app"), "target")).when(k == 2, F.concat(F.lit("@shop/site"), "target")).otherwise(F.concat(F.lit("~"), "target"))
    return r.unionByName(own).select("ref_id", F.lit("src/lib/x.ts").alias("source"), t.alias("target"), "page_id")


ALIASES = [(0, "@/*", "src/*"), (1, "~/*", "src/app/*")]
_ALL = f"{_RF2}, y AS (SELECT ref_id, page_id, target AS t FROM x UNION ALL SELECT page_id * 1000 + 900, page_id, path FROM p), rr AS (SELECT ref_id, page_id, CASE page_id % 4 WHEN 0 THEN 'relative' WHEN 1 THEN 'alias' WHEN 2 THEN 'package' ELSE 'any-alias' END AS how, 'src/app' || CASE WHEN t = '/' THEN '' ELSE regexp_replace(t, '/+$', '') END AS base, CASE page_id % 4 WHEN 0 THEN '../app' WHEN 1 THEN '@/app' WHEN 2 THEN '@shop/site' ELSE '~' END || t AS target FROM y), hit AS (SELECT ref_id, arg_min(ar.path, pos) AS path FROM rr, {_CAND} JOIN ar ON ar.path = base || c GROUP BY ref_id)"


def _aliases(s):
    return s.createDataFrame(ALIASES, "alias_ord int, pattern string, replacement string")


def _packages(s):
    return s.createDataFrame([("@shop/site", "src/app", "index.ts", {".": "./index.ts"})], "name string, root string, main string, exports map<string,string>")


@register("resolve_relative", f"WITH {_ALL} SELECT ref_id, path FROM rr JOIN hit USING (ref_id) WHERE how = 'relative'")
def _(s, d):
    return resolution.resolve_relative(site_refs(s, d), site_assets(s, d))


@register("resolve_alias", f"WITH {_ALL} SELECT ref_id, path FROM rr JOIN hit USING (ref_id) WHERE how IN ('alias', 'any-alias')")
def _(s, d):
    return resolution.resolve_alias(site_refs(s, d), _aliases(s), site_assets(s, d))


@register("resolve_package", f"WITH {_ALL} SELECT ref_id, path FROM rr JOIN hit USING (ref_id) WHERE how = 'package'")
def _(s, d):
    return resolution.resolve_package(site_refs(s, d), _packages(s), site_assets(s, d))


def _resolved(s, d):
    return resolution.resolve_ref(site_refs(s, d), site_assets(s, d), _aliases(s), _packages(s))


@register("resolve_ref", f"WITH {_ALL} SELECT ref_id, target, path, CASE WHEN path IS NOT NULL THEN how END AS how FROM rr LEFT JOIN hit USING (ref_id)")
def _(s, d):
    return _resolved(s, d).select("ref_id", "target", "path", "how")


@register("unresolved_refs", f"WITH {_ALL} SELECT ref_id, target FROM rr WHERE (starts_with(target, '.') OR starts_with(target, '@/')) AND ref_id NOT IN (SELECT ref_id FROM hit)")
def _(s, d):
    internal = F.col("target").startswith(".") | F.col("target").startswith("@/")
    return resolution.unresolved_refs(site_refs(s, d), _resolved(s, d), internal).select("ref_id", "target")


@register("edges_imports", f"WITH {_ALL} SELECT DISTINCT 'page:' || page_id AS src, coalesce(path, target) AS dst, 'imports' AS type FROM rr LEFT JOIN hit USING (ref_id)")
def _(s, d):
    r = _resolved(s, d)
    return graph.edges_imports(r.withColumn("owner", F.concat(F.lit("page:"), F.col("page_id").cast("string"))))


@register("layer_dependency", f"""WITH {_ALL}, z AS (SELECT DISTINCT 'page:' || page_id AS owner, target, path FROM rr LEFT JOIN hit USING (ref_id))
SELECT 'file:' || p AS src, NULL AS dst, 'file' AS type FROM (SELECT owner AS p FROM z UNION SELECT path FROM z WHERE path IS NOT NULL)
UNION ALL SELECT 'module:' || target, NULL, CASE WHEN count(path) > 0 THEN 'workspace' WHEN starts_with(target, '.') OR starts_with(target, '@/') THEN 'module' ELSE 'external' END FROM z GROUP BY target
UNION ALL SELECT DISTINCT 'file:' || owner, 'module:' || target, 'imports' FROM z
UNION ALL SELECT DISTINCT 'module:' || target, 'file:' || path, 'resolved-to' FROM z WHERE path IS NOT NULL""")
def _(s, d):
    r = _resolved(s, d).withColumn("owner", F.concat(F.lit("page:"), F.col("page_id").cast("string")))
    nodes, edges = graph.layer_dependency(r)
    return nodes.select(F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), "type").unionByName(edges)


# Names: symbols are words of link texts by page; a page imports its link targets' first words from the host's other pages.

_SY = """sy AS (SELECT 'sym:' || p_partkey AS symbol, p_name AS full_name, split_part(p_name, ' ', 1) AS name, CASE p_size % 4 WHEN 0 THEN 'component' WHEN 1 THEN 'hook' WHEN 2 THEN 'service' ELSE 'function' END AS type, p_brand AS path, p_partkey AS ord FROM part)"""
_NR = "nr AS (SELECT l_orderkey * 8 + l_linenumber AS ref_id, p_brand AS source, CASE WHEN l_linenumber = 7 THEN 'Math.max' WHEN l_linenumber = 6 THEN 'axios.get' ELSE split_part(p_name, ' ', 1) || '.run' END AS callee, split_part(callee, '.', 1) AS name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey)"
_IM = "im AS (SELECT s.path AS source, (r.n * 10)::INTEGER AS import_ord, x.name, CASE WHEN r.n = 1 THEN '@lib/core' ELSE 'mod' END AS module, CASE WHEN r.n = 0 THEN s.path WHEN r.n = 1 THEN 'Brand#11' END AS path FROM (SELECT DISTINCT path FROM sy) s, (SELECT DISTINCT name FROM sy UNION SELECT 'axios') x, (SELECT unnest(range(0, 2)) AS n) r WHERE length(x.name) % 2 = r.n)"


def part_symbols(s, d):
    p = fx.read(s, d, "part")
    k = F.col("p_size") % 4
    kind = F.when(k == 0, "component").when(k == 1, "hook").when(k == 2, "service").otherwise("function")
    return p.select(F.concat(F.lit("sym:"), F.col("p_partkey").cast("string")).alias("symbol"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), kind.alias("type"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("ord"))


def name_refs(s, d):
    li = fx.read(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    li = li.join(fx.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    callee = F.when(F.col("l_linenumber") == 7, "Math.max").when(F.col("l_linenumber") == 6, "axios.get").otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".run")))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"), F.col("p_brand").alias("source"), callee.alias("callee")).withColumn("name", F.split_part("callee", F.lit("."), F.lit(1)))


def name_imports(s, d):
    sy = part_symbols(s, d)
    names = sy.select("name").distinct().unionByName(fx.read(s, d, "region").limit(1).select(F.lit("axios").alias("name")))
    n = F.char_length("name") % 2
    at = sy.select(F.col("path").alias("source")).distinct()
    return at.crossJoin(F.broadcast(names.withColumn("n", n))).select("source", (F.col("n") * 10).alias("import_ord"), "name", F.when(F.col("n") == 1, "@lib/core").otherwise("mod").alias("module"), F.when(F.col("n") == 0, F.col("source")).otherwise("Brand#11").alias("path"))


def _rank(order):
    return "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(order)) + f" ELSE {len(order)} END"


def _best(keys, order):
    return f"SELECT {keys}, min({{'r': {_rank(order)}, 'p': path, 'o': ord, 's': symbol}}).s AS symbol FROM sy GROUP BY {keys}"


_LOC = f"loc AS (SELECT ref_id, b.symbol FROM nr JOIN ({_best('path, name', resolution.LOCAL_RANKS)}) b ON nr.source = b.path AND nr.name = b.name)"


def _imp(order):
    return f"imp AS (SELECT ref_id, arg_min(b.symbol, import_ord) AS symbol FROM nr JOIN im ON nr.source = im.source AND nr.name = im.name JOIN ({_best('path, name', order)}) b ON b.path = im.path AND b.name = im.name GROUP BY ref_id)"


def _glo(order):
    return f"glo AS (SELECT ref_id, b.symbol FROM nr JOIN ({_best('name', order)}) b USING (name))"


@register("resolve_name_local", f"WITH {_SY}, {_NR}, {_LOC} SELECT ref_id, symbol FROM loc")
def _(s, d):
    return resolution.resolve_name_local(name_refs(s, d), part_symbols(s, d))


@register("resolve_name_via_imports", f"WITH {_SY}, {_NR}, {_IM}, {_imp(resolution.LOCAL_RANKS)} SELECT ref_id, symbol FROM imp")
def _(s, d):
    return resolution.resolve_name_via_imports(name_refs(s, d), name_imports(s, d), part_symbols(s, d))


@register("resolve_name_global", f"WITH {_SY}, {_NR}, {_glo(['component', 'hook'])} SELECT ref_id, symbol FROM glo")
def _(s, d):
    return resolution.resolve_name_global(name_refs(s, d), part_symbols(s, d), ["component", "hook"])


_REN = f"{_SY}, {_NR}, {_IM}, {_imp(['component', 'hook'])}, {_glo(['component', 'hook'])}, ren AS (SELECT ref_id, coalesce(imp.symbol, glo.symbol) AS symbol, CASE WHEN imp.symbol IS NULL THEN 'global' ELSE 'imports' END AS how FROM glo FULL JOIN imp USING (ref_id))"


@register("resolve_render_target", f"WITH {_REN} SELECT ref_id, symbol, how FROM ren")
def _(s, d):
    return resolution.resolve_render_target(name_refs(s, d), name_imports(s, d), part_symbols(s, d))


@register("edges_renders", f"WITH {_REN} SELECT DISTINCT nr.source AS src, symbol AS dst, 'renders' AS type FROM ren JOIN nr USING (ref_id)")
def _(s, d):
    return graph.edges_renders(name_refs(s, d).withColumn("owner", F.col("source")), name_imports(s, d), part_symbols(s, d))


@register("edges_uses", f"WITH {_REN} SELECT DISTINCT nr.source AS src, symbol AS dst, 'uses_hook' AS type FROM ren JOIN nr USING (ref_id) JOIN sy USING (symbol) WHERE sy.type = 'hook'")
def _(s, d):
    return graph.edges_uses(name_refs(s, d).withColumn("owner", F.col("source")), name_imports(s, d), part_symbols(s, d))


_CALLR = ["service", "hook", "function", "component"]
_CT = f"""{_SY}, {_NR}, {_IM}, {_LOC}, {_imp(_CALLR)}, {_glo(_CALLR)}, mo AS (SELECT source, name, arg_min(module, import_ord) AS module FROM im GROUP BY ALL),
k AS (SELECT nr.ref_id, nr.source, callee, name, coalesce(loc.symbol, imp.symbol, glo.symbol) AS symbol, module FROM nr LEFT JOIN loc USING (ref_id) LEFT JOIN imp USING (ref_id) LEFT JOIN glo USING (ref_id) LEFT JOIN mo USING (source, name)),
ct AS (SELECT ref_id, source, callee, coalesce(symbol, CASE WHEN name = 'Math' THEN 'builtin:' || callee ELSE 'external:' || coalesce(module, 'unknown') || '#' || callee END) AS dst, CASE WHEN symbol IS NOT NULL THEN 'internal' WHEN name = 'Math' THEN 'builtin' ELSE 'external' END AS kind,
CASE WHEN symbol IS NULL AND name <> 'Math' AND module IS NOT NULL THEN callee || ' (' || module || ')' ELSE callee END AS label, CASE WHEN symbol IS NULL AND name <> 'Math' THEN module END AS module FROM k)"""


@register("resolve_call_target", f"WITH {_CT} SELECT ref_id, dst, kind, label, module FROM ct")
def _(s, d):
    return resolution.resolve_call_target(name_refs(s, d), name_imports(s, d), part_symbols(s, d))


@register("edges_calls", f"WITH {_CT} SELECT source AS src, dst, ref_id % 8 AS k, min(kind) AS kind, 'calls' AS type FROM ct WHERE NOT (source = 'Brand#11' AND split_part(callee, '.', 1) = 'axios') GROUP BY ALL")
def _(s, d):
    calls = name_refs(s, d).withColumns({"owner": F.col("source"), "line": F.col("ref_id") % 8})
    hooks = fx.read(s, d, "part").where("p_brand = 'Brand#11'").select(F.col("p_brand").alias("owner"), F.lit("axios").alias("hook")).distinct()
    return graph.resolved_calls(calls, name_imports(s, d), part_symbols(s, d), hooks)


@register("first_import_for_name", f"WITH {_SY}, {_IM}, n AS (SELECT DISTINCT path AS source, name FROM sy) SELECT source, name, min(import_ord)::INTEGER AS import_ord, arg_min(module, import_ord) AS module FROM im JOIN n USING (source, name) GROUP BY ALL")
def _(s, d):
    names = part_symbols(s, d).select(F.col("path").alias("source"), "name").distinct()
    return resolution.first_import_for_name(names, name_imports(s, d))


@register("ambiguous_symbols", f"WITH {_SY} SELECT name, count(*) AS n, min({{'p': path, 'o': ord, 's': symbol}}).s AS kept FROM sy GROUP BY name HAVING count(*) > 1")
def _(s, d):
    return resolution.ambiguous_symbols(part_symbols(s, d))


@register("resolve_symbol_hint", f"""WITH {_SY}, q AS (SELECT p_partkey AS query_id, split_part(p_name, ' ', 1) AS name, CASE p_size % 4 WHEN 0 THEN 'component' WHEN 1 THEN 'hook' WHEN 2 THEN 'service' ELSE 'function' END AS type, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN substr(p_brand, 6) END AS hint FROM part),
m AS (SELECT query_id, symbol, CASE WHEN path = hint THEN 0 WHEN ends_with(path, hint) THEN 1 ELSE 2 END AS fit, path, ord FROM q JOIN sy USING (name, type) WHERE hint IS NULL OR contains(path, hint)), g AS (SELECT query_id, list(symbol ORDER BY fit, path, ord) AS l FROM m GROUP BY query_id)
SELECT query_id, l[1] AS symbol, len(l)::INTEGER AS n, array_to_string(l[2:], ',') AS others FROM g""")
def _(s, d):
    sy = part_symbols(s, d)
    q = sy.select(F.col("ord").alias("query_id"), "name", "type", F.when(F.col("ord") % 3 == 0, F.col("path")).when(F.col("ord") % 3 == 1, F.expr("substring(path, 6)")).alias("hint"))
    return resolution.resolve_symbol_hint(q, sy)


@register("load_nodes", f"""WITH {R}, {_SY} SELECT 'file:' || path AS node, 'file' AS type, path AS label, path FROM f UNION ALL SELECT symbol, type, name, path FROM sy UNION ALL SELECT 'route:' || route, 'route', route, coalesce(page, '') FROM r""")
def _(s, d):
    files = site_files(s, d)
    catalog = files.select(F.concat(F.lit("file:"), "path").alias("asset_id"), "path")
    return src.load_nodes(catalog, part_symbols(s, d), routes.detect_routes(files))


@register("export_entity_map", f"""WITH {_SY}, g AS (SELECT path, string_agg('- ' || symbol, chr(10) ORDER BY symbol) FILTER (WHERE type = 'hook') AS hooks FROM sy GROUP BY path)
SELECT name, sy.path, '## ' || name || chr(10) || chr(10) || 'File:' || chr(10) || chr(10) || '- ' || sy.path || chr(10) || CASE WHEN sy.type = 'component' AND hooks IS NOT NULL THEN chr(10) || 'Uses hooks:' || chr(10) || chr(10) || hooks || chr(10) ELSE '' END AS md FROM sy JOIN g ON sy.path = g.path""")
def _(s, d):
    sy = part_symbols(s, d)
    hooks = sy.where(F.col("type") == "hook").select("path", F.col("symbol").alias("entry"))
    return src.entity_map_of_groups(sy, hooks, "Uses hooks", F.col("type") == "component")


@register("export_route_map", f"""WITH {R} SELECT route AS path, '## ' || route || chr(10) || chr(10) || CASE WHEN page IS NOT NULL THEN '- page: ' || page || chr(10) ELSE '' END || array_to_string(list_transform(layouts, lambda x: '- layout: ' || x || chr(10)), '') || CASE WHEN loading IS NOT NULL THEN '- loading: ' || loading || chr(10) ELSE '' END || CASE WHEN error IS NOT NULL THEN '- error: ' || error || chr(10) ELSE '' END AS md FROM r""")
def _(s, d):
    return src.route_map(site_routes(s, d))


@register("export_digest", f"""WITH n AS ({fx.G1_NODES_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path, node)::INTEGER AS rank FROM n WHERE type IN ('nation', 'customer', 'part')) SELECT type, rank, label, path FROM k WHERE rank <= CASE type WHEN 'nation' THEN 10 ELSE 20 END""")
def _(s, d):
    return src.digest(fx.g1_nodes(s, d), {"nation": 10, "customer": 20, "part": 20}, ["path", "node"])


@register("merge_expansion", f"""WITH e AS (SELECT * FROM ({fx.G1_SQL}) WHERE type IN ('contains', 'has_customer')), m AS (SELECT * FROM ({fx.G1_SQL}) WHERE type IN ('places') UNION ALL SELECT 'has_root', 'top', 'customer:' || c_custkey, c_custkey FROM customer),
q AS (SELECT type, CASE WHEN src = 'top' THEN 'nation:1' ELSE 'exp:nation:1:' || src END AS src, 'exp:nation:1:' || dst AS dst, k FROM m) SELECT type, src, dst, k FROM e UNION ALL SELECT * FROM q""")
def _(s, d):
    n = fx.g1_nodes(s, d)
    tops = fx.read(s, d, "customer").select(F.lit("has_root").alias("type"), F.lit("top").alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("dst"), F.col("c_custkey").alias("k"))
    more = fx.g1_edges(s, d, ["places"]).unionByName(tops)
    return versioning.merge_expansion(n, fx.g1_edges(s, d, ["contains", "has_customer"]), n, more, "top", "nation:1")[1]


@register("collapse_expansion", f"SELECT * FROM ({fx.G1_SQL}) WHERE type IN ('contains', 'has_customer')")
def _(s, d):
    n = fx.g1_nodes(s, d)
    e = fx.g1_edges(s, d, ["contains", "has_customer"])
    nodes, edges = versioning.merge_expansion(n, e, n, fx.g1_edges(s, d, ["places"]), "top", "nation:1")
    return versioning.collapse_expansion(nodes, edges, "nation:1")[1]


@register("preview_nodes", f"""WITH RECURSIVE e AS ({fx.G1_SQL}), w(node) AS (SELECT 'nation:1' UNION SELECT dst FROM w JOIN e ON node = src WHERE NOT starts_with(dst, 'part:')) SELECT node FROM w WHERE node <> 'nation:1'""")
def _(s, d):
    return versioning.preview_nodes(fx.g1_nodes(s, d), fx.g1_edges(s, d), "nation:1", F.col("type") != "part")


@register("merge_chain", f"""WITH e AS (SELECT 'r' || n_regionkey AS chain, n_nationkey AS pos, 'has_customer' AS type, 'nation:' || n_nationkey AS src, 'customer:' || c_custkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT 'r' || n_regionkey AS chain, n_nationkey AS pos, 'nation:' || n_nationkey AS root, CASE WHEN n_nationkey % 2 = 0 THEN 'slot:' || n_nationkey END AS slot FROM nation)
SELECT chain, pos, type, 'p' || pos || ':' || src AS src, 'p' || pos || ':' || dst AS dst FROM e UNION ALL SELECT * FROM (SELECT chain, pos, 'children-slot' AS type, lag('p' || pos || ':' || coalesce(slot, root)) OVER (PARTITION BY chain ORDER BY pos) AS src, 'p' || pos || ':' || root AS dst FROM r) WHERE src IS NOT NULL""")
def _(s, d):
    na, c = fx.read(s, d, "nation"), fx.read(s, d, "customer")
    chain, pos = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("chain"), F.col("n_nationkey").alias("pos")
    nation = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    e = c.join(na, F.col("c_nationkey") == F.col("n_nationkey")).select(chain, pos, F.lit("has_customer").alias("type"), nation.alias("src"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("dst"))
    roots = na.select(chain, pos, nation.alias("root"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("slot:"), F.col("n_nationkey").cast("string"))).alias("slot"))
    nodes = na.select(chain, pos, nation.alias("node"))
    return versioning.merge_chain(nodes, e, roots)[1]


@register("anchor_of", """WITH n AS (SELECT 'nation:' || n_nationkey AS node FROM nation UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'exp:nation:' || c_nationkey || ':customer:' || c_custkey FROM customer UNION ALL SELECT 'exp:customer:' || o_custkey || ':order:' || o_orderkey FROM orders),
p AS (SELECT node, string_split(substr(node, 5), ':') AS l FROM n WHERE starts_with(node, 'exp:')), c AS (SELECT node, array_to_string(l[:k], ':') AS node_at FROM (SELECT node, l, unnest(range(1, len(l) + 1)) AS k FROM p))
SELECT c.node, arg_max(n.node, length(n.node)) AS anchor FROM c JOIN n ON node_at = n.node GROUP BY c.node""")
def _(s, d):
    t = lambda c: F.col(c).cast("string")
    na, c, o = fx.read(s, d, "nation"), fx.read(s, d, "customer"), fx.read(s, d, "orders")
    n = na.select(F.concat(F.lit("nation:"), t("n_nationkey")).alias("node")).unionByName(c.select(F.concat(F.lit("customer:"), t("c_custkey")).alias("node")))
    n = n.unionByName(c.select(F.concat(F.lit("exp:nation:"), t("c_nationkey"), F.lit(":customer:"), t("c_custkey")).alias("node"))).unionByName(o.select(F.concat(F.lit("exp:customer:"), t("o_custkey"), F.lit(":order:"), t("o_orderkey")).alias("node")))
    return versioning.anchor_of(n)


@register("edges_passes", """WITH x AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][^<>]*)>', 1) AS l FROM pages), y AS (SELECT page_id, unnest(range(0, len(l)))::INTEGER AS k, unnest(l) AS e FROM x),
z AS (SELECT page_id, k, lower(regexp_extract(e, '^([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, regexp_extract_all(regexp_replace(e, '^[a-zA-Z][a-zA-Z0-9-]*', ''), '([a-zA-Z][a-zA-Z0-9-]*(?:="[^"]*")?)', 1) AS ats FROM y)
SELECT 'page:' || page_id AS src, 'tag:' || tag AS dst, 'passes_prop' AS type, k, array_to_string(list_transform(ats, lambda v: split_part(v, '=', 1) || '=' || CASE WHEN contains(v, '=') THEN substr(regexp_replace(v, '^[^=]*="|"$', '', 'g'), 1, 100) ELSE 'true' END), ', ') AS summary FROM z WHERE len(ats) > 0""")
def _(s, d):
    e = extraction.element_attributes(fx.read(s, d, "pages"), "page_id", content="html")
    page = F.concat(F.lit("page:"), F.col("page_id").cast("string"))
    passes = e.select(F.struct("page_id", "ord").alias("ref_id"), page.alias("owner"), page.alias("source"), F.col("tag").alias("name"), "ord", "names", "values")
    tags = e.select("tag").distinct().select(F.concat(F.lit("tag:"), "tag").alias("symbol"), F.col("tag").alias("name"), F.lit("component").alias("type"), F.lit("tags").alias("path"), F.lit(0).alias("ord"))
    imports = s.createDataFrame([], "source string, import_ord int, name string, module string, path string")
    return graph.edges_passes(passes, imports, tags)


@register("edges_dynamic", f"WITH {_SY}, fs AS (SELECT path, min({{'o': ord, 's': symbol}}).s AS s FROM sy WHERE type = 'component' GROUP BY path) SELECT 'order:' || l_orderkey AS src, coalesce(s, p_brand) AS dst, 'dynamic_imports' AS type, l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN fs ON path = p_brand WHERE l_returnflag = 'R'")
def _(s, d):
    li = fx.read(s, d, "lineitem").where("l_returnflag = 'R'").join(fx.read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    refs = li.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("owner"), F.col("p_brand").alias("asset"), F.col("l_linenumber").alias("line"))
    return graph.edges_dynamic(refs, part_symbols(s, d).withColumn("asset", F.col("path")))


@register("node_role", f"WITH n AS ({fx.G1_NODES_SQL}), k AS (SELECT node, CASE type WHEN 'region' THEN 'data-fetch' WHEN 'nation' THEN 'store' WHEN 'customer' THEN 'hook' WHEN 'order' THEN 'condition' WHEN 'part' THEN 'component' ELSE 'loop' END AS kind FROM n) SELECT node, CASE kind WHEN 'data-fetch' THEN 'data-source' WHEN 'store' THEN 'data-source' WHEN 'hook' THEN 'hook-logic' WHEN 'condition' THEN 'visibility-condition' WHEN 'loop' THEN 'loop-logic' ELSE 'ui-output' END AS role FROM k")
def _(s, d):
    return fx.g1_nodes(s, d).select("node", rules.node_role(_kind()).alias("role"))


def _kind():
    t = F.col("type")
    return F.when(t == "region", "data-fetch").when(t == "nation", "store").when(t == "customer", "hook").when(t == "order", "condition").when(t == "part", "component").otherwise("loop")


@register("data_source_kind", f"WITH n AS ({fx.G1_NODES_SQL}) SELECT node, CASE WHEN label LIKE '%1' THEN 'api' WHEN type = 'region' THEN CASE WHEN label LIKE 'A%' THEN 'function' ELSE 'api' END WHEN type = 'nation' THEN 'store' WHEN type = 'customer' THEN 'hook' END AS kind FROM n")
def _(s, d):
    meta = F.when(F.col("label").endswith("1"), "api").otherwise("odd")
    fetch = F.when(F.col("label").startswith("A"), "function").otherwise("url")
    return fx.g1_nodes(s, d).select("node", rules.data_source_kind(_kind(), meta, fetch).alias("kind"))
