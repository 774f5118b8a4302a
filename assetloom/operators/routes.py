"""Path hierarchies and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions import rules
from assetloom.plans.ranked import first_by


def ancestors(path: Column) -> Column:
    """Paths from the root to a path itself: ``/a/b`` gives ``/``, ``/a``, ``/a/b``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def ancestor_paths(routes: DataFrame, path: str = "path") -> DataFrame:
    """(path, ancestor, depth)."""
    return routes.select(path, F.posexplode(ancestors(F.col(path))).alias("depth", "ancestor"))


def detect_routes(assets: DataFrame) -> DataFrame:
    """One row for each route of route files (path): route, page, layouts, loading, error, not_found, template, handler; the last file of a role counts."""
    f = assets.select("path", rules.route_path(F.col("path")).alias("route"), rules.route_role(F.col("path")).alias("role")).where("route is not null")
    last = lambda role, name: F.max(F.when(F.col("role") == role, F.col("path"))).alias(name)
    layouts = F.sort_array(F.collect_list(F.when(F.col("role") == "layout", F.col("path")))).alias("layouts")
    return f.groupBy("route").agg(last("page", "page"), layouts, last("loading", "loading"), last("error", "error"), last("not-found", "not_found"), last("template", "template"), last("route", "handler"))


def layout_chain(routes: DataFrame) -> DataFrame:
    """(route, ord, layout): layouts of all ancestors, root first, sorted on a level, each once."""
    up = routes.select("route", F.posexplode(ancestors(F.col("route"))).alias("depth", "at"))
    own = routes.select(F.col("route").alias("at"), F.explode("layouts").alias("layout"))
    first = up.join(own, "at").groupBy("route", "layout").agg(F.min("depth").alias("depth"))
    return first.select("route", (F.row_number().over(Window.partitionBy("route").orderBy("depth", "layout")) - 1).alias("ord"), "layout")


def path_rollup(assets: DataFrame, size: Column) -> DataFrame:
    """(ancestor, depth, assets, size): totals of every path with all below it."""
    a = assets.select(F.posexplode(ancestors(F.col("path"))).alias("depth", "ancestor"), size.alias("size"))
    return a.groupBy("ancestor", "depth").agg(F.count(F.lit(1)).alias("assets"), F.sum("size").alias("size"))


def find_route(routes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, route, how): by path, by path with a slash in front, or by page file, in this order."""
    by_route = routes.select(F.col("route").alias("key"), "route")
    by_page = routes.select(F.col("page").alias("key"), "route")
    q = queries.select("query_id", "query")
    slash = F.when(F.col("query").startswith("/"), F.col("query")).otherwise(F.concat(F.lit("/"), "query"))
    tiers = [(q.join(by_route, F.col("query") == F.col("key")), 1, "exact"), (q.join(by_route, slash == F.col("key")), 2, "normalized"), (q.join(by_page, F.col("query") == F.col("key")), 3, "page")]
    hits = None
    for df, n, how in tiers:
        h = df.select("query_id", "route", F.lit(n).alias("tier"), F.lit(how).alias("how"))
        hits = h if hits is None else hits.unionByName(h)
    best = hits.groupBy("query_id").agg(F.min(F.struct("tier", "route", "how")).alias("x"))
    return q.join(best, "query_id", "left").select("query_id", "x.route", "x.how")


def route_chain_mode(chain: DataFrame, mode: str, start: str | None = None) -> DataFrame:
    """A chain (route, ord, layout) in full, without layouts (page), or from a layout on; from the root if it isn't in the chain."""
    if mode == "full":
        return chain
    if mode == "page":
        return chain.where("false")
    at = chain.where(F.col("layout") == start).groupBy("route").agg(F.min("ord").alias("from"))
    return chain.join(at, "route", "left").where(F.col("ord") >= F.coalesce("from", F.lit(0))).drop("from")


def route_files(routes: DataFrame) -> DataFrame:
    """(route, role, asset): the files of routes in long form."""
    one = [F.struct(F.lit(r).alias("role"), F.col(r).alias("asset")) for r in ("page", "loading", "error", "not_found", "handler") if r in routes.columns]
    single = routes.select("route", F.explode(F.array(*one)).alias("x")).select("route", "x.role", "x.asset")
    many = routes.select("route", F.lit("layout").alias("role"), F.explode("layouts").alias("asset"))
    return single.unionByName(many).where("asset is not null")


def routes_touching_asset(routes: DataFrame, assets: DataFrame) -> DataFrame:
    return route_files(routes).join(assets.select(F.col("path").alias("asset")).distinct(), "asset").select("asset", "route").distinct()


def asset_route_paths(assets: DataFrame, routes: DataFrame) -> DataFrame:
    """(path, route): routes that have the asset as their page, and the route of the path itself."""
    direct = assets.select("path").join(routes.select(F.col("page").alias("path"), "route"), "path")
    own = assets.select("path", rules.route_path(F.col("path")).alias("route")).where("route is not null")
    return direct.select("path", "route").unionByName(own).distinct()


def scope_filter(df: DataFrame, scope: str, column: str = "scope") -> DataFrame:
    return df.where(F.col(column) == scope)


def edges_route(routes: DataFrame) -> DataFrame:
    """Edges of routes: route to first layout, layout to layout (wraps), and from the last layout to the route's files."""
    chain = layout_chain(routes)
    w = Window.partitionBy("route").orderBy("ord")
    wraps = chain.select(F.coalesce(F.lag("layout").over(w), F.concat(F.lit("route:"), "route")).alias("src"), F.col("layout").alias("dst"), F.lit("wraps").alias("type"), "route")
    end = chain.groupBy("route").agg(F.max_by("layout", "ord").alias("end"))
    files = route_files(routes).where("role <> 'layout'").join(end, "route", "left")
    kind = F.create_map(*(F.lit(x) for x in ("page", "routes_to", "loading", "shows_loading", "error", "shows_error", "not_found", "shows_not_found", "handler", "routes_to")))
    ends = files.select(F.coalesce("end", F.concat(F.lit("route:"), "route")).alias("src"), F.col("asset").alias("dst"), F.element_at(kind, F.col("role")).alias("type"), "route")
    return wraps.unionByName(ends)


def layer_route(chain: DataFrame) -> DataFrame:
    """Consecutive entries of a chain joined by ``children-slot``."""
    w = Window.partitionBy("route").orderBy("ord")
    return chain.select("route", F.col("layout").alias("src"), F.lead("layout").over(w).alias("dst"), F.lit("children-slot").alias("type")).where("dst is not null")


def route_subgraph(routes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """(route, type, src, dst): a route's own edges and all that is reached from its files over the types."""
    from assetloom.plans.durable import saved
    from assetloom.plans.frontier import adjacency, walk

    own = saved(edges_route(routes))
    starts = own.select(F.col("route").alias("root"), F.col("dst").alias("node")).distinct()
    below = walk(adjacency(edges, "out", types), starts)
    reached = edges.where(F.col("type").isin(types)).join(below, F.col("src") == F.col("node")).select(F.col("root").alias("route"), "type", "src", "dst")
    return own.select("route", "type", "src", "dst").unionByName(reached).distinct()


def first_route(routes: DataFrame, key: str, order: list[str]) -> DataFrame:
    return first_by(routes, [key], order)


def route_scopes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, routes: DataFrame, types: list[str], given: tuple[str, ...] = ("renders", "passes_prop")) -> DataFrame:
    """(root, type, src, dst, k): the edges of the types in the subgraphs of all routes that show a root.

    A route shows a root if one of its files is the root's, or holds a node that renders the root or passes properties to it. What the routes reach is
    propagated once, as sets of bits; an edge is in a root's scope where the set of its source and that of the root's routes have a bit in common."""
    from assetloom.plans.durable import saved
    from assetloom.plans.reach import members_of, reach

    own = saved(edges_route(routes))
    e = saved(edges.where(F.col("type").isin(types)).select("type", "src", "dst", "k"))
    sets, numbers = reach(e, own.select(F.col("route").alias("member"), F.col("dst").alias("node")))
    paths = nodes.select(F.col("node").alias("consumer"), F.col("path").alias("consumer_path"))
    consumers = roots.join(edges.where(F.col("type").isin(*given)), F.col("root") == F.col("dst")).select("root", F.col("src").alias("consumer")).join(paths, "consumer")
    shown = consumers.join(own.select("route", F.col("dst").alias("file")), F.col("consumer_path") == F.col("file")).select("root", "route")
    pages = roots.join(own.where("type = 'routes_to'"), F.col("root") == F.col("dst")).select("root", "route")
    by = shown.unionByName(pages).distinct().join(numbers, F.col("route") == F.col("member"))
    by = saved(by.groupBy("root", F.col("word").alias("r_word")).agg(F.expr("bit_or(bit)").alias("r_bits")))
    there = e.join(sets, F.col("src") == F.col("node")).select("type", "src", "dst", "k", "word", "bits")
    scope = by.join(there, (F.col("r_word") == F.col("word")) & (F.col("r_bits").bitwiseAND(F.col("bits")) != 0)).select("root", "type", "src", "dst", "k")
    wrapping = own.where(F.col("type").isin(types)).select(F.col("route").alias("member"), "type", "src", "dst", F.lit(0).cast("long").alias("k"))
    around = members_of(by.select("root", F.col("r_word").alias("word"), F.col("r_bits").alias("bits")), numbers, "root").join(wrapping, "member").select("root", "type", "src", "dst", "k")
    return scope.unionByName(around).distinct()
