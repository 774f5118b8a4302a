"""Queries that write: exports, replaced edges and streams, each read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.operators import graph, incremental, resolution
from assetloom.plans.durable import shared_dir
from assetloom.queries import site
from assetloom.sources import assets as src
from assetloom.streaming.index import current_snapshot, stream_index, stream_steps

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def folder(s) -> str:
    return f"{shared_dir(s).rstrip('/')}/assetloom-{uuid.uuid4().hex}"


@register("export_graph_json", f"SELECT type, src, dst, k FROM ({fx.G1_SQL})")
def _(s, d):
    path = folder(s)
    src.export_graph_json(fx.g1_nodes(s, d), fx.g1_edges(s, d), path)
    return s.read.schema("type string, src string, dst string, k long").json(f"{path}/edges").select("type", "src", "dst", "k")


@register("export_routes_json", f"WITH {site.R} SELECT route, page, array_to_string(layouts, ',') AS layouts FROM r")
def _(s, d):
    path = folder(s)
    src.export_json(site.site_routes(s, d), path)
    return s.read.schema("route string, page string, layouts array<string>").json(path).select("route", "page", F.array_join("layouts", ",").alias("layouts"))


@register("export_symbols_json", f"""WITH {site._SY}, x AS (SELECT sy.*, p_size, p_brand, p_type FROM sy JOIN part ON ord = p_partkey)
SELECT symbol AS id, name, type, path AS file, p_size AS "startLine", p_size + 10 AS "endLine", p_brand AS props, replace(p_type, ' ', ',') AS renders, CASE WHEN type = 'component' THEN 'use' || name END AS "usesHooks" FROM x""")
def _(s, d):
    path = folder(s)
    p = fx.read(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), F.array("p_brand").alias("props"), F.split("p_type", " ").alias("renders"))
    hooks = F.when(F.col("type") == "component", F.array(F.concat(F.lit("use"), "name")))
    src.export_symbols_json(site.part_symbols(s, d).join(p, "ord").withColumn("hooks", hooks), path)
    kinds = fx.read(s, d, "part").schema["p_size"].dataType.simpleString()
    back = s.read.schema(f"id string, name string, type string, file string, startLine {kinds}, endLine {kinds}, props array<string>, renders array<string>, usesHooks array<string>").json(path)
    return back.select("id", "name", "type", "file", "startLine", "endLine", *(F.when(F.col(c).isNotNull(), F.array_join(c, ",")).alias(c) for c in ("props", "renders", "usesHooks")))


@register("save_trace_results", rf"""WITH {site.P} SELECT page_id, regexp_replace(regexp_replace(host || '//' || split_part(path, '/', 2), '[/\\]+', '_', 'g'), '[^A-Za-z0-9_.-]+', '-', 'g') AS slug FROM p""")
def _(s, d):
    path = folder(s)
    found = fx.pages(s, d).select("page_id", F.concat("host", F.lit("//"), F.split_part("path", F.lit("/"), F.lit(2))).alias("query"))
    src.save_trace_results(found, path)
    return s.read.schema("page_id long, slug string").parquet(path).select("page_id", "slug")


@register("replace_edges", f"SELECT type, src, dst, k FROM ({fx.G1_SQL}) WHERE type IN ('places', 'contains')")
def _(s, d):
    path = folder(s)
    incremental.replace_edges(fx.g1_edges(s, d, ["contains", "has_customer"]), path)
    incremental.replace_edges(fx.g1_edges(s, d, ["contains", "places"]), path)
    return s.read.parquet(path).select("type", "src", "dst", "k")


@register("resolve_flow_target", f"WITH {site._CT} SELECT ref_id AS tree_id, dst, kind FROM ct")
def _(s, d):
    r = site.name_refs(s, d)
    top = r.select(F.col("ref_id").alias("tree_id"), F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ord"), F.lit("await").alias("kind"), F.lit("x").alias("name"))
    call = r.select(F.col("ref_id").alias("tree_id"), F.lit(1).alias("node_id"), F.lit(0).alias("parent_id"), F.lit(0).alias("ord"), F.when(F.col("ref_id") % 2 == 0, "call").otherwise("identifier").alias("kind"), F.col("callee").alias("name"))
    only = call.where("kind = 'identifier'").withColumn("parent_id", F.lit(None).cast("int"))
    tree = top.where("tree_id % 2 = 0").unionByName(call.where("kind = 'call'")).unionByName(only)
    return resolution.resolve_flow_target(tree, r.select(F.col("ref_id").alias("tree_id"), "source"), site.name_imports(s, d), site.part_symbols(s, d)).select("tree_id", "dst", "kind")


@register("stream_index", f"SELECT path, sha256(content) AS hash, len(string_split(content, chr(10)))::INTEGER AS n_lines FROM ({fx.CORPUS_SQL})")
def _(s, d):
    path = folder(s)
    c = fx.corpus(s, d)
    old = c.where("doc_id % 3 = 0").select("path", F.concat(F.lit("old\n"), "content").alias("content"), F.lit(1).cast("long").alias("version"))
    for part in (old, c.select("path", "content", F.lit(2).cast("long").alias("version"))):
        part.write.mode("append").json(f"{path}/in")
        stream_index(s, f"{path}/in", f"{path}/snapshot", f"{path}/state").awaitTermination()
    return current_snapshot(s, f"{path}/snapshot").select("path", "hash", "n_lines")


@register("stream_steps", f"""WITH f AS (SELECT owner, kind, ts, ord FROM ({fx.STEPS_SQL}) WHERE kind <> 'error' QUALIFY row_number() OVER (PARTITION BY owner, kind ORDER BY ts, ord) = 1)
SELECT owner, kind, ord, (row_number() OVER (PARTITION BY owner ORDER BY ts, ord))::INTEGER AS rank FROM f""")
def _(s, d):
    """The steps as they are stored, and then a row without owner, far later, that moves the watermark past all owners."""
    path = folder(s)
    steps = fx.steps(s, d).select("owner", "ts", "ord", "kind")
    steps.write.json(f"{path}/in")
    stream_steps(s, f"{path}/in", f"{path}/out", f"{path}/state", delay="1 day", idle_hours=24 * 365, drop_kinds=("error",)).awaitTermination()
    end = steps.agg((F.max("ts") + F.expr("interval 800 days")).alias("ts")).select(F.lit(None).cast("long").alias("owner"), "ts", F.lit(0).cast("long").alias("ord"), F.lit("end").alias("kind"))
    end.write.mode("append").json(f"{path}/in")
    stream_steps(s, f"{path}/in", f"{path}/out", f"{path}/state", delay="1 day", idle_hours=24 * 365, drop_kinds=("error",)).awaitTermination()
    return s.read.parquet(f"{path}/out").select("owner", "kind", "ord", "rank")


@register("scan_assets", "SELECT n_nationkey AS key, 'ts' AS language, sha256(n_name || chr(10) || n_regionkey || chr(10)) AS hash FROM nation WHERE n_nationkey % 2 = 0")
def _(s, d):
    """Nations written as text files, a folder each, and scanned again; the odd ones lie in a folder that is ignored. Other endings than js and jsx count as ts."""
    path = folder(s)
    n = fx.read(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "src").otherwise("dist").alias("top"), F.col("n_nationkey").alias("key"), F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    n.write.partitionBy("top", "key").text(path)
    found = src.scan_assets(s, [path], exts=("txt",), ignore=("top=dist",))
    return found.select(F.regexp_extract("path", r"key=(\d+)/", 1).cast("int").alias("key"), "language", "hash")


@register("resolved_value_sources", f"WITH {site._CT} SELECT dst AS src, 'c:' || ref_id AS dst, 'prop_source' AS type, 'p' AS prop, 'v' || ref_id AS value, (ref_id % 100)::BIGINT AS k, 'o' AS owner FROM ct WHERE dst IS NOT NULL")
def _(s, d):
    """Value sources whose targets are looked up in their expressions: an awaited call."""
    r = site.name_refs(s, d)
    node = lambda number, parent, kind, name: r.select(F.col("ref_id").alias("tree_id"), F.lit(number).alias("node_id"), F.lit(parent).cast("int").alias("parent_id"), F.lit(0).alias("ord"), kind.alias("kind"), name.alias("name"))
    tree = node(0, None, F.lit("await"), F.lit("x")).unionByName(node(1, 0, F.lit("call"), F.col("callee")))
    flows = r.select(F.col("ref_id").alias("flow_id"), F.concat(F.lit("c:"), F.col("ref_id").cast("string")).alias("child"), F.lit("p").alias("prop"), F.concat(F.lit("v"), F.col("ref_id").cast("string")).alias("value"), (F.col("ref_id") % 100).cast("long").alias("line"), F.lit("o").alias("owner"), "source")
    return graph.resolved_value_sources(flows, tree, site.name_imports(s, d), site.part_symbols(s, d))
