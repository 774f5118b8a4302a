"""Queries on catalogs: the corpus (G4), the site graph (G2), steps (G3) and questions (G6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom import fixtures as fx
from assetloom.functions import rules
from assetloom.operators import extraction, incremental, search
from assetloom.plans.ranked import first_by
from assetloom.sources import assets as src

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


C = f"c AS ({fx.CORPUS_SQL})"
S = f"s AS ({fx.SNAPSHOT_SQL})"
P = f"p AS ({fx.PAGES_SQL})"


def site(s, d):
    """Pages as assets: path (host and path), html."""
    return fx.pages(s, d).withColumn("asset", F.concat("host", "path"))


SITE = "a AS (SELECT *, host || path AS asset FROM p)"


@register("scan_table_assets", f"WITH {C} SELECT 'file:' || path AS asset_id, path, 'ts' AS language, hash, source FROM c")
def _(s, d):
    c = fx.corpus(s, d)
    return src.assets(c, F.col("path"), F.col("content"), "source").drop("content")


@register("asset_language", r"SELECT page_id, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'js' THEN 'js' WHEN 'jsx' THEN 'jsx' WHEN 'tsx' THEN 'tsx' ELSE 'ts' END AS language FROM pages")
def _(s, d):
    return fx.read(s, d, "pages").select("page_id", rules.asset_language(F.col("url")).alias("language"))


@register("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(s, d):
    return fx.read(s, d, "documents").select("doc_id", rules.content_hash(F.col("text")).alias("hash"))


_MARKS = {"licensed": ["License", "license"], "mail": ["@"]}
_FLAGS = "SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, contains(text, 'License') OR contains(text, 'license') AS licensed, contains(text, '@') AS mail FROM documents"


def _flagged(s, d):
    c = fx.corpus(s, d)
    return c.select("doc_id", "path", *(v.alias(k) for k, v in rules.asset_flags(F.col("content"), _MARKS).items()))


@register("asset_flags", _FLAGS)
def _(s, d):
    return _flagged(s, d)


@register("asset_flag_lookup", f"WITH f AS ({_FLAGS}) SELECT * FROM f WHERE path IN (SELECT source || '/' || lang || '/' || doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def _(s, d):
    bad = fx.corpus(s, d).join(fx.read(s, d, "labels").where("quality = 0"), "doc_id")
    return src.asset_flag_lookup(_flagged(s, d), bad.select("path"))


@register("change_plan", f"WITH {C}, {S} SELECT c.path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.hash = s.hash THEN 'unchanged' ELSE 'changed' END AS status FROM c LEFT JOIN s ON c.path = s.path")
def _(s, d):
    return incremental.change_plan(fx.snapshot(s, d), fx.corpus(s, d))


@register("stale_assets", f"WITH {C}, {S} SELECT doc_id, path, hash FROM s WHERE path NOT IN (SELECT path FROM c)")
def _(s, d):
    return incremental.stale_assets(fx.snapshot(s, d), fx.corpus(s, d)).select("doc_id", "path", "hash")


@register("reuse_or_extract", f"""WITH {C}, {S}, p AS (SELECT c.path, c.content, s.path IS NOT NULL AND c.hash = s.hash AS same FROM c LEFT JOIN s ON c.path = s.path)
SELECT path, CASE WHEN same THEN 0 ELSE len(string_split(content, chr(10))) END::INTEGER AS n_lines, same AS reused FROM p""")
def _(s, d):
    current, snap = fx.corpus(s, d), fx.snapshot(s, d)
    cached = snap.select("path", F.lit(0).alias("n_lines"), F.lit(True).alias("reused"))
    lines = lambda a: a.select("path", F.size(F.split("content", "\n")).alias("n_lines"), F.lit(False).alias("reused"))
    return incremental.reuse_or_extract(incremental.change_plan(snap, current), cached, current, lines)


@register("upsert_assets", f"WITH {C}, {S} SELECT path, hash FROM s WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, hash FROM c")
def _(s, d):
    return incremental.upsert_assets(fx.snapshot(s, d).select("path", "hash"), fx.corpus(s, d).select("path", "hash"))


@register("index_summary", f"""WITH {C}, {S}, p AS (SELECT s.path IS NOT NULL AND c.hash = s.hash AS same FROM c LEFT JOIN s ON c.path = s.path), e AS ({fx.G1_SQL})
SELECT count(*) AS assets, count(*) FILTER (WHERE same) AS reused, count(*) FILTER (WHERE NOT same) AS parsed, (SELECT count(*) FROM s WHERE path NOT IN (SELECT path FROM c)) AS stale, (SELECT count(*) FROM e) AS edges FROM p""")
def _(s, d):
    snap, current = fx.snapshot(s, d), fx.corpus(s, d)
    return incremental.index_summary(incremental.change_plan(snap, current), stale=incremental.stale_assets(snap, current), edges=fx.g1_edges(s, d))


@register("duplicate_content", f"WITH {C} SELECT hash, count(*) AS n, min(path) AS first_path FROM c GROUP BY hash HAVING count(*) > 1")
def _(s, d):
    return incremental.duplicate_content(fx.corpus(s, d))


@register("scope_filter", f"WITH {C} SELECT path, hash FROM c WHERE source = 'src0'")
def _(s, d):
    from assetloom.operators import routes

    return routes.scope_filter(fx.corpus(s, d), "src0", "source").select("path", "hash")


_HREF = 'href="([^"]*)"'


@register("extract_refs", f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS l FROM pages), y AS (SELECT page_id, unnest(range(0, len(l))) AS ord, unnest(l) AS target FROM x)
SELECT page_id, ord::INTEGER AS ord, target FROM y WHERE target <> ''""")
def _(s, d):
    return extraction.extract_refs(fx.read(s, d, "pages"), _HREF, "page_id", content="html")


_RULES = {"title": "<title>([^<]*)</title>", "heading": "<h1>([^<]*)</h1>"}
_SYMS = """x AS (SELECT page_id, 'title' AS type, 0 AS rule, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS l FROM pages UNION ALL SELECT page_id, 'heading', 1, regexp_extract_all(html, '<h1>([^<]*)</h1>', 1) FROM pages),
y AS (SELECT page_id, type, rule, unnest(range(0, len(l)))::INTEGER AS ord, unnest(l) AS body FROM x),
z AS (SELECT *, substr(trim(regexp_replace(body, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), 1, 120) AS name FROM y),
sy AS (SELECT page_id, type, name, ord, sha256(body) AS hash FROM z WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY rule, ord) = 1)"""


def page_symbols(s, d):
    return extraction.extract_symbols(fx.read(s, d, "pages"), _RULES, "page_id", content="html")


_LINED = r"""pc AS (SELECT page_id, type, string_split(regexp_replace(html, pat, chr(1) || '\0', 'g'), chr(1)) AS l, pat FROM pages, (VALUES ('title', '<title>[^<]*</title>'), ('heading', '<h1>[^<]*</h1>')) t(type, pat)),
pn AS (SELECT page_id, type, pat, unnest(l) AS piece, unnest(range(0, len(l))) AS pos FROM pc),
br AS (SELECT page_id, type, pos - 1 AS ord, regexp_extract(piece, '^' || pat) AS whole, sum(length(piece) - length(replace(piece, chr(10), ''))) OVER (PARTITION BY page_id, type ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS line FROM pn),
li AS (SELECT page_id, type, ord, line::INTEGER AS start_line, (line + length(whole) - length(replace(whole, chr(10), '')))::INTEGER AS end_line, substr(split_part(regexp_extract(whole, '>([^<]*)<', 1), chr(10), 1), 1, 120) AS signature FROM br WHERE ord >= 0)"""


@register("extract_symbols", f"WITH {_SYMS}, {_LINED} SELECT page_id, type, name, ord, start_line, end_line, signature, hash FROM sy JOIN li USING (page_id, type, ord)")
def _(s, d):
    return page_symbols(s, d)


@register("load_symbols", f"""WITH {P}, {SITE}, {_SYMS} SELECT 'file:' || asset AS asset_id, asset AS path, sy.type, sy.name, sy.ord::VARCHAR AS meta_ord FROM sy JOIN a ON sy.page_id = a.page_id""")
def _(s, d):
    a = site(s, d)
    sym = page_symbols(s, d).join(a.select("page_id", F.concat(F.lit("file:"), "asset").alias("asset_id")), "page_id").select("page_id", "asset_id", "type", "name", F.to_json(F.struct(F.col("ord").cast("string").alias("ord"))).alias("metadata"))
    catalog = a.select(F.concat(F.lit("file:"), "asset").alias("asset_id"), F.col("asset").alias("path")).distinct()
    return src.load_symbols(sym, catalog).select("asset_id", "path", "type", "name", F.col("metadata")["ord"].alias("meta_ord"))


@register("classify_symbol", """SELECT doc_id, CASE WHEN regexp_matches(n, '^use[A-Z]') THEN 'hook' WHEN regexp_matches(n, '^[A-Z][a-zA-Z0-9]*$') AND regexp_matches(text, '<[A-Za-z]') AND doc_id % 2 = 0 THEN 'component'
 WHEN starts_with(n, 'get') OR starts_with(n, 'fetch') THEN 'service' ELSE 'function' END AS type FROM (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'use' WHEN 3 THEN 'get' WHEN 5 THEN 'fetch' ELSE '' END || split_part(text, ' ', 1) AS n FROM documents)""")
def _(s, d):
    k = F.col("doc_id") % 6
    name = F.concat(F.when(k == 0, "use").when(k == 3, "get").when(k == 5, "fetch").otherwise(""), F.split_part("text", F.lit(" "), F.lit(1)))
    path = F.when(F.col("doc_id") % 2 == 0, "src/a.tsx").otherwise("src/a.ts")
    return fx.read(s, d, "documents").select("doc_id", rules.classify_symbol(name, F.col("text"), path).alias("type"))


_SITES = """l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages), k AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM l),
es AS (SELECT DISTINCT page_id, line::INTEGER AS line, lower(tag) AS tag FROM (SELECT page_id, line, unnest(regexp_extract_all(text, '<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag FROM k))"""


@register("element_sites", f"WITH {_SITES} SELECT page_id, line, tag FROM es")
def _(s, d):
    return extraction.element_sites(fx.read(s, d, "pages"), "page_id", content="html")


_TIER_SQL = "CASE " + " ".join(f"WHEN tag IN ({', '.join(repr(t) for t in tags)}) THEN '{tier}'" for tier, tags in rules.TIERS.items()) + " END"


@register("semantic_tier", f"WITH {_SITES} SELECT tag, {_TIER_SQL} AS tier, tag IN ('div', 'span') AS wrapper, count(*) AS sites FROM es GROUP BY tag")
def _(s, d):
    e = extraction.element_sites(fx.read(s, d, "pages"), "page_id", content="html")
    return e.groupBy("tag").agg(F.count(F.lit(1)).alias("sites")).select("tag", rules.semantic_tier(F.col("tag")).alias("tier"), rules.is_wrapper(F.col("tag")).alias("wrapper"), "sites")


_ATTRS = """WITH x AS (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][^<>]*)>', 1) AS l FROM pages), y AS (SELECT page_id, unnest(range(0, len(l)))::INTEGER AS ord, unnest(l) AS e FROM x),
z AS (SELECT page_id, ord, lower(regexp_extract(e, '^([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag, regexp_extract_all(regexp_replace(e, '^[a-zA-Z][a-zA-Z0-9-]*', ''), '([a-zA-Z][a-zA-Z0-9-]*(?:="[^"]*")?)', 1) AS ats FROM y)
SELECT page_id, ord, tag, array_to_string(list_transform(ats, lambda v: split_part(v, '=', 1)), ',') AS names, array_to_string(list_transform(ats, lambda v: CASE WHEN contains(v, '=') THEN substr(regexp_replace(v, '^[^=]*="|"$', '', 'g'), 1, 100) ELSE 'true' END), ',') AS vals FROM z WHERE len(ats) > 0"""


@register("element_attributes", _ATTRS)
def _(s, d):
    e = extraction.element_attributes(fx.read(s, d, "pages"), "page_id", content="html")
    return e.select("page_id", "ord", "tag", F.array_join("names", ",").alias("names"), F.array_join("values", ",").alias("vals"))


@register("text_clip", """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS a, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS b, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS c FROM t""")
def _(s, d):
    t = F.col("text")
    return fx.read(s, d, "documents").select("doc_id", rules.text_clip(t, 80, within=False).alias("a"), rules.text_clip(t, 80).alias("b"), rules.text_clip(t, 80, "...").alias("c"))


_KW = ", ".join(repr(k) for k in rules.KEYWORDS)


@register("expression_inputs", f"""SELECT event_id, array_to_string(list_reverse(list_distinct(list_reverse(list_filter(l, lambda x: x NOT IN ({_KW}))))), ',') AS inputs_unordered, len(list_distinct(list_filter(l, lambda x: x NOT IN ({_KW})))) AS n
FROM (SELECT event_id, regexp_extract_all(props, '([A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*)', 1) AS l FROM events)""".replace("array_to_string(list_reverse(list_distinct(list_reverse(", "array_to_string(list_sort(list_distinct((").replace("inputs_unordered", "inputs"))
def _(s, d):
    got = rules.expression_inputs(F.col("props"))
    return fx.read(s, d, "events").select("event_id", F.array_join(F.sort_array(got), ",").alias("inputs"), F.size(got).cast("long").alias("n"))


@register("references_identifier", r"SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_$])the($|[^A-Za-z0-9_$])') AS reads FROM documents")
def _(s, d):
    return fx.read(s, d, "documents").select("doc_id", rules.references_identifier(F.col("text"), "the").alias("reads"))


@register("value_kind", r"""SELECT event_id, CASE WHEN regexp_matches(v, '^["''`]') THEN 'string' WHEN regexp_matches(v, '^-?[0-9]+(\.[0-9]+)?$') THEN 'number' WHEN v IN ('true', 'false') THEN 'boolean' WHEN contains(v, '.map(') OR contains(v, 'features') OR contains(v, 'faqs') OR contains(v, 'plans') THEN 'list' ELSE 'unknown' END AS kind
FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || '.map(x)' ELSE trim(regexp_extract(props, ':([^,}]*)', 1)) END AS v FROM events)""")
def _(s, d):
    v = F.when(F.col("event_id") % 5 == 0, F.concat("event_type", F.lit(".map(x)"))).otherwise(F.regexp_extract("props", ":([^,}]*)", 1))
    return fx.read(s, d, "events").select("event_id", rules.value_kind(v).alias("kind"))


@register("call_sites", r"""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages), k AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM l),
c AS (SELECT page_id, line, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_.]*\([^()]*\))', 1)) AS call FROM k)
SELECT page_id, line::INTEGER AS line, split_part(call, '(', 1) AS callee, array_to_string(list_filter(list_transform(string_split(regexp_extract(call, '\((.*)\)$', 1), ','), lambda x: trim(x)), lambda x: x <> ''), ';') AS args FROM c""")
def _(s, d):
    return extraction.call_sites(fx.read(s, d, "pages"), "page_id", content="html").select("page_id", "line", "callee", F.array_join("args", ";").alias("args"))


@register("write_sites", """WITH e AS (SELECT user_id AS owner, event_id, CASE event_type WHEN 'click' THEN 'setView' WHEN 'view' THEN 'store.setView' WHEN 'purchase' THEN 'cart.set' WHEN 'error' THEN 'dispatch' ELSE 'view' END AS callee, event_id % 50 AS line FROM events)
SELECT owner, line, callee AS expression FROM e WHERE callee IN ('setView', 'store.setView', 'cart.set', 'dispatch') GROUP BY ALL""")
def _(s, d):
    e = fx.read(s, d, "events")
    callee = F.when(F.col("event_type") == "click", "setView").when(F.col("event_type") == "view", "store.setView").when(F.col("event_type") == "purchase", "cart.set").when(F.col("event_type") == "error", "dispatch").otherwise("view")
    sites = e.select(F.col("user_id").alias("owner"), callee.alias("callee"), F.lit("function").alias("context"), (F.col("event_id") % 50).alias("line"), callee.alias("expression"))
    return extraction.write_sites(sites, "view").select("owner", "line", "expression")


@register("reactive_triggers", "SELECT event_id, user_id AS owner FROM events WHERE event_type = 'click' OR event_id % 3 = 0")
def _(s, d):
    e = fx.read(s, d, "events").select("event_id", F.col("user_id").alias("owner"), F.array(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "click").otherwise("none")).alias("deps"))
    return extraction.reactive_triggers(e, "click").select("event_id", "owner")


@register("source_library", """SELECT page_id, CASE WHEN contains(m, 'react-redux') OR contains(m, '@reduxjs/toolkit') THEN 'redux' WHEN contains(m, 'zustand') THEN 'zustand' WHEN contains(m, 'mobx') THEN 'mobx' WHEN contains(m, 'store') OR n = 'pageStore' THEN 'custom' END AS library
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'react-redux' WHEN 1 THEN 'Zustand/middleware' WHEN 2 THEN 'mobx-react' WHEN 3 THEN './store' ELSE lower(url) END AS m0, lower(m0) AS m, CASE WHEN page_id % 7 = 0 THEN 'pageStore' ELSE 'page' END AS n FROM pages)""")
def _(s, d):
    k = F.col("page_id") % 6
    module = F.when(k == 0, "react-redux").when(k == 1, "Zustand/middleware").when(k == 2, "mobx-react").when(k == 3, "./store").otherwise(F.lower("url"))
    return fx.read(s, d, "pages").select("page_id", rules.source_library(module, F.when(F.col("page_id") % 7 == 0, "pageStore").otherwise("page")).alias("library"))


@register("event_action_class", """SELECT event_id, CASE event_type WHEN 'click' THEN 'router-action' WHEN 'view' THEN 'analytics-event' WHEN 'purchase' THEN 'state-update' WHEN 'error' THEN 'api-mutation' ELSE 'function-call' END AS action FROM events""")
def _(s, d):
    t = F.col("event_type")
    x = F.when(t == "click", F.concat(F.lit("router.push("), "props", F.lit(")"))).when(t == "view", F.concat(F.lit("track("), "props", F.lit(")"))).when(t == "purchase", F.concat(F.lit("setCart("), "props", F.lit(")"))).when(t == "error", F.concat(F.lit("submit "), "props")).otherwise(F.concat(F.lit("run("), "props", F.lit(")")))
    return fx.read(s, d, "events").select("event_id", rules.event_action_class(x).alias("action"))


@register("find_text_line", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM l)
SELECT doc_id, min(line)::INTEGER AS line FROM k WHERE contains(text, 'icense') GROUP BY doc_id""")
def _(s, d):
    return extraction.find_text_line(fx.read(s, d, "documents"), "icense", "doc_id", content="text")


@register("slice_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, greatest(1, least(doc_id % 5, len(l))) AS a, doc_id % 5 + doc_id % 9 AS e FROM l),
z AS (SELECT doc_id, l, a, least(greatest(e, a), len(l), a + 119) AS z FROM r) SELECT doc_id, a::INTEGER AS start, z::INTEGER AS "end", array_to_string(l[a:z], chr(10)) AS text FROM z""")
def _(s, d):
    docs = fx.read(s, d, "documents")
    ranges = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("start"), (F.col("doc_id") % 5 + F.col("doc_id") % 9).cast("int").alias("end"))
    return extraction.slice_lines(docs.select("doc_id", "text"), ranges, "doc_id", content="text").select("doc_id", "start", "end", "text")


@register("source_snippets", """WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM l)
SELECT source AS owner, doc_id, 1 AS start, least(3, len(l))::INTEGER AS "end", array_to_string(l[1:3], chr(10)) AS text FROM k WHERE r <= 8""")
def _(s, d):
    docs = fx.read(s, d, "documents")
    sym = docs.select(F.col("source").alias("owner"), "doc_id", F.lit(1).alias("start"), F.lit(3).alias("end"))
    return extraction.source_snippets(sym, docs.select("doc_id", F.col("text").alias("content")), "doc_id", 8).select("owner", "doc_id", "start", "end", "text")


@register("detect_intent", f"WITH q AS ({fx.QUESTIONS_SQL}) SELECT query_id, CASE WHEN contains(lower(query), 'component') THEN 'component_trace' WHEN contains(lower(query), 'hook') THEN 'hook_trace' WHEN contains(lower(query), 'route') THEN 'route_trace' WHEN contains(lower(query), 'data') OR contains(lower(query), 'flow') THEN 'data_flow' ELSE 'unknown' END AS intent FROM q")
def _(s, d):
    return fx.questions(s, d).select("query_id", rules.detect_intent(F.col("query")).alias("intent"))


@register("extract_target", r"SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') WHEN 1 THEN 'use' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') WHEN 2 THEN '/c/' || c_custkey WHEN 3 THEN regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') END AS target FROM customer")
def _(s, d):
    q = fx.questions(s, d)
    return q.select("query_id", rules.extract_target(F.col("query"), rules.detect_intent(F.col("query"))).alias("target"))


@register("search_targets", f"""WITH n AS ({fx.G1_NODES_SQL}), q AS (SELECT n_nationkey AS query_id, lower(n_name) AS term FROM nation UNION ALL SELECT 1000, ' ' UNION ALL SELECT 1001, 'customer'),
h AS (SELECT query_id, node AS id, row_number() OVER (PARTITION BY query_id ORDER BY type, node)::INTEGER AS rank FROM n JOIN q ON contains(lower(label || ' ' || path || ' ' || type), trim(term)) WHERE trim(term) <> '') SELECT query_id, rank, id FROM h WHERE rank <= 30""")
def _(s, d):
    n = fx.g1_nodes(s, d).select(F.col("node").alias("id"), F.col("type").alias("rank_key"), F.concat_ws(" ", "label", "path", "type").alias("text"))
    q = fx.read(s, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    more = s.createDataFrame([(1000, " "), (1001, "Customer")], "query_id int, query string")
    return search.search_targets(n, q.unionByName(more))


@register("search_graph", f"""WITH {P}, {SITE}, c AS (SELECT 'route' AS kind, 0 AS r, asset AS id, asset AS text FROM a UNION ALL SELECT 'file', 1, asset, html FROM a), q AS (SELECT n_nationkey AS query_id, lower(substr(n_name, 1, 2)) AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'file' END AS scope FROM nation),
h AS (SELECT query_id, id, min({{'r': r, 'k': kind}}) AS x FROM c JOIN q ON contains(lower(text), term) AND (scope IS NULL OR scope = kind) GROUP BY query_id, id), z AS (SELECT query_id, x.k AS kind, id, row_number() OVER (PARTITION BY query_id ORDER BY x.r, id)::INTEGER AS rank FROM h)
SELECT query_id, rank, kind, id FROM z WHERE rank <= 40""")
def _(s, d):
    a = site(s, d)
    c = a.select(F.lit("route").alias("kind"), F.lit(0).alias("kind_rank"), F.col("asset").alias("id"), F.col("asset").alias("text"))
    c = c.unionByName(a.select(F.lit("file").alias("kind"), F.lit(1).alias("kind_rank"), F.col("asset").alias("id"), F.col("html").alias("text")))
    q = fx.read(s, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.substring("n_name", 1, 2).alias("query"), F.when(F.col("n_nationkey") % 2 == 0, "file").alias("scope"))
    return search.search_graph(c, q)


@register("parse_answers", r"""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_type END AS title, event_id % 4 <> 3 AS valid FROM events""")
def _(s, d):
    e = fx.read(s, d, "events")
    obj = F.to_json(F.struct(F.col("event_type").alias("title"), F.col("props").alias("summary")))
    k = F.col("event_id") % 4
    text = F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), obj, F.lit("\n```\nBye"))).when(k == 2, F.concat(F.lit("Sure! "), obj, F.lit(" done"))).otherwise(F.concat(F.lit("no object: "), "event_type"))
    out = search.parse_answers(e.select("event_id", text.alias("answer")))
    return out.select("event_id", F.when(F.col("valid"), F.col("parsed.title")).alias("title"), "valid")


@register("result_cache_hits", f"""WITH q AS ({fx.QUESTIONS_SQL}), k AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL ELSE CASE WHEN query_id % 3 = 1 THEN 'hit' ELSE 'stale' END END AS st FROM q)
SELECT query_id, CASE WHEN st IS NULL THEN NULL ELSE 'r' || query_id END AS result, coalesce(st, 'miss') AS state FROM k""")
def _(s, d):
    q = fx.questions(s, d).withColumns({"commit": F.lit("c2"), "version": F.lit(3)})
    cache = q.where("query_id % 3 <> 0").select(F.sha2("query", 256).alias("query_hash"), F.when(F.col("query_id") % 3 == 1, "c2").otherwise("c1").alias("commit"), F.lit(3).alias("version"), F.concat(F.lit("r"), F.col("query_id").cast("string")).alias("result"), "query_id")
    cache = first_by(cache.drop("query_id").withColumn("o", F.col("result")), ["query_hash"], ["o"]).drop("o")
    return search.result_cache_hits(q, cache)
