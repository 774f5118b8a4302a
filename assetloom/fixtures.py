"""Catalogs and graphs derived from the driver's tables, as DataFrames and as DuckDB SQL.

G1: commerce graph; G2: site graph of the pages; G3: ordered steps of users; G4: corpus of documents;
G6: questions in natural language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: type, source type, source key, target type, target key, table, natural key
G1_EDGES = [
    ("contains", "region", "n_regionkey", "nation", "n_nationkey", "nation", "n_nationkey"),
    ("has_customer", "nation", "c_nationkey", "customer", "c_custkey", "customer", "c_custkey"),
    ("has_supplier", "nation", "s_nationkey", "supplier", "s_suppkey", "supplier", "s_suppkey"),
    ("places", "customer", "o_custkey", "order", "o_orderkey", "orders", "o_orderkey"),
    ("contains_part", "order", "l_orderkey", "part", "l_partkey", "lineitem", "l_orderkey * 8 + l_linenumber"),
    ("supplies", "supplier", "l_suppkey", "part", "l_partkey", "lineitem", "l_orderkey * 8 + l_linenumber"),
]
G1_PRIORITY = {"contains": 0, "has_customer": 1, "has_supplier": 1, "places": 2, "contains_part": 3, "supplies": 4}


def g1_edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """type, src, dst, k (natural key). Tables of types that aren't asked for aren't read."""
    out = None
    for kind, a, ak, b, bk, table, k in G1_EDGES:
        if types is None or kind in types:
            e = read(spark, sf_dir, table).select(F.lit(kind).alias("type"), _node(a, ak).alias("src"), _node(b, bk).alias("dst"), F.expr(k).cast("long").alias("k"))
            out = e if out is None else out.unionByName(e)
    return out


G1_SQL = " UNION ALL ".join(f"SELECT '{t}' AS type, '{a}:' || {ak} AS src, '{b}:' || {bk} AS dst, ({k})::BIGINT AS k FROM {table}" for t, a, ak, b, bk, table, k in G1_EDGES)

#: type, key, label, table
G1_NODES = [("region", "r_regionkey", "r_name", "region"), ("nation", "n_nationkey", "n_name", "nation"), ("customer", "c_custkey", "c_name", "customer"), ("supplier", "s_suppkey", "s_name", "supplier"), ("order", "o_orderkey", "o_orderpriority", "orders"), ("part", "p_partkey", "p_name", "part")]


def g1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, type, label, path (the scope that holds it)."""
    out = None
    for kind, key, label, table in G1_NODES:
        n = read(spark, sf_dir, table).select(_node(kind, key).alias("node"), F.lit(kind).alias("type"), F.col(label).alias("label"), F.lit(f"/{table}").alias("path"))
        out = n if out is None else out.unionByName(n)
    return out


G1_NODES_SQL = " UNION ALL ".join(f"SELECT '{t}:' || {k} AS node, '{t}' AS type, {lab} AS label, '/{table}' AS path FROM {table}" for t, k, lab, table in G1_NODES)

#: Every 20th key is a root.
EVERY = 20


def g1_roots(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    key, table = next((k, t) for x, k, _, t in G1_NODES if x == kind)
    return read(spark, sf_dir, table).where(F.col(key) % EVERY == 0).select(_node(kind, key).alias("root"))


def g1_roots_sql(kind: str) -> str:
    key, table = next((k, t) for x, k, _, t in G1_NODES if x == kind)
    return f"SELECT '{kind}:' || {key} AS root FROM {table} WHERE {key} % {EVERY} = 0"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, path (no query, fragment, end slash or .html), html."""
    p = read(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), r"\.html$", ""), "/+$", "")
    return p.select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), "html")


PAGES_SQL = r"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  CASE WHEN regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.html$', ''), '/+$', '') = '' THEN '/'
       ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '\.html$', ''), '/+$', '') END AS path, html FROM pages"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, hash, source, lang."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("hash"), "source", "lang")


CORPUS_SQL = "SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, text AS content, sha256(text) AS hash, source, lang FROM documents"


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state of the corpus: rows missing, hashes changed, and rows that no longer exist."""
    c = corpus(spark, sf_dir).where("doc_id % 10 <> 0")
    h = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old-"), "hash")).otherwise(F.col("hash"))
    gone = read(spark, sf_dir, "nation").select((F.col("n_nationkey") - 1000).cast("long").alias("doc_id"), F.concat(F.lit("gone/xx/"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("gone").alias("hash"))
    return c.select("doc_id", "path", h.alias("hash")).unionByName(gone)


SNAPSHOT_SQL = f"""SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN 'old-' || hash ELSE hash END AS hash FROM ({CORPUS_SQL}) WHERE doc_id % 10 <> 0
  UNION ALL SELECT (n_nationkey - 1000)::BIGINT, 'gone/xx/' || n_nationkey, 'gone' FROM nation"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, ord (event id after time), kind, target, props, value."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.col("event_type").alias("target"), "props", "value")


STEPS_SQL = "SELECT user_id AS owner, ts, event_id AS ord, event_type AS kind, event_type AS target, props, value FROM events"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query."""
    c = read(spark, sf_dir, "customer")
    name, key = F.regexp_replace("c_name", "[^A-Za-z0-9]", ""), F.col("c_custkey").cast("string")
    q = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("trace component "), name)).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("hook use"), name)).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit('route "/c/'), key, F.lit('"'))).when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("data flow of '"), name, F.lit("'"))).otherwise(F.concat(F.lit("tell me about "), F.col("c_mktsegment"), F.lit(" "), key))
    return c.select(F.col("c_custkey").alias("query_id"), q.alias("query"))


QUESTIONS_SQL = r"""SELECT c_custkey AS query_id, CASE c_custkey % 5 WHEN 0 THEN 'trace component ' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')
  WHEN 1 THEN 'hook use' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') WHEN 2 THEN 'route "/c/' || c_custkey || '"'
  WHEN 3 THEN 'data flow of ''' || regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') || '''' ELSE 'tell me about ' || c_mktsegment || ' ' || c_custkey END AS query FROM customer"""
