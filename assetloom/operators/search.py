"""Search, retrieval and batch question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.operators import extraction
from assetloom.plans.durable import cut, saved
from assetloom.plans.frontier import FEW, at_ids, few, incident, looked_up, steps_of, walk
from assetloom.plans.ranked import top_by


#: Characters of the pieces that an index holds.
SIZES = (1, 2, 3)
#: Up to so many pieces (counted) are sought in each text, which takes less time than dividing the text into its own.
FEW_PIECES = 64


def _pieces(text: str, sizes: str) -> Column:
    """Distinct pieces of a text; it is divided into its characters once, as finding the i-th one anew for each piece takes the square of the length."""
    piece = "concat(element_at(c, i), if(n > 1, element_at(c, i + 1), ''), if(n > 2, element_at(c, i + 2), ''))"
    of_size = f"if(size(c) < n, array(), transform(sequence(1, size(c) - n + 1), i -> {piece}))"
    return F.expr(f"array_distinct(flatten(transform(array(split({text}, '')), c -> flatten(transform({sizes}, n -> {of_size})))))")


def piece_index(entries: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(piece, id): the pieces of one to three characters of the texts (id, text), in lower case; to be stored with the catalog."""
    return _exploded(entries, sizes).distinct()


def _exploded(entries: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    low = entries.select("id", F.lower("text").alias("low"))
    return low.select(F.explode(_pieces("low", f"array({', '.join(map(str, sizes))})")).alias("piece"), "id")


def update_index(index: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """The index with the pieces of changed and new entries (id, text) instead of their old ones, and without those of ids that are gone."""
    ids = changed.select("id").unionByName(gone.select("id")).distinct()
    return index.join(ids, "id", "left_anti").unionByName(piece_index(changed).select(*index.columns))


def _against(entries: DataFrame, queries: DataFrame, index: DataFrame | None) -> DataFrame:
    """Entries and queries (term) whose text holds the term. Each term is looked up by the one of its longest pieces that the fewest entries have, and verified there.

    Without a stored index the asked pieces are indexed first. A term one of whose pieces no entry has finds nothing, at no cost."""
    terms = queries.select("term").distinct()
    asked = saved(terms.select("term", F.explode(_pieces("term", "array(least(3, char_length(term)))")).alias("piece")))
    wanted = asked.select("piece").distinct()
    n = wanted.count()
    if index is None and n <= FEW_PIECES:
        low, pieces = F.lower("text"), [r.piece for r in wanted.collect()]
        found = F.array_compact(F.array(*(F.when(low.contains(F.lit(p)), F.lit(p)) for p in pieces))) if pieces else F.array().cast("array<string>")
        held = entries.select(F.explode(found).alias("piece"), "id")
    else:
        if index is None:
            sizes = sorted(r.n for r in wanted.select(F.char_length("piece").alias("n")).distinct().collect())  # three at most
            index = _exploded(entries, tuple(sizes) or SIZES)
        held = index.join(few(wanted, n), "piece", "left_semi").select("piece", "id")
    held = saved(held.distinct())
    counts = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "piece", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x")).where("x.n > 0")
    met = rarest.select("term", F.col("x.piece").alias("piece")).join(held, "piece").select("term", F.col("id").alias("met"))
    hits = entries.withColumn("text", F.lower("text")).join(met, F.col("id") == F.col("met")).where(F.col("text").contains(F.col("term"))).drop("met", "text").withColumnRenamed("term", "found")
    return hits.join(queries, F.col("found") == F.col("term")).drop("found")


def search_targets(catalog: DataFrame, queries: DataFrame, limit: int = 30, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id): entries (id, rank_key, text) whose text holds the query, the first ``limit`` of each; blank queries find nothing. ``index``: a stored ``piece_index``."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("term")).where("term <> ''")
    hits = _against(catalog, q, index)
    return top_by(hits, ["query_id"], ["rank_key", "id"], limit).select("query_id", "rank", "id")


def search_graph(corpus: DataFrame, queries: DataFrame, limit: int = 40, index: DataFrame | None = None) -> DataFrame:
    """As ``search_targets`` over entries of several kinds (kind, kind_rank, id, text); queries may name a scope, an id counts once."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("term"), "scope").where("term <> ''")
    hits = _against(corpus, q, index).where(F.col("scope").isNull() | (F.col("scope") == F.col("kind")))
    once = hits.groupBy("query_id", "id").agg(F.min(F.struct("kind_rank", "kind")).alias("x")).select("query_id", "id", "x.kind_rank", "x.kind")
    return top_by(once, ["query_id"], ["kind_rank", "id"], limit).select("query_id", "rank", "kind", "id")


def retrieve_context(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """(root, ord, node, label, path): a root and the nodes around it, in the order of their edges, the first ``limit``."""
    return _context(nodes, edges, saved(_inner(edges, roots, depth)), limit)


def _inner(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node): the nodes whose edges are within ``depth`` of a root. A single step from the roots needs no walk, for which the steps would be written."""
    if depth != 2:
        return walk(steps_of(edges, "both"), roots.select("root"), depth - 1).select("root", "node")
    r = cut(roots.select("root").distinct())
    near = steps_of(edges, "both").join(looked_up(r), F.col("src") == F.col("root")).select("root", F.col("dst").alias("node"))
    return near.unionByName(r.select("root", F.col("root").alias("node"))).distinct()


def _context(nodes: DataFrame, edges: DataFrame, inner: DataFrame, limit: int) -> DataFrame:
    """``retrieve_context`` of the nodes whose edges count (written). What is first around a root is first around one of these nodes, so the first ``limit`` and one (the root itself) of each node suffice, however many edges it has. Edges at other nodes aren't brought together."""
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("at"), F.col(y).alias("other")) for x, y in (("src", "dst"), ("dst", "src")))))
    ends = at_ids(edges.select("type", "k", ends.alias("x")).select("x.at", "x.other", "type", "k").where("at is not null"), "at", inner.select("node"))
    each = ends.select("at", F.explode(F.array("at", "other")).alias("near"), "type", "k").where("near is not null")
    tops = top_by(each.groupBy("at", "near").agg(F.min(F.struct("type", "k")).alias("o")), ["at"], ["o", "near"], limit + 1, "place")
    first = inner.join(tops, F.col("node") == F.col("at")).groupBy("root", F.col("near").alias("node")).agg(F.min("o").alias("o"))
    ranked = saved(top_by(first, ["root"], [F.col("node") != F.col("root"), "o", "node"], limit, "ord"))
    return ranked.join(at_ids(nodes.select("node", "label", "path"), "node", ranked.select("node")), "node").select("root", "ord", "node", "label", "path")


#: Intents that ask for a symbol, and its type.
SYMBOL_INTENTS = {"component_trace": "component", "hook_trace": "hook"}
ROUTE_INTENT = "route_trace"


def _gathered(requests: DataFrame, nodes: DataFrame, edges: DataFrame, assets: DataFrame, route_files: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``retrieval`` but for its edges, written, and the nodes (query_id, node) whose edges count."""
    r = saved(requests.select("query_id", "intent", "target"))
    kind = F.create_map(*(F.lit(x) for p in SYMBOL_INTENTS.items() for x in p))
    wanted = r.where(F.col("intent").isin(*SYMBOL_INTENTS)).select("query_id", F.try_element_at(kind, F.col("intent")).alias("n_type"), F.col("target").alias("n_label"))
    named = at_ids(nodes, "label", wanted.select("n_label"))
    found = wanted.join(named, (F.col("type") == F.col("n_type")) & (F.col("label") == F.col("n_label"))).groupBy("query_id", "n_type", "n_label").agg(F.min("node").alias("root"))
    found = saved(found.select("query_id", "root"))
    roots = found.select("root").distinct()
    bare = lambda c: F.concat(F.lit("/"), F.btrim(c, F.lit("/")))
    files = route_files.select("route", "asset").distinct()
    asked = r.where(F.col("intent") == ROUTE_INTENT).select("query_id", F.explode(F.array_distinct(F.array("target", bare(F.col("target"))))).alias("route"))
    named_route = saved(asked.join(files, "route").select("query_id", "asset").distinct())
    of_route = saved(named_route.join(at_ids(nodes, "path", named_route.select("asset")), F.col("asset") == F.col("path")).select("query_id", "node").distinct())

    inner = saved(_inner(edges, roots, depth))
    near = _context(nodes, edges, inner, limit).select(F.col("root").alias("of"), "ord", "node")
    numbered = of_route.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("node")))
    ids = saved(found.join(near, F.col("root") == F.col("of")).select("query_id", "ord", "node").unionByName(numbered.select("query_id", "ord", "node")))
    symbols = saved(ids.join(at_ids(nodes, "node", ids.select("node")), "node"))
    lines = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))
    listed = symbols.select("query_id", F.lit("symbols").alias("section"), F.col("ord").cast("long").alias("ord"), F.col("node").alias("subject"), F.concat(F.lit("- "), "label", F.lit("\n  - id: "), "node", F.lit("\n  - type: "), "type", F.lit("\n  - file: "), "path", F.lit("\n  - lines: "), lines("start", "end")).alias("value"))
    at = found.join(inner.select(F.col("root").alias("of"), "node"), F.col("root") == F.col("of")).select("query_id", "node").unionByName(of_route)
    ranges = symbols.where(F.col("ord") <= limit).select(F.col("query_id").alias("owner"), "path", "start", "end")
    cuts = saved(extraction.source_snippets(ranges, at_ids(assets.select("path", "content"), "path", ranges.select("path")), "path", limit))
    snippets = cuts.where("warning is null").select(F.col("owner").alias("query_id"), F.lit("snippets").alias("section"), F.col("start").cast("long").alias("ord"), F.col("path").alias("subject"), F.concat(F.lit("### "), "path", F.lit(":"), lines("start", "end"), F.lit("\n\n```tsx\n"), "text", F.lit("\n```")).alias("value"))
    warn = lambda df, text: df.select("query_id", F.lit("warnings").alias("section"), F.lit(0).cast("long").alias("ord"), F.col("subject").alias("subject"), text.alias("value"))
    unread = warn(cuts.where("warning is not null").select(F.col("owner").alias("query_id"), F.col("path").alias("subject")).distinct(), F.concat(F.lit("- "), "subject", F.lit(" can't be read")))
    hit = found.select("query_id").unionByName(named_route.select("query_id")).distinct()
    missing = r.join(hit, "query_id", "left_anti").withColumn("subject", F.coalesce("target", F.lit("unknown")))
    known = F.col("intent").isin(*SYMBOL_INTENTS, ROUTE_INTENT)
    missing = warn(missing, F.when(known, F.concat(F.lit("- "), "subject", F.lit(" not found"))).otherwise(F.concat(F.lit("- intent "), F.coalesce("intent", F.lit("none")), F.lit(" isn't supported"))))
    return saved(listed.unionByName(snippets).unionByName(unread).unionByName(missing)), saved(at.distinct())


#: Edges of requests for one task.
TASK_EDGES = 1 << 19


class _Arrows:
    """The edges at the nodes of requests, ``at`` (query_id, node): an edge once for each request, however many of its nodes it meets.

    A request's edges aren't compared to find those that it meets twice: at its end an edge counts unless the request has its start too. So edges are
    sent to the requests' nodes, or, if the nodes are few, nodes to the edges, and requests times edges, which is what is asked for, aren't shuffled."""

    def __init__(self, edges: DataFrame, at: DataFrame):
        rows = edges.select("type", "src", "dst", "k", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end")).where("end is not null")
        rows = at_ids(rows, "end", at.select("node")).distinct()
        value = F.concat(F.lit("- "), "src", F.lit(" --"), "type", F.lit("--> "), "dst").alias("value")
        self.ends = saved(rows.select("end", "src", "k", value, _hashed("src").alias("hash")))
        self.at, self.n = at, at.count()
        self.sizes = at.join(self.ends.groupBy("end").agg(F.count(F.lit(1)).alias("n")), F.col("node") == F.col("end")).select("query_id", "node", "n")
        least = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.tasks = max(least, min((self.sizes.agg(F.sum("n")).first()[0] or 0) // TASK_EDGES + 1, 10_000))

    def _sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.n <= 2 * FEW else df

    def _once(self, rows: DataFrame) -> DataFrame:
        met = self.at.select(F.col("query_id").alias("of"), F.col("node").alias("start"))
        start = F.when(F.col("end") != F.col("src"), F.col("src"))
        return rows.join(self._sent(met), F.col("query_id").eqNullSafe(F.col("of")) & (start == F.col("start")), "left_anti")

    def rows(self) -> DataFrame:
        """(query_id, src, k, value)"""
        dealt = self.ends.repartition(self.tasks, "end", "src", "k", "value")
        return self._once(dealt.join(self._sent(self.at), F.col("end") == F.col("node"))).select("query_id", "src", "k", "value")

    def counts(self) -> DataFrame:
        """(query_id, hash, n): the number of edges of each request by the hash of their start, without listing those that leave a node."""
        by_start = self.ends.groupBy("end", "hash").agg(F.count(F.lit(1)).alias("n"))
        all_ = self._sent(self.at).join(by_start, F.col("node") == F.col("end")).select("query_id", "hash", "n")
        ends = self.ends.where("end <> src").join(self._sent(self.at), F.col("end") == F.col("node")).select("query_id", "src", "hash")
        met = self.at.select(F.col("query_id").alias("of"), F.col("node").alias("start"))
        twice = ends.join(self._sent(met), F.col("query_id").eqNullSafe(F.col("of")) & (F.col("src") == F.col("start"))).select("query_id", "hash", F.lit(-1).cast("long").alias("n"))
        return all_.unionByName(twice).groupBy("query_id", "hash").agg(F.sum("n").alias("n")).where("n > 0")

    def parts(self, counted: DataFrame) -> DataFrame:
        """(query_id, bucket, block, idx, text): the edges of each request in parts, numbered. ``counted``: (query_id, n), the number of its edges.

        Requests that share their largest node are dealt in groups of about ``TASK_EDGES`` edges, and the edges of their nodes are sent once to each group, where the edges of a request are sorted."""
        sized = self.sizes.groupBy("query_id").agg(F.sum("n").alias("all"), F.max(F.struct("n", "node")).alias("x")).select("query_id", "all", F.col("x.node").alias("hub"))
        hubs = sized.groupBy("hub").agg(F.ceil(F.sum("all") / TASK_EDGES).alias("groups"))
        group = F.xxhash64("hub", F.pmod(F.xxhash64("query_id"), F.col("groups")))
        grouped = sized.join(hubs, "hub").join(counted, F.col("query_id").eqNullSafe(F.col("counted"))).select(F.col("query_id").alias("q"), group.alias("group"), "of_all")
        placed = saved(self.at.join(grouped, F.col("query_id").eqNullSafe(F.col("q"))).select("query_id", "node", "group", F.ceil(F.col("of_all") / (10 * PART)).alias("buckets")))
        sent = self.ends.join(self._sent(placed.select(F.col("group").alias("to"), "node").distinct()), F.col("end") == F.col("node")).drop("node").repartition(self.tasks, "to")
        rows = self._once(sent.join(self._sent(placed), (F.col("to") == F.col("group")) & (F.col("end") == F.col("node"))))
        return _in_parts(rows.withColumn("bucket", F.pmod("hash", "buckets")), ["to", "query_id"], ["k", "src", "value"])


def _hashed(subject: str) -> Column:
    """The first 32 bits of the MD5 of a subject."""
    return F.conv(F.substring(F.md5(F.coalesce(subject, F.lit(""))), 1, 8), 16, 10).cast("long")


def _in_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(*keys, bucket, block, idx, text): the values of each key and bucket in order, ``PART`` at most in a block; ``idx`` numbers the blocks of a key from 1."""
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order))).withColumn("block", F.floor((F.col("rn") - 1) / PART))
    texts = rows.groupBy(*keys, "bucket", "block").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rn", "value")))["value"], "\n").alias("text"))
    return texts.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("bucket", "block")))


def retrieval(requests: DataFrame, nodes: DataFrame, edges: DataFrame, assets: DataFrame, route_files: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """(query_id, section, ord, subject, value) for each request (query_id, intent, target): symbols, edges, snippets and warnings.

    A component or hook is the first node (node, type, label, path, start, end) of that name; its edges are those within ``depth``, its symbols the nodes around it, the first ``limit``. A
    route (route, asset), with or without a slash at its beginning and end, has the nodes of its files and all their edges. Snippets are the lines of
    the first ``limit`` files (path, content) of the symbols. Targets that aren't found, files that can't be read and other intents give warnings."""
    rest, at = _gathered(requests, nodes, edges, assets, route_files, depth, limit)
    return rest.unionByName(_Arrows(edges, at).rows().select("query_id", F.lit("edges").alias("section"), F.col("k").alias("ord"), F.col("src").alias("subject"), "value"))


#: Entries of a part of a document.
PART = 500
_SECTIONS = {"symbols": "Symbols", "edges": "Graph Edges", "snippets": "Source Snippets", "warnings": "Warnings"}


def _frame(requests: DataFrame, parts: DataFrame, filled: DataFrame) -> DataFrame:
    """(query_id, no, bucket, block, text): the top of each document, the head of each section, ``- none`` for those not in ``filled`` (query_id, section), and ``parts`` (query_id, section, bucket, block, text)."""
    zero, names = F.lit(0).cast("long"), list(_SECTIONS)
    number = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("section")).cast("int")
    every = requests.select("query_id", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("no"), F.lit(x).alias("section")) for i, x in enumerate(names)))).alias("x")).select("query_id", "x.*")
    titles = F.element_at(F.create_map(*(F.lit(x) for p in _SECTIONS.items() for x in p)), F.col("section"))
    heads = every.select("query_id", "no", F.lit(-1).cast("long").alias("bucket"), zero.alias("block"), F.concat(F.lit("## "), titles).alias("text"))
    empty = every.join(filled, ["query_id", "section"], "left_anti").select("query_id", "no", zero.alias("bucket"), zero.alias("block"), F.lit("- none").alias("text"))
    top = requests.select("query_id", F.lit(0).alias("no"), zero.alias("bucket"), zero.alias("block"), F.concat(F.lit("# Code Trace Context\n\n## Intent\n\n"), F.coalesce("intent", F.lit("unknown")), F.lit("\n\n## Target\n\n"), F.coalesce("target", F.lit("unknown"))).alias("text"))
    return top.unionByName(heads).unionByName(empty).unionByName(parts.select("query_id", number.alias("no"), "bucket", "block", "text"))


def _rest_in_parts(retrieved: DataFrame) -> DataFrame:
    counted = retrieved.groupBy("query_id", "section").agg(F.count(F.lit(1)).alias("n"))
    rows = retrieved.join(counted, ["query_id", "section"]).withColumn("bucket", F.pmod(_hashed("subject"), F.ceil(F.col("n") / (10 * PART))))
    return _in_parts(rows, ["query_id", "section"], ["ord", "subject", "value"])


def _place() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy("no", "bucket", "block"))


def retrieval_document(requests: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, part, text): the document of each request in parts, to be read one after the other: intent and target, then symbols, edges, snippets and warnings.

    A part has ``PART`` entries at most, so a hub's edges are never in one row; sections of more than ten parts are divided before they are numbered, by the first 32 bits of the MD5 of the subject."""
    filled = retrieved.select("query_id", "section").distinct()
    return _frame(requests, _rest_in_parts(retrieved), filled).select("query_id", _place().alias("part"), "text")


def retrieved_documents(requests: DataFrame, nodes: DataFrame, edges: DataFrame, assets: DataFrame, route_files: DataFrame, depth: int = 2, limit: int = 8) -> DataFrame:
    """``retrieval_document`` of ``retrieval``. Neither the edges of all requests nor the texts of their parts are shuffled: how many parts a request's edges make is worked out from counts, which gives the numbers of the other parts."""
    rest, at = _gathered(requests, nodes, edges, assets, route_files, depth, limit)
    arrows = _Arrows(edges, at)
    counts = saved(arrows.counts())
    counted = counts.groupBy(F.col("query_id").alias("counted")).agg(F.sum("n").alias("of_all"))
    by_bucket = counts.join(counted, F.col("query_id").eqNullSafe(F.col("counted"))).groupBy("query_id", F.pmod("hash", F.ceil(F.col("of_all") / (10 * PART))).alias("bucket")).agg(F.sum("n").alias("n"))
    made = saved(by_bucket.groupBy(F.col("query_id").alias("of")).agg(F.sum(F.ceil(F.col("n") / PART)).alias("made")))
    filled = rest.select("query_id", "section").distinct().unionByName(made.select(F.col("of").alias("query_id"), F.lit("edges").alias("section")))
    frame = _frame(requests, _rest_in_parts(rest), filled).withColumn("place", _place())
    frame = saved(frame.join(made, F.col("query_id").eqNullSafe(F.col("of")), "left").drop("of"))
    others = frame.select("query_id", (F.col("place") + F.when(F.col("no") > 2, F.coalesce("made", F.lit(0))).otherwise(0)).cast("int").alias("part"), "text")
    heads = frame.where("no = 2 and bucket = -1 and made > 0").select(F.col("query_id").alias("of"), F.col("place").alias("before"))
    parts = arrows.parts(counted)
    return others.unionByName(parts.join(arrows._sent(heads), F.col("query_id").eqNullSafe(F.col("of"))).select("query_id", (F.col("before") + F.col("idx")).cast("int").alias("part"), "text"))


def context_document(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, document): a text on a root, its type and its edges."""
    e = incident(edges, roots.select(F.col("root").alias("node"), "root"), "root")
    line = F.concat(F.lit("- "), "src", F.lit(" "), "type", F.lit(" "), "dst").alias("line")
    listed = e.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("type", "src", "dst", "k", line))), lambda x: x["line"]), "\n").alias("edges"))
    n = roots.join(nodes, F.col("root") == F.col("node")).join(listed, "root", "left")
    return n.select("root", F.concat(F.lit("# "), "label", F.lit("\n\nType: "), "type", F.lit("\n\nEdges:\n"), F.coalesce("edges", F.lit("- none"))).alias("document"))


ANSWER = "title string, summary string, entryPoints array<struct<file: string, lines: string>>, flow array<struct<step: int, title: string, detail: string, file: string>>, relatedFiles array<string>, warnings array<string>"


def json_part(text):
    """The JSON object in an answer: all of it, a fenced block, or what lies from the first to the last brace."""
    t = F.trim(text)
    fenced = F.trim(F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(t.startswith("{") & t.endswith("}"), t).when(fenced != "", fenced).when(braces != "", braces).otherwise(t)


def parse_answers(answers: DataFrame, schema: str = ANSWER, required: tuple[str, ...] = ("title", "summary"), text_col: str = "answer") -> DataFrame:
    """``parsed`` (a struct) and ``valid``; answers that can't be read keep their text in ``fallback``."""
    a = answers.withColumn("parsed", F.from_json(json_part(F.col(text_col)), schema, {"mode": "PERMISSIVE"}))
    valid = F.col("parsed").isNotNull()
    for r in required:
        valid = valid & F.col(f"parsed.{r}").isNotNull()
    return a.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("fallback", F.when(~F.col("valid"), F.col(text_col)))


def result_cache_hits(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached results by query hash; fresh only with the same commit and index version."""
    q = queries.withColumn("query_hash", F.sha2("query", 256))
    hit = q.join(cache.select("query_hash", F.col("commit").alias("c"), F.col("version").alias("v"), "result"), "query_hash", "left")
    fresh = F.coalesce((F.col("commit") == F.col("c")) & (F.col("version") == F.col("v")), F.lit(False))
    return hit.select("query_id", "result", F.when(F.col("c").isNull(), "miss").when(fresh, "hit").otherwise("stale").alias("state"))
