"""Reference resolution as prioritized equi-joins: candidates are tagged with a tier, joined, and the least tier of each reference wins.

Hot names are pre-aggregated: the side that is searched has one row for each key before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.plans.blocks import with_text
from assetloom.plans.durable import cut, saved
from assetloom.plans.frontier import few

#: What is tried behind a path, in order.
CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def normalized(path: Column) -> Column:
    """A path without ``.`` and with ``..`` applied; steps above the top are dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    apply = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), apply), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def try_candidates(refs: DataFrame, base: Column, assets: DataFrame, candidates: list[str] = CANDIDATES) -> DataFrame:
    """(ref_id, path): the first candidate of ``base`` that is an asset's path."""
    tried = refs.select("ref_id", F.posexplode(F.array(*(F.concat(base, F.lit(c)) for c in candidates))).alias("pos", "path"))
    hit = tried.join(assets.select("path").distinct(), "path")
    return hit.groupBy("ref_id").agg(F.min(F.struct("pos", "path")).alias("x")).select("ref_id", "x.path")


def resolve_relative(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """refs: ref_id, source (path), target. Targets that begin with a dot, from the source's folder."""
    r = refs.where(F.col("target").startswith("."))
    return try_candidates(r, normalized(F.concat(folder(F.col("source")), F.lit("/"), "target")), assets)


def resolve_alias(refs: DataFrame, aliases: DataFrame, assets: DataFrame) -> DataFrame:
    """aliases: alias_ord, pattern, replacement, each with one ``*`` or none. The first alias that fits and leads to an asset. Aliases are a configuration of few rows."""
    a = F.broadcast(aliases.withColumns({"head": F.split_part("pattern", F.lit("*"), F.lit(1)), "tail": F.when(F.col("pattern").contains("*"), F.split_part("pattern", F.lit("*"), F.lit(2))), "star": F.col("pattern").contains("*")}))
    fits = F.when(F.col("star"), F.col("target").startswith(F.col("head")) & F.col("target").endswith(F.col("tail")) & (F.char_length("target") >= F.char_length("head") + F.char_length("tail"))).otherwise(F.col("target") == F.col("pattern"))
    r = refs.join(a, fits)
    middle = F.expr("substring(target, char_length(head) + 1, char_length(target) - char_length(head) - char_length(tail))")
    base = F.when(F.col("star"), F.concat(F.split_part("replacement", F.lit("*"), F.lit(1)), middle, F.split_part("replacement", F.lit("*"), F.lit(2)))).otherwise(F.col("replacement"))
    tried = r.select("ref_id", "alias_ord", F.posexplode(F.array(*(F.concat(normalized(base), F.lit(c)) for c in CANDIDATES))).alias("pos", "path"))
    hit = tried.join(assets.select("path").distinct(), "path")
    return hit.groupBy("ref_id").agg(F.min(F.struct("alias_ord", "pos", "path")).alias("x")).select("ref_id", "x.path")


def resolve_package(refs: DataFrame, packages: DataFrame, assets: DataFrame) -> DataFrame:
    """packages: name, root, main, exports (map of subpath to file). The export of the subpath, else candidates below the root, else (without subpath) main."""
    name = F.regexp_extract("target", r"^(@[^/]+/[^/]+|[^@./][^/]*)", 1)
    r = refs.withColumn("name", name).where("name <> ''").withColumn("sub", F.expr("ltrim('/', substring(target, char_length(name) + 1))")).join(packages, "name")
    key = F.when(F.col("sub") == "", F.lit(".")).otherwise(F.concat(F.lit("./"), "sub"))
    export = F.try_element_at("exports", key)
    base = F.concat("root", F.when(F.col("sub") == "", "").otherwise(F.concat(F.lit("/"), "sub")))
    options = [F.concat("root", F.lit("/"), normalized(export)), *(F.concat(base, F.lit(c)) for c in CANDIDATES[1:]), F.when(F.col("sub") == "", F.concat("root", F.lit("/"), normalized(F.col("main"))))]
    tried = r.select("ref_id", F.posexplode(F.array(*options)).alias("pos", "path")).where("path is not null")
    hit = tried.join(assets.select("path").distinct(), "path")
    return hit.groupBy("ref_id").agg(F.min(F.struct("pos", "path")).alias("x")).select("ref_id", "x.path")


def cascade(*tiers: tuple[str, DataFrame], key: str = "ref_id", value: str = "path") -> DataFrame:
    """(key, value, how): the value of the first tier that has one. One shuffle for all tiers."""
    out = None
    for i, (how, df) in enumerate(tiers):
        t = df.select(key, F.lit(i).alias("tier"), value, F.lit(how).alias("how"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy(key).agg(F.min(F.struct("tier", value, "how")).alias("x")).select(key, F.col(f"x.{value}").alias(value), "x.how")


def resolve_ref(refs: DataFrame, assets: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """Relative, then project alias, then package, then any alias; null where none leads to an asset."""
    own = aliases.where(F.col("pattern").startswith("@/"))
    found = cascade(("relative", resolve_relative(refs, assets)), ("alias", resolve_alias(refs, own, assets)), ("package", resolve_package(refs, packages, assets)), ("any-alias", resolve_alias(refs, aliases, assets)))
    return refs.join(found, "ref_id", "left").select(*refs.columns, "path", "how")


def unresolved_refs(refs: DataFrame, resolved: DataFrame, internal: Column) -> DataFrame:
    """References that should lead to an asset and don't."""
    return refs.where(internal).join(resolved.where("path is not null").select("ref_id"), "ref_id", "left_anti")


def _ranked(types: list[str]) -> Column:
    m = F.create_map(*(x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))))
    return F.coalesce(F.try_element_at(m, F.col("type")), F.lit(len(types)))


LOCAL_RANKS = ["hook", "service", "function", "component"]


def best_symbols(symbols: DataFrame, keys: list[str], ranks: list[str]) -> DataFrame:
    """The best symbol for each key, by rank of its type, then path and order: one row a key, so hot names don't multiply."""
    return symbols.groupBy(*keys).agg(F.min(F.struct(_ranked(ranks).alias("rank"), "path", "ord", "symbol")).alias("x")).select(*keys, F.col("x.symbol").alias("symbol"))


def resolve_name_local(refs: DataFrame, symbols: DataFrame, ranks: list[str] = LOCAL_RANKS) -> DataFrame:
    """refs: ref_id, source (path), name. A symbol of the name in the same asset."""
    best = best_symbols(symbols.withColumn("source", F.col("path")), ["source", "name"], ranks)
    return refs.join(best, ["source", "name"]).select("ref_id", "symbol")


def resolve_name_via_imports(refs: DataFrame, imports: DataFrame, symbols: DataFrame, ranks: list[str] = LOCAL_RANKS) -> DataFrame:
    """imports: source, import_ord, name, path (resolved). A symbol of the name in the asset that it is imported from, by the first import that has one."""
    best = best_symbols(symbols.withColumn("from", F.col("path")), ["from", "name"], ranks)
    i = imports.where("path is not null").select("source", "name", "import_ord", F.col("path").alias("from"))
    hit = refs.join(i, ["source", "name"]).join(best, ["from", "name"])
    return hit.groupBy("ref_id").agg(F.min_by("symbol", F.struct("import_ord", "from")).alias("symbol"))


def resolve_name_global(refs: DataFrame, symbols: DataFrame, ranks: list[str]) -> DataFrame:
    return refs.join(best_symbols(symbols, ["name"], ranks), "name").select("ref_id", "symbol")


def _asked(refs: DataFrame) -> DataFrame:
    """The distinct sources and names of references, as references themselves."""
    return refs.select("source", "name").distinct().withColumn("ref_id", F.struct("source", "name"))


def answered(refs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """References joined with what was found for their source and name (written; one row for each): sent to the references if it is small, so that those of a hot name aren't brought together."""
    found = saved(found.select(F.col("ref_id.source").alias("f_source"), F.col("ref_id.name").alias("f_name"), *(c for c in found.columns if c != "ref_id")))
    same = F.col("source").eqNullSafe(F.col("f_source")) & F.col("name").eqNullSafe(F.col("f_name"))
    return refs.join(few(found, found.count()), same, how).drop("f_source", "f_name")


def resolve_render_target(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports, then any symbol of the name. Each source and name is resolved once, however many references ask for it."""
    asked = saved(_asked(refs))
    found = cascade(("imports", resolve_name_via_imports(asked, imports, symbols, ["component", "hook"])), ("global", resolve_name_global(asked, symbols, ["component", "hook"])), value="symbol")
    return answered(refs, found).select("ref_id", "symbol", "how")


#: Roots of calls that the language itself provides.
BUILTINS = ["Array", "Boolean", "console", "Date", "fetch", "JSON", "Math", "Number", "Object", "parseInt", "parseFloat", "Promise", "setInterval", "setTimeout", "String", "URL", "URLSearchParams"]


def resolve_call_target(calls: DataFrame, imports: DataFrame, symbols: DataFrame, builtins: list[str] = BUILTINS) -> DataFrame:
    """calls: ref_id, source, callee (dotted). (ref_id, dst, kind, label, module), never null: internal, built-in or external.

    Each source and name is resolved once, however many calls ask for it."""
    ranks = ["service", "hook", "function", "component"]
    c = calls.withColumn("name", F.split_part("callee", F.lit("."), F.lit(1)))
    asked = saved(_asked(c))
    found = cascade(("local", resolve_name_local(asked, symbols)), ("imports", resolve_name_via_imports(asked, imports, symbols, ranks)), ("global", resolve_name_global(asked, symbols, ranks)), value="symbol")
    module = imports.groupBy("source", "name").agg(F.min_by("module", "import_ord").alias("module"))
    c = answered(c, asked.join(found, "ref_id", "left").join(module, ["source", "name"], "left").select("ref_id", "symbol", "module"), "left")
    builtin, known = F.col("name").isin(builtins), F.col("symbol").isNotNull()
    dst = F.coalesce("symbol", F.when(builtin, F.concat(F.lit("builtin:"), "callee")).otherwise(F.concat(F.lit("external:"), F.coalesce("module", F.lit("unknown")), F.lit("#"), "callee")))
    kind = F.when(known, "internal").when(builtin, "builtin").otherwise("external")
    outside = ~known & ~builtin & F.col("module").isNotNull()
    label = F.when(outside, F.concat("callee", F.lit(" ("), "module", F.lit(")"))).otherwise(F.col("callee"))
    return c.select("ref_id", dst.alias("dst"), kind.alias("kind"), label.alias("label"), F.when(outside, F.col("module")).alias("module"))


def resolve_flow_target(tree: DataFrame, sources: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """The target of each flow tree (tree_id, node_id, parent_id, ord, kind, name): its first call's callee or, without calls, its first identifier."""
    from assetloom.operators.traversal import first_of_kinds_in_tree

    named = first_of_kinds_in_tree(tree, [["call"], ["identifier", "member", "await"]], "name").join(sources, "tree_id")
    refs = saved(named.select(F.col("tree_id").alias("ref_id"), "source", F.col("name").alias("callee")))
    return resolve_call_target(refs, imports, symbols).withColumnRenamed("ref_id", "tree_id")


def resolve_symbol_hint(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """queries: query_id, name, type, hint (part of a path, or null). The first fitting symbol, how many fit, and the others.

    Queries that ask the same are answered once, so a hot name is listed once for each of its hints, and the list is joined in blocks of the queries. How well a hint fits
    follows from the path, so the symbols of a name are listed by path first, once for all hints; a hint brings texts of paths together, not symbols."""
    in_path = symbols.groupBy("name", "type", "path").agg(F.sort_array(F.collect_list(F.struct("ord", "symbol")))["symbol"].alias("x"))
    text = lambda x: F.when(F.exists(x, lambda y: y.isNotNull()), F.array_join(x, ","))
    rest = F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(1)))
    in_path = saved(in_path.select("name", "type", "path", F.size("x").alias("n"), F.col("x")[0].alias("first"), text(rest).alias("rest")))
    q = queries.select("name", "type", "hint").distinct().join(in_path, ["name", "type"])
    q = q.where(F.col("hint").isNull() | F.col("path").contains(F.col("hint")))
    fit = F.when(F.col("path") == F.col("hint"), 0).when(F.col("path").endswith(F.col("hint")), 1).otherwise(2)
    g = q.groupBy("name", "type", "hint").agg(F.sort_array(F.collect_list(F.struct(fit.alias("fit"), "path", "first", "rest", "n"))).alias("x"))
    more = F.flatten(F.transform("x", lambda y, i: F.array(F.when(i > 0, y["first"]), y["rest"])))
    total = F.aggregate("x", F.lit(0), lambda s, y: s + y["n"])
    asks = ["name", "type", "given", "no_hint"]
    ask = lambda df: df.withColumns({"given": F.coalesce("hint", F.lit("")), "no_hint": F.col("hint").isNull()})
    g = ask(g).select(*asks, F.col("x")[0]["first"].alias("symbol"), total.alias("n"), F.array_join(more, ",").alias("others"))
    return with_text(ask(queries).select("query_id", *asks), g, asks, "others").select("query_id", "symbol", "n", "others")


def ambiguous_symbols(symbols: DataFrame) -> DataFrame:
    """(name, n, kept): names of several symbols and the first of them."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "ord", "symbol")).alias("x")).where("n > 1").select("name", "n", F.col("x.symbol").alias("kept"))


_ENTRIES = "array<struct<by: string, key: string, tier: int>>"


def expression_lookup(nodes: DataFrame, hook_inputs: bool = True, condition_inputs: bool = True) -> DataFrame:
    """(by, key, tier, ord, node): what finds a node, from the least tier to the greatest: outputs and inputs of hooks, fetches, contexts, stores, conditions, loops, labels.

    nodes: node, ord, type, label, name, outputs and reads (lists), inputs (list of name and source), expression. ``by`` tells
    whether the key is an expression's ``whole``, its ``root``, or a text of which the root is a ``part``. Nulls find nothing."""

    def entry(by: str, key: Column, tier: int) -> Column:
        return F.struct(F.lit(by).alias("by"), key.alias("key"), F.lit(tier).alias("tier"))

    def given(kind: str, *lists: Column) -> Column:
        return F.when(F.col("type") == kind, F.concat(*(F.coalesce(x, F.array().cast(_ENTRIES)) for x in lists))).otherwise(F.array().cast(_ENTRIES))

    def each(names: str, tier: int, field: str | None = None, by: str = "root") -> Column:
        return F.transform(names, lambda x: entry(by, x[field] if field else x, tier))

    label, name, expr = F.col("label"), F.col("name"), F.col("expression")
    tiers = [given("hook", each("outputs", 0))]
    if hook_inputs:
        tiers.append(given("hook", each("inputs", 1, "source", "whole"), each("inputs", 1, "source"), each("inputs", 1, "name")))
    tiers.append(given("data-fetch", each("outputs", 2), F.array(entry("part", label, 2), entry("root", name, 2))))
    tiers += [given(kind, each("outputs", t), F.array(entry("root", name, t))) for kind, t in (("context", 3), ("store", 4))]
    tiers.append(given("condition", F.array(entry("whole", expr, 5), entry("whole", label, 5)), *([each("reads", 5)] if condition_inputs else [])))
    below = F.when(expr.contains("."), F.split_part(expr, F.lit("."), F.lit(1)))
    tiers.append(given("loop", F.array(entry("whole", expr, 6), entry("root", below, 6))))
    tiers.append(F.array(entry("whole", label, 7), entry("root", label, 7)))
    return nodes.select("node", "ord", F.explode(F.concat(*tiers)).alias("x")).select("x.by", "x.key", "x.tier", "ord", "node").where("key <> ''")


def _pieces(text: str, sizes: str) -> Column:
    return F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(sequence(1, greatest(char_length({text}) - n + 1, 1)), i -> substring({text}, i, n)))))")


def _holders(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, x): the first of the texts (key, x) of which a root is a part.

    A root asks by its pieces of three characters, or by the whole of a shorter one, and is met by the one of them that the fewest texts offer, so all texts that hold the root are met without comparing all with
    all. Texts offer pieces of the lengths that are asked for; what isn't asked for is dropped where it is made, and roots with a piece that no text offers find nothing."""
    wanted = saved(roots.select("root", F.explode(_pieces("root", "array(least(3, char_length(root)))")).alias("piece")))
    sizes = sorted(r[0] for r in wanted.select(F.char_length("piece")).distinct().collect())  # three at most
    if not sizes:
        return texts.select(F.lit("").alias("root"), "x").limit(0)
    pieces = cut(wanted.select("piece").distinct())
    offered = texts.select("key", "x", F.explode(_pieces("key", f"array({', '.join(map(str, sizes))})")).alias("piece"))
    counts = offered.join(few(pieces, pieces.count()), "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = wanted.join(counts, "piece", "left")
    asked = cut(asked.groupBy("root").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rarest")).where("rarest.n > 0").select("root", F.col("rarest.piece").alias("piece")))
    met = offered.join(few(asked, asked.count()), "piece").where(F.col("key").contains(F.col("root")))
    return met.groupBy("root").agg(F.min("x").alias("x"))


def resolve_expression(expressions: DataFrame, lookup: DataFrame) -> DataFrame:
    """(expr_id, node, tier): the least tier, then order, of what an expression (expr_id, expression) finds by its whole or by its root, the part before the first dot.

    lookup: that of ``expression_lookup``, or (key, tier, ord, node) for keys that may be either. Blank expressions and those with a blank root find nothing by the root."""
    e = expressions.select("expr_id", F.trim("expression").alias("whole"), F.trim(F.split_part(F.trim("expression"), F.lit("."), F.lit(1))).alias("root"))
    keyed = lookup if "by" in lookup.columns else lookup.withColumn("by", F.explode(F.array(F.lit("whole"), F.lit("root"))))
    keyed = keyed.select("by", "key", F.struct("tier", "ord", "node").alias("x"))
    asked = e.select("expr_id", F.explode(F.array(F.struct(F.lit("whole").alias("by"), F.col("whole").alias("key")), F.struct(F.lit("root").alias("by"), F.col("root").alias("key")))).alias("a")).select("expr_id", "a.by", "a.key").where("key <> ''")
    sought = saved(asked.select("by", "key").distinct())
    found = keyed.where("by <> 'part'").join(few(sought, sought.count()), ["by", "key"]).groupBy("by", "key").agg(F.min("x").alias("x"))
    hits = asked.join(found, ["by", "key"]).select("expr_id", "x")
    if "by" in lookup.columns:
        held = _holders(keyed.where("by = 'part'"), e.where("root <> ''").select("root").distinct())
        hits = hits.unionByName(e.join(held, "root").select("expr_id", "x"))
    return hits.groupBy("expr_id").agg(F.min("x").alias("x")).select("expr_id", "x.node", "x.tier")


def first_import_for_name(names: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, name, import_ord, module): the first import that brings in a name."""
    first = imports.groupBy("source", "name").agg(F.min(F.struct("import_ord", "module")).alias("x"))
    return names.join(first, ["source", "name"]).select("source", "name", "x.import_ord", "x.module")
