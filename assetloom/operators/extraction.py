"""Extraction from text and HTML assets: references, symbols, elements, lines, calls and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetloom.functions import rules
from assetloom.plans.ranked import first_by


def lines(assets: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(*keys, line, text): lines from 1."""
    return assets.select(*keys, F.posexplode(F.split(content, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def extract_refs(assets: DataFrame, pattern: str, *keys: str, content: str = "content") -> DataFrame:
    """(*keys, ord, target): non-empty references in order."""
    found = assets.select(*keys, F.posexplode(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))).alias("ord", "target"))
    return found.where("target <> ''")


def _breaks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, "\n", ""))


def extract_symbols(assets: DataFrame, rules_: dict[str, str], *keys: str, content: str = "content", clip: int = 120) -> DataFrame:
    """(*keys, type, name, ord, start_line, end_line, signature, hash): entities found by a pattern for each type; the first of a name counts in an asset.

    Lines count from 1 and are those of the whole match; the body is the pattern's first group, the signature its first line, clipped.
    Each match is marked with a control character (removed from the text before), so that the text falls into pieces that begin with a match;
    only numbers, names and hashes are ordered by piece."""
    out = None
    for i, (kind, pattern) in enumerate(rules_.items()):
        marked = F.regexp_replace(F.translate(content, "\x01", ""), pattern, "\x01$0")
        found = assets.select(*keys, F.posexplode(F.split(marked, "\x01")).alias("pos", "piece"))
        body = F.regexp_extract("piece", f"^(?:{pattern})", 1)
        first_line = F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, clip)
        found = found.select(*keys, F.lit(kind).alias("type"), F.lit(i).alias("rule"), "pos", _breaks(F.col("piece")).alias("breaks"), _breaks(F.regexp_extract("piece", f"^(?:{pattern})", 0)).alias("inside"), F.substring(rules.one_line(body), 1, clip).alias("name"), first_line.alias("signature"), F.sha2(body, 256).alias("hash"))
        out = found if out is None else out.unionByName(found)
    before = Window.partitionBy(*keys, "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("start_line", (F.sum("breaks").over(before) + 1).cast("int")).where("pos > 0 AND name <> ''")
    out = out.withColumns({"ord": F.col("pos") - 1, "end_line": (F.col("start_line") + F.col("inside")).cast("int")})
    return first_by(out, [*keys, "name"], ["rule", "ord"]).select(*keys, "type", "name", "ord", "start_line", "end_line", "signature", "hash")


def element_sites(assets: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(*keys, line, tag): opening tags by line, each once."""
    found = lines(assets, *keys, content=content).select(*keys, "line", F.explode(F.regexp_extract_all("text", F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)"), F.lit(1))).alias("tag"))
    return found.withColumn("tag", F.lower("tag")).distinct()


def element_attributes(assets: DataFrame, *keys: str, content: str = "content", clip: int = 100) -> DataFrame:
    """(*keys, ord, tag, names, values): elements with attributes; a bare attribute is ``true``, values are clipped."""
    found = assets.select(*keys, F.posexplode(F.regexp_extract_all(content, F.lit(r"<([a-zA-Z][^<>]*)>"), F.lit(1))).alias("ord", "element"))
    attr = r"([a-zA-Z][a-zA-Z0-9-]*(?:=\"[^\"]*\")?)"
    body = F.regexp_replace("element", "^[a-zA-Z][a-zA-Z0-9-]*", "")
    found = found.select(*keys, "ord", F.lower(F.regexp_extract("element", "^([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"), F.regexp_extract_all(body, F.lit(attr), F.lit(1)).alias("attrs"))
    name = lambda x: F.split_part(x, F.lit("="), F.lit(1))
    value = lambda x: F.when(x.contains("="), F.substring(F.regexp_replace(x, r"^[^=]*=\"|\"$", ""), 1, clip)).otherwise("true")
    return found.where(F.size("attrs") > 0).select(*keys, "ord", "tag", F.transform("attrs", name).alias("names"), F.transform("attrs", value).alias("values"))


def call_sites(assets: DataFrame, *keys: str, content: str = "content") -> DataFrame:
    """(*keys, line, callee, args): calls of dotted names without nested parentheses, by line."""
    found = lines(assets, *keys, content=content).select(*keys, "line", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*\([^()]*\))"), F.lit(1))).alias("call"))
    args = F.filter(F.transform(F.split(F.regexp_extract("call", r"\((.*)\)$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return found.select(*keys, "line", F.split_part("call", F.lit("("), F.lit(1)).alias("callee"), args.alias("args"))


def writes(callee: str, field: Column) -> Column:
    """Whether a call writes a field: by its setter, a method that sets, or a dispatch."""
    c, setter = F.col(callee), F.concat(F.lit("set"), F.upper(F.substring(field, 1, 1)), F.substr(field, F.lit(2)))
    return (c == setter) | c.endswith(F.concat(F.lit("."), setter)) | c.endswith(".setState") | c.endswith(".set") | (c == "dispatch")


def write_sites(sites: DataFrame, field: str | Column, *keys: str) -> DataFrame:
    """Sites (owner, callee, context, line, expression) that write a field; one for each expression of a line, and of ``keys``."""
    s = sites.where(writes("callee", F.lit(field) if isinstance(field, str) else field))
    return s.dropDuplicates([*keys, "owner", "line", "expression"])


def reactive_triggers(sites: DataFrame, field: str | Column) -> DataFrame:
    """Sites whose dependencies (deps) hold the field."""
    return sites.where(F.array_contains("deps", field))


def find_text_line(assets: DataFrame, text: str, *keys: str, content: str = "content") -> DataFrame:
    """(*keys, line): the first line that holds the text."""
    return lines(assets, *keys, content=content).where(F.col("text").contains(text)).groupBy(*keys).agg(F.min("line").alias("line"))


def slice_lines(assets: DataFrame, ranges: DataFrame, key: str, content: str = "content", most: int = 120) -> DataFrame:
    """(key, start, end, text): lines start to end of an asset, from 1, within its bounds, ``most`` at most."""
    r = assets.join(ranges, key).withColumn("all", F.split(content, "\n"))
    a = F.greatest(F.lit(1), F.least("start", F.size("all")))
    z = F.least(F.greatest(F.col("end"), a), F.size("all"), a + most - 1)
    return r.select(key, a.alias("start"), z.alias("end"), F.array_join(F.slice("all", a, z - a + 1), "\n").alias("text"))


def source_snippets(symbols: DataFrame, assets: DataFrame, key: str, n: int) -> DataFrame:
    """One slice for each distinct range (key, start, end) of the first ``n`` assets of each owner; a warning where there is no asset."""
    s = symbols.select("owner", key, "start", "end").distinct()
    s = s.withColumn("rank", F.dense_rank().over(Window.partitionBy("owner").orderBy(key))).where(F.col("rank") <= n)
    cut_ = slice_lines(assets.select(key, "content"), s.select(key, "start", "end").distinct().select(key, "start", "end", F.col("start").alias("from"), F.col("end").alias("to")), key)
    cut_ = cut_.select(F.col(key).alias("k"), F.col("start").alias("a"), F.col("end").alias("z"), "text").distinct()
    named = s.join(assets.select(key, F.size(F.split("content", "\n")).alias("size")), key, "left")
    lo = F.greatest(F.lit(1), F.least("start", "size"))
    hi = F.least(F.greatest(F.col("end"), lo), F.col("size"), lo + 119)
    named = named.withColumns({"lo": lo, "hi": hi})
    out = named.join(cut_, (F.col(key) == F.col("k")) & (F.col("lo") == F.col("a")) & (F.col("hi") == F.col("z")), "left")
    return out.select("owner", key, F.col("lo").alias("start"), F.col("hi").alias("end"), "text", F.when(F.col("size").isNull(), "can't be read").alias("warning"))
