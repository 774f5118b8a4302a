"""Column rules: classification, clipping and parsing of texts and paths, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_rules(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(default)
    for cond, value in reversed(cases):
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


#: Language of a file by its extension.
LANGUAGES = {"tsx": "tsx", "ts": "ts", "jsx": "jsx", "js": "js", "html": "html", "htm": "html"}


def asset_language(path: Column, languages: dict[str, str] = LANGUAGES, default: str = "ts") -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return by_rules([(ext == k, v) for k, v in languages.items()], default)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def asset_flags(content: Column, marks: dict[str, list[str]]) -> dict[str, Column]:
    """A flag for each name: whether the content holds one of its marks."""
    return {name: reduce(lambda a, b: a | b, (content.contains(m) for m in texts)) for name, texts in marks.items()}


#: Names of hooks, components and services, files with markup, and what a component's text holds.
HOOK_NAME, COMPONENT_NAME, SERVICE_NAME = "^use[A-Z]", "^[A-Z][a-zA-Z0-9]*$", "^(get|fetch)"
MARKUP_FILE, MARKUP = r"\.(tsx|jsx)$", "<[A-Za-z]"


def classify_symbol(name: Column, context: Column, path: Column | None = None) -> Column:
    """hook by name; component by name and markup, in a file for markup (where ``path`` is given); service by name; else function."""
    markup = context.rlike(MARKUP) if path is None else context.rlike(MARKUP) & path.rlike(MARKUP_FILE)
    return by_rules([(name.rlike(HOOK_NAME), "hook"), (name.rlike(COMPONENT_NAME) & markup, "component"), (name.rlike(SERVICE_NAME), "service")], "function")


#: Tiers of elements, in the order in which they are tried.
TIERS = {
    "content": ["p", "blockquote", "hr", "address", "pre", "figure", "figcaption", "details", "summary", "datalist"],
    "form-control": ["form", "fieldset", "legend", "label", "button", "input", "textarea", "select", "option", "optgroup", "output", "meter", "progress"],
    "heading": ["h1", "h2", "h3", "h4", "h5", "h6"],
    "landmark": ["main", "header", "footer", "nav", "aside"],
    "list": ["ul", "ol", "li", "dl", "dt", "dd", "menu"],
    "media": ["img", "picture", "source", "video", "audio", "track", "canvas", "svg", "iframe", "embed", "object"],
    "region": ["section", "article", "dialog", "search", "form"],
    "table": ["table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "th", "td"],
}
WRAPPERS = ["div", "span"]


def semantic_tier(tag: Column, tiers: dict[str, list[str]] = TIERS) -> Column:
    t = F.lower(tag)
    return by_rules([(t.isin(tags), tier) for tier, tags in tiers.items()])


def is_wrapper(tag: Column) -> Column:
    return F.lower(tag).isin(WRAPPERS)


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))


def text_clip(text: Column, n: int, mark: str = "…", within: bool = True) -> Column:
    """Texts of more than ``n`` characters cut with a mark that counts (``within``) or comes on top."""
    t = one_line(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n - len(mark) if within else n), F.lit(mark))).otherwise(t)


#: Words that are no identifiers.
KEYWORDS = ["true", "false", "null", "undefined", "length"]


def expression_inputs(expression: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Distinct dotted identifiers in order."""
    found = F.regexp_extract_all(expression, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(keywords)))


def references_identifier(expression: Column, name: str | Column) -> Column:
    """Whether an expression reads an identifier, or the root of a dotted one: between borders of tokens, dots among them."""
    n = F.lit(name) if isinstance(name, str) else name
    root = F.trim(F.split_part(n, F.lit("."), F.lit(1)))
    quoted = F.regexp_replace(root, r"([$])", r"\\$1")
    return F.coalesce(F.regexp_like(expression, F.concat(F.lit(r"(^|[^A-Za-z0-9_$])"), quoted, F.lit(r"($|[^A-Za-z0-9_$])"))), F.lit(False))


#: What an expression that gives a list holds.
LISTS = [".map(", "features", "faqs", "plans"]


def value_kind(literal: Column) -> Column:
    """The kind of a value by how its expression begins or what it holds."""
    t = F.trim(literal)
    lists = reduce(lambda a, b: a | b, (t.contains(x) for x in LISTS))
    return by_rules([(t.rlike("^[\"'`]"), "string"), (t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number"), (t.isin("true", "false"), "boolean"), (lists, "list")], "unknown")


#: Hooks of state libraries.
REDUX_HOOKS = ["useSelector", "useAppSelector", "useDispatch", "useAppDispatch", "useStore"]
MOBX_HOOKS = ["useObserver", "useLocalObservable", "useAsObservableSource", "observer"]


def source_library(module: Column, name: Column) -> Column:
    """The state library behind a hook, by module and then by name."""
    m = F.lower(F.coalesce(module, F.lit("")))
    cases = [
        (m.contains("react-redux") | m.contains("@reduxjs/toolkit") | name.isin(REDUX_HOOKS), "redux"),
        (m.contains("zustand"), "zustand"),
        (m.contains("mobx") | name.isin(MOBX_HOOKS), "mobx"),
        (m.contains("store") | name.endswith("Store"), "custom"),
    ]
    return by_rules(cases)


#: Patterns of what a handler does, in the order in which they are tried.
ACTIONS = {
    "router-action": r"router\.(push|replace|back|refresh)",
    "analytics-event": r"track\(|analytics\.|gtag\(|posthog\.",
    "state-update": r"^set[A-Z]",
    "api-mutation": r"mutate\(|useMutation|submit",
}


def event_action_class(expression: Column) -> Column:
    """What a handler does, by the first pattern that fits. State updates are known by what stands before the first parenthesis."""
    head = F.split_part(expression, F.lit("("), F.lit(1))
    return by_rules([((head if action == "state-update" else expression).rlike(p), action) for action, p in ACTIONS.items()], "function-call")


#: Files that make a route, by role.
ROUTE_ROLES = {"page": ["tsx", "ts", "jsx", "js"], "layout": ["tsx", "ts", "jsx", "js"], "loading": ["tsx", "ts", "jsx", "js"], "error": ["tsx", "ts", "jsx", "js"], "not-found": ["tsx", "ts", "jsx", "js"], "template": ["tsx", "ts", "jsx", "js"], "route": ["ts", "js"]}


def route_role(path: Column) -> Column:
    """The role of a file in its route, or null."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return by_rules([(name.isin([f"{role}.{x}" for x in exts]), role) for role, exts in ROUTE_ROLES.items()])


def route_path(path: Column, root: str = "app") -> Column:
    """Public path of a route file: without the prefix up to the root folder, groups, slots and private folders."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.regexp_extract(p, rf"^(?:.*?/)??(?:src/)?{root}/(.+)$", 1)
    parts = F.split(rest, "/")
    kept = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~(x.rlike(r"^\(.*\)$") | x.startswith("@") | x.startswith("_")))
    return F.when((rest != "") & route_role(p).isNotNull(), F.concat(F.lit("/"), F.array_join(kept, "/")))


#: Role of a node in a trace, by its type; others are ui-output.
NODE_ROLES = {"data-fetch": "data-source", "context": "data-source", "store": "data-source", "hook": "hook-logic", "condition": "visibility-condition", "loop": "loop-logic"}


def node_role(kind: Column) -> Column:
    return by_rules([(kind == k, v) for k, v in NODE_ROLES.items()], "ui-output")


def data_source_kind(kind: Column, meta: Column, fetch: Column) -> Column:
    """The kind a node states if it is a known one, else by its type."""
    known = ["api", "props", "hook", "function", "context", "store"]
    by_type = by_rules([(kind == "data-fetch", "fetch"), (kind.isin("context", "store", "hook"), "own")])
    return F.when(meta.isin(known), meta).when(by_type == "fetch", F.when(fetch == "function", "function").otherwise("api")).when(by_type == "own", kind)


def detect_intent(query: Column) -> Column:
    q = F.lower(query)
    return by_rules([(q.contains("component"), "component_trace"), (q.contains("hook"), "hook_trace"), (q.contains("route"), "route_trace"), (q.contains("data") | q.contains("flow"), "data_flow")], "unknown")


#: Patterns of what a question is about, by its intent, in the order in which they are tried.
TARGETS = {
    "component_trace": [r"(?i)component\s+([A-Za-z][\w]*)", r"^([A-Z][\w]*)$"],
    "hook_trace": [r"(?i)hook\s+(use[A-Za-z][\w]*)", r"\b(use[A-Za-z][\w]*)\b"],
    "route_trace": [r"""["']([^"']+)["']""", r"(/[\w./\[\]-]+)"],
    "data_flow": [r"""["']([^"']+)["']"""],
}


def extract_target(query: Column, intent: Column, targets: dict[str, list[str]] = TARGETS) -> Column:
    """What a question is about: the first pattern of its intent that fits."""
    out, asked = F.lit(None).cast("string"), F.btrim(query, F.lit(" \t\n\x0b\f\r"))
    for name, patterns in targets.items():
        found = F.coalesce(*(F.nullif(F.regexp_extract(asked, p, 1), F.lit("")) for p in patterns))
        out = F.when(intent == name, found).otherwise(out)
    return out


def file_slug(name: Column) -> Column:
    """A name that is safe for files: runs of slashes to underscores, runs of other characters than letters, digits, dots and dashes to hyphens."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\]+", "_"), "[^A-Za-z0-9_.-]+", "-")
