import json

from pyspark.sql import functions as F

from assetloom.functions import rules
from assetloom.operators import resolution, routes, search, versioning
from assetloom.sources import assets as src
from assetloom.streaming.index import current_snapshot, stream_index, stream_steps


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan_and_exports(spark, tmp_path):
    for name, text in {"a/x.ts": "one\ntwo", "a/node_modules/y.ts": "no", ".hid/z.ts": "no", "b/w.tsx": "<A/>", "b/c.md": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = src.scan_assets(spark, [str(tmp_path)])
    assert rows(got, "asset_id", "language", "content") == [("file:a/x.ts", "ts", "one\ntwo"), ("file:b/w.tsx", "tsx", "<A/>")]
    nodes = spark.createDataFrame([("n1", "t")], "node string, type string")
    src.export_graph_json(nodes, spark.createDataFrame([("t", "n1", "n1")], "type string, src string, dst string"), str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out/nodes")), "node", "type") == [("n1", "t")]
    src.save_trace_results(spark.createDataFrame([("a/b c", 1)], "query string, n int"), str(tmp_path / "res"))
    assert rows(spark.read.parquet(str(tmp_path / "res")), "slug", "n") == [("a_b-c", 1)]


def test_routes(spark):
    files = ["app/layout.tsx", "app/[locale]/layout.tsx", "app/[locale]/blogs/[slug]/page.tsx", "app/[locale]/blogs/[slug]/loading.tsx", "app/[locale]/(g)/studio/[projectId]/layout.tsx", "app/[locale]/(g)/studio/[projectId]/page.tsx", "app/[locale]/studio/layout.tsx", "app/[locale]/_private/page.tsx", "lib/page.tsx", "app/notes.ts", "app/api/template.jsx"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    got = routes.detect_routes(df)
    assert rows(got, "route")[:3] == [("/",), ("/[locale]",), ("/[locale]/blogs/[slug]",)]
    chain = [x[1] for x in rows(routes.layout_chain(got).where("route = '/[locale]/studio/[projectId]'"), "ord", "layout")]
    assert chain == ["app/layout.tsx", "app/[locale]/layout.tsx", "app/[locale]/studio/layout.tsx", "app/[locale]/(g)/studio/[projectId]/layout.tsx"]
    assert got.where("route = '/api'").first()["template"] == "app/api/template.jsx"


def test_resolution(spark):
    assets = spark.createDataFrame([("src/a/b.ts",), ("src/a/c/index.tsx",), ("pk/main.ts",), ("pk/deep/x.ts",)], "path string")
    refs = spark.createDataFrame([(1, "src/a/z.ts", "./b"), (2, "src/a/z.ts", "../a/./c"), (3, "src/a/z.ts", "@/a/b"), (4, "q.ts", "@s/pk"), (5, "q.ts", "@s/pk/deep/x"), (6, "q.ts", "react"), (7, "q.ts", "@s/pk/ex")], "ref_id int, source string, target string")
    aliases = spark.createDataFrame([(0, "@/*", "src/*"), (1, "lone", "src/a/b.ts")], "alias_ord int, pattern string, replacement string")
    packages = spark.createDataFrame([("@s/pk", "pk", "./main.ts", {"./ex": "./deep/x.ts"})], "name string, root string, main string, exports map<string,string>")
    got = rows(resolution.resolve_ref(refs, assets, aliases, packages), "ref_id", "path", "how")
    assert got == [(1, "src/a/b.ts", "relative"), (2, "src/a/c/index.tsx", "relative"), (3, "src/a/b.ts", "alias"), (4, "pk/main.ts", "package"), (5, "pk/deep/x.ts", "package"), (6, None, None), (7, "pk/deep/x.ts", "package")]
    lookup = spark.createDataFrame([("data", 1, 0, "n1"), ("data.items", 0, 5, "n2"), ("data", 0, 9, "n3")], "key string, tier int, ord int, node string")
    exprs = spark.createDataFrame([(1, "data.items"), (2, "data.x"), (3, "zip")], "expr_id int, expression string")
    assert rows(resolution.resolve_expression(exprs, lookup), "expr_id", "node") == [(1, "n2"), (2, "n3")]
    node = "node string, ord int, type string, label string, name string, outputs array<string>, reads array<string>, inputs array<struct<name: string, source: string>>, expression string"
    nodes = spark.createDataFrame([
        ("hook", 1, "hook", "useQuery", None, ["rows"], None, [("key", "page.id")], None),
        ("fetch", 2, "data-fetch", "load orders", "getAll", None, None, None, None),
        ("fetch2", 3, "data-fetch", "reload orders", None, ["rows", "ab"], None, None, None),
        ("ctx", 4, "context", "c", "Theme", ["colour"], None, None, None),
        ("store", 5, "store", "s", "cart", ["colour", "sum"], None, None, None),
        ("cond", 6, "condition", "is open", None, None, ["open"], None, "open && ready"),
        ("loop", 7, "loop", "l", None, None, None, None, "items.all"),
        ("view", 8, "view", "items", None, None, None, None, None),
    ], node)
    asked = ["rows.length", "page.id", "page.x", "key", "ders", "ab", "zz", " colour", "sum", "open", "open && ready", "items", "items.all", "is open", "Theme.x", "", ".x", None]
    exprs = spark.createDataFrame(list(enumerate(asked)), "expr_id int, expression string")
    by_number = lambda df: {asked[r.expr_id]: r.node for r in df.collect()}
    full = {"rows.length": "hook", "page.id": "hook", "key": "hook", "ders": "fetch", "ab": "fetch2", " colour": "ctx", "sum": "store", "open": "cond", "open && ready": "cond", "items": "loop", "items.all": "loop", "is open": "cond", "Theme.x": "ctx"}
    assert by_number(resolution.resolve_expression(exprs, resolution.expression_lookup(nodes))) == full
    bare = {k: v for k, v in full.items() if k not in {"page.id", "key", "open"}}
    assert by_number(resolution.resolve_expression(exprs, resolution.expression_lookup(nodes, hook_inputs=False, condition_inputs=False))) == bare
    same = spark.createDataFrame([(1, "a", "t", None), (2, "a", "t", None), (3, "a", "t", "q.ts")], "query_id int, name string, type string, hint string")
    syms = spark.createDataFrame([("a", "t", "p.ts", 1, "s1"), ("a", "t", "q.ts", 2, "s2")], "name string, type string, path string, ord int, symbol string")
    assert rows(resolution.resolve_symbol_hint(same, syms), "query_id", "symbol", "n", "others") == [(1, "s1", 2, "s2"), (2, "s1", 2, "s2"), (3, "s2", 1, "")]
    tree = spark.createDataFrame([(1, 1, None, 0, "await", "x"), (1, 2, 1, 0, "call", "getIt.all"), (2, 1, None, 0, "identifier", "JSON")], "tree_id int, node_id int, parent_id int, ord int, kind string, name string")
    symbols = spark.createDataFrame([("s1", "getIt", "function", "p.ts", 1)], "symbol string, name string, type string, path string, ord int")
    imports = spark.createDataFrame([], "source string, import_ord int, name string, module string, path string")
    sources = spark.createDataFrame([(1, "q.ts"), (2, "q.ts")], "tree_id int, source string")
    assert rows(resolution.resolve_flow_target(tree, sources, imports, symbols), "tree_id", "dst", "kind") == [(1, "s1", "internal"), (2, "builtin:JSON", "builtin")]


def test_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(rules.text_clip(F.lit("a  b\ncdef"), 5)) == "a b …" and get(rules.text_clip(F.lit("abcdef"), 5, "...")) == "ab..."
    assert get(rules.expression_inputs(F.lit("a.b + c(a.b, true) && d"))) == ["a.b", "c", "d"]
    assert [get(rules.references_identifier(F.lit(e), "user")) for e in ("user", "user.name", "a.user", "users", "f(user)")] == [True, True, True, False, True]
    assert get(rules.references_identifier(F.lit("user.name"), "user.id")) and not get(rules.references_identifier(F.lit("id"), "user.id"))
    assert [get(rules.value_kind(F.lit(x))) for x in ("'a'", "-1.5", "true", "x.map(f)", "plans", "[1]", "1e5", "f()")] == ["string", "number", "boolean", "list", "list", "unknown", "unknown", "unknown"]
    assert get(rules.expression_inputs(F.lit("a.length + length + this.b"))) == ["a.length", "this.b"]
    kinds = [("useX", "<a/>", "a.ts"), ("use1", "", "a.ts"), ("Card", "<a/>", "a.tsx"), ("Card", "<a/>", "a.ts"), ("Card_x", "<a/>", "a.tsx"), ("getIt", "", "a.ts"), ("myService", "", "a.ts")]
    assert [get(rules.classify_symbol(*map(F.lit, x))) for x in kinds] == ["hook", "function", "component", "function", "function", "service", "function"]
    assert [get(rules.source_library(F.lit(m), F.lit(n))) for m, n in (("", "useAppSelector"), ("x", "useAsObservableSource"), ("x", "observer"), ("lib/store", "useIt"), ("x", "useIt"))] == ["redux", "mobx", "mobx", "custom", None]
    assert get(rules.route_path(F.lit("src\\app\\(g)\\a\\page.ts"))) == "/a"


def test_answers_and_merges(spark):
    raw = ['{"title": "t", "summary": "s", "flow": [{"step": 1, "title": "x"}]}', 'text ```json\n{"title": "t", "summary": "s"}\n``` more', 'see {"title": "t", "summary": "s"} ok', "nothing", '{"title": "t"}', None]
    got = search.parse_answers(spark.createDataFrame(list(enumerate(raw)), "id int, answer string"))
    assert [r.valid for r in got.orderBy("id").collect()] == [True, True, True, False, False, False]
    nodes = spark.createDataFrame([("a", "x"), ("exp:a:b", "x"), ("exp:exp:a:b:c", "x")], "node string, type string")
    assert rows(versioning.anchor_of(nodes), "node", "anchor") == [("exp:a:b", "a"), ("exp:exp:a:b:c", "exp:a:b")]


def test_streams_equal_batches(spark, tmp_path):
    drops = tmp_path / "in"
    drops.mkdir()
    batches = [[("a", "1\n2", 1), ("b", "x", 1)], [("a", "1\n2\n3", 2), ("c", "y", 2), ("b", "x", 2)], [("a", "old", 1)]]
    for i, b in enumerate(batches):
        (drops / f"{i}.json").write_text("\n".join(json.dumps({"path": p, "content": c, "version": v}) for p, c, v in b))
        stream_index(spark, str(drops), str(tmp_path / "snap"), str(tmp_path / "ck")).awaitTermination(60)
    assert rows(current_snapshot(spark, str(tmp_path / "snap")), "path", "n_lines") == [("a", 3), ("b", 1), ("c", 1)]
    (tmp_path / "snap/batch-9").mkdir()  # a driver was lost before its snapshot was finished
    assert current_snapshot(spark, str(tmp_path / "snap")).count() == 3
    assert current_snapshot(spark, str(tmp_path / "snap"), 1).count() == 2 and current_snapshot(spark, str(tmp_path / "snap"), 0) is None


def test_batches_write_what_they_change(spark, tmp_path):
    """A hundred assets, then one of them: one shard is written, one asset extracted; and a driver lost between shard and manifest."""
    from assetloom.streaming import index

    drops, snap = tmp_path / "in", tmp_path / "snap"
    drops.mkdir()
    put = lambda name, rows_: (drops / name).write_text("\n".join(json.dumps({"path": p, "content": c, "version": v}) for p, c, v in rows_))
    seen = []

    def extract(df):
        seen.append(df.count())
        return df.selectExpr("path", "hash", "length(content) as size")

    run = lambda **more: index.stream_index(spark, str(drops), str(snap), str(tmp_path / "ck"), shards=16, extract=extract, **more).awaitTermination(120)
    put("0.json", [(f"p{i}", f"text {i}", 1) for i in range(100)])
    run()
    first = {x.name for x in (snap / "data").iterdir()}
    put("1.json", [("p7", "another text", 2), ("p8", "text 8", 2), ("p9", "older", 0)])
    run()
    (second,) = {x.name for x in (snap / "data").iterdir()} - first
    assert len(list((snap / "data" / second).glob("shard=*"))) == 1 and len(list((snap / "data" / next(iter(first))).glob("shard=*"))) > 10
    assert seen == [100, 1]
    now = {r.path: r.version for r in current_snapshot(spark, str(snap)).collect()}
    assert len(now) == 100 and now["p7"] == 2 and now["p8"] == 1
    facts = {r.path: r["size"] for r in index.current_facts(spark, str(snap)).collect()}
    assert len(facts) == 100 and facts["p7"] == len("another text")
    (snap / "data" / "2-lost" / "shard=3").mkdir(parents=True)  # shards without a manifest
    (snap / "batch-2").mkdir()
    assert len(current_snapshot(spark, str(snap)).collect()) == 100
    put("2.json", [("p7", "last", 3), ("new", "x", 1)])
    run(keep=1)
    now = {r.path: r.version for r in current_snapshot(spark, str(snap)).collect()}
    assert len(now) == 101 and now["p7"] == 3 and {x.name for x in snap.glob("batch-*")} == {"batch-2"}


def test_steps_by_event_time(spark, tmp_path):
    """Out of order and late rows, owners that close at different times and one that comes back; equal to the batch operator."""
    from assetloom.operators import graph

    steps, out = tmp_path / "steps", str(tmp_path / "out")
    steps.mkdir()
    batches = [
        [(1, "2024-01-02T10:00:00Z", 5, "view"), (1, "2024-01-02T08:00:00Z", 9, "click"), (2, "2024-01-02T00:00:00Z", 4, "view"), (2, "2024-01-02T00:00:00Z", 3, "buy"), (1, "2024-01-02T07:00:00Z", 1, "noise")],
        [(1, "2024-01-02T09:00:00Z", 2, "view"), (1, "2024-01-02T10:30:00Z", 6, "click"), (3, "2024-01-04T00:00:00Z", 7, "view")],  # earlier than the first batch's, within the delay
        [(1, "2024-01-01T00:00:00Z", 0, "buy"), (3, "2024-01-04T01:00:00Z", 8, "buy"), (None, "2024-01-05T00:00:00Z", 0, "end")],  # too late: the watermark stands at the third of January
        [(1, "2024-01-09T00:00:00Z", 10, "view"), (None, "2024-01-20T00:00:00Z", 0, "end")],
        [(None, "2024-02-20T00:00:00Z", 0, "end")],
    ]
    for i, b in enumerate(batches):
        (steps / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("owner", "ts", "ord", "kind"), r))) for r in b))
        stream_steps(spark, str(steps), out, str(tmp_path / "ck2"), idle_hours=12, drop_kinds=("noise",)).awaitTermination(60)
    got = rows(spark.read.parquet(out), "owner", "ord", "kind", "rank")
    assert got == [(1, 2, "view", 2), (1, 9, "click", 1), (1, 10, "view", 1), (2, 3, "buy", 1), (2, 4, "view", 2), (3, 7, "view", 1), (3, 8, "buy", 2)]
    kept = spark.createDataFrame([r for b in batches[:2] for r in b], "owner long, ts string, ord long, kind string").selectExpr("owner", "cast(ts as timestamp) ts", "ord", "kind", "kind as target")
    whole = graph.edges_sequence(kept.where("owner < 3"), ["noise"])
    assert rows(whole, "owner", "ord", "kind", "rank") == [r for r in got if r[0] < 3 and r[1] < 10]


def test_symbol_lines(spark):
    from assetloom.operators import extraction

    text = "x\nfn one() {\n  a\n}\n\nfn two(b) { }\nfn one() {again}\x01fn three() {\n}"
    assets = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "fn one() {}")], "id int, content string")
    got = extraction.extract_symbols(assets, {"function": r"fn ([a-z]+\([a-z]*\) \{[^}]*)\}"}, "id", clip=20)
    assert rows(got, "id", "ord", "start_line", "end_line", "signature", "name") == [
        (1, 0, 2, 4, "one() {", "one() { a"), (1, 1, 6, 6, "two(b) { ", "two(b) {"), (1, 2, 7, 7, "one() {again", "one() {again"), (1, 3, 7, 8, "three() {", "three() {"), (4, 0, 1, 1, "one() {", "one() {"),
    ]


def test_entity_map_deals_the_symbols_of_a_path(spark, monkeypatch):
    from assetloom import catalogue
    from assetloom.plans import blocks

    monkeypatch.setattr(blocks, "TASK_CHARS", 1000)
    out = catalogue.QUERIES["export_entity_map"](spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id())
    long = out.where(F.col("md").contains("Uses hooks")).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).where("n > 10")
    assert long.count() and long.agg(F.min("tasks")).first()[0] > 1


def test_entity_map_of_groups(spark):
    sy = spark.createDataFrame([("b", "p", "component"), ("a", "p", "hook"), ("c", "q", "component"), ("d", None, "component"), ("e", "p", None)], "name string, path string, type string")
    entries = spark.createDataFrame([("p", "h2"), ("p", "h1"), (None, "h3")], "path string, entry string")
    got = {r["name"]: r["md"] for r in src.entity_map_of_groups(sy, entries, "Uses hooks", F.col("type") == "component").collect()}
    head = "## {}\n\nFile:\n\n- {}\n"
    assert got == {"b": head.format("b", "p") + "\nUses hooks:\n\n- h1\n- h2\n", "a": head.format("a", "p"), "c": head.format("c", "q"), "e": head.format("e", "p")}


def test_symbol_hints_deal_the_queries_that_ask_the_same(spark, monkeypatch):
    from assetloom.plans import blocks

    monkeypatch.setattr(blocks, "TASK_CHARS", 200)
    syms = spark.range(40).selectExpr("concat('s', id) as symbol", "'Card' as name", "'component' as type", "concat('p', id % 2) as path", "id as ord")
    asked = spark.range(60).selectExpr("id as query_id", "if(id < 50, 'Card', if(id < 55, 'None', null)) as name", "'component' as type", "if(id % 2 = 0, cast(null as string), if(id < 40, 'p1', '')) as hint")
    got = resolution.resolve_symbol_hint(asked, syms).withColumn("task", F.spark_partition_id())
    even, odd = [f"s{i}" for i in range(0, 40, 2)], [f"s{i}" for i in range(1, 40, 2)]
    want = sorted((q, (odd if q % 2 and q < 40 else even)[0], 20 if q % 2 and q < 40 else 40, ",".join((odd if q % 2 and q < 40 else even + odd)[1:])) for q in range(50))
    assert rows(got, "query_id", "symbol", "n", "others") == want
    assert got.where("query_id % 2 = 0").select("task").distinct().count() > 1


def test_names_are_resolved_once(spark):
    """A source and name that all references share is resolved once, and the references aren't shuffled for it."""
    refs = spark.range(3000).selectExpr("id as ref_id", "if(id % 10 = 9, 'b', if(id % 10 = 8, null, 'a')) as source", "'f.run' as callee", "'f' as name")
    imports = spark.createDataFrame([("a", i, "f", "mod", "b") for i in range(50)], "source string, import_ord int, name string, module string, path string")
    symbols = spark.createDataFrame([("s1", "f", "component", "b", 1), ("s2", "f", "hook", "a", 2)], "symbol string, name string, type string, path string, ord int")
    found = resolution.resolve_render_target(refs, imports, symbols)
    assert "SortMergeJoin" not in found._jdf.queryExecution().optimizedPlan().toString() and found._jdf.queryExecution().toString().count("Exchange hashpartitioning") == 0
    got = {(r.symbol, r.how, r.n) for r in found.groupBy("symbol", "how").agg(F.count("*").alias("n")).collect()}
    assert got == {("s1", "imports", 2400), ("s1", "global", 600)}
    called = resolution.resolve_call_target(refs, imports, symbols)
    assert {(r.dst, r.kind, r.n) for r in called.groupBy("dst", "kind").agg(F.count("*").alias("n")).collect()} == {("s2", "internal", 2700), ("s1", "internal", 300)}


def test_few_expressions_bring_few_entries_together(spark, monkeypatch):
    """What finds 2,000 nodes isn't shuffled or met for four expressions: what they don't ask for is dropped first. A root with a piece that no label has finds nothing."""
    from assetloom.operators import resolution

    sent, real = [], resolution.few
    monkeypatch.setattr(resolution, "few", lambda df, n: sent.append(n) or real(df, n))
    empty = "array<string>"
    nodes = spark.range(2000).selectExpr("concat('n', id) as node", "id as ord", "'data-fetch' as type", "concat('ORDER#', id) as label", "concat('FETCH#', id) as name", "array(concat('o', id)) as outputs", f"cast(array() as {empty}) as reads", "cast(array() as array<struct<name: string, source: string>>) as inputs", "cast(null as string) as expression")
    asked = spark.createDataFrame([("a", "o17.status"), ("b", "R#199"), ("c", "ORDER#xyz"), ("d", "#3")], "expr_id string, expression string")
    got = resolution.resolve_expression(asked, resolution.expression_lookup(nodes))
    assert sorted((r.expr_id, r.node) for r in got.collect()) == [("a", "n17"), ("b", "n199"), ("d", "n3")]
    assert sent == [8, 12, 2]


def test_symbol_hints_list_a_path_once(spark, monkeypatch):
    """The symbols of a name are listed by path, not for each of its hints; nulls and ties are as in one list."""
    import random

    rng = random.Random(3)
    syms = [(rng.choice(["s%d" % i, "s%d" % i, None]), rng.choice("ab"), "k", rng.choice(["p1", "p2", "up1", "p11", None]), rng.choice([None, i % 9])) for i in range(120)]
    asked = [(i, rng.choice("abc"), "k", rng.choice([None, "", "p1", "1", "p", "x"])) for i in range(60)]
    written, real = [], resolution.saved
    monkeypatch.setattr(resolution, "saved", lambda df: written.append(real(df)) or written[-1])
    got = resolution.resolve_symbol_hint(spark.createDataFrame(asked, "query_id int, name string, type string, hint string"), spark.createDataFrame(syms, "symbol string, name string, type string, path string, ord int"))
    none_first = lambda x: (x is not None, x or 0 if isinstance(x, int) else x or "")
    want = []
    for q, name, _, hint in asked:
        fit = [(0 if p == hint and hint is not None else 1 if hint is not None and p.endswith(hint) else 2, none_first(p), (o is not None, o or 0), none_first(s)) for s, n, _, p, o in syms if n == name and (hint is None or (p is not None and hint in p))]
        names = [x[3][1] if x[3][0] else None for x in sorted(fit)]
        if names:
            want.append((q, names[0], len(names), ",".join(x for x in names[1:] if x is not None)))
    assert sorted(map(tuple, got.select("query_id", "symbol", "n", "others").collect()), key=repr) == sorted(want, key=repr)
    assert [x.count() for x in written] == [len({(n, p) for _, n, _, p, _ in syms})]


def test_long_texts_are_sent_in_a_bounded_number_of_blocks(spark, monkeypatch):
    """What is sent of the texts grew with rows times text; it is bounded by the number of blocks, and the result is the same."""
    from assetloom.plans import blocks

    monkeypatch.setattr(blocks, "TASK_CHARS", 100)
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 8)
    rows_ = spark.range(3000).selectExpr("id", "id % 3 as key")
    texts = spark.range(3).selectExpr("id as key", "repeat(cast(id as string), 50) as text")
    out = blocks.with_text(rows_, texts, ["key"], "text")
    assert out.where("text = repeat(cast(key as string), 50)").count() == 3000 == out.count()
    assert 2 < out.select(F.spark_partition_id()).distinct().count() <= 11
