import random

from assetloom.operators import search


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_pieces_find_what_a_scan_finds(spark):
    rng = random.Random(5)
    texts = [(i, i % 3, "".join(rng.choice("abAB é") for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(900, 0, None), (901, 0, "")]
    terms = ["a", "ab", "aba", "abab", "É", " b", "x", "  ", "", None, "aaaaaaaaaaaaaaaaaaaa"] + ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    catalog = spark.createDataFrame(texts, "id long, rank_key int, text string")
    queries = spark.createDataFrame(list(enumerate(terms)), "query_id int, query string")
    want = []
    for q, t in enumerate(terms):
        t = (t or "").strip(" ").lower()
        hits = sorted((k, i) for i, k, x in texts if t and t in (x or "").lower())
        want += [(q, n, i) for n, (_, i) in enumerate(hits[:30], 1)]
    got = search.search_targets(catalog, queries)
    assert rows(got, "query_id", "rank", "id") == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    index = search.piece_index(catalog)
    assert rows(search.search_targets(catalog, queries, index=index), "query_id", "rank", "id") == sorted(want, key=repr)
    changed, gone = spark.createDataFrame([(1, "new words"), (999, "abc")], "id long, text string"), spark.createDataFrame([(2,)], "id long")
    later = catalog.select("id", "text").where("id not in (1, 2)").unionByName(changed)
    assert rows(search.update_index(index, changed, gone), "piece", "id") == rows(search.piece_index(later), "piece", "id")


def test_search_graph_scopes(spark):
    corpus = spark.createDataFrame([("route", 0, "r1", "Pricing page"), ("file", 1, "r1", "pricing"), ("file", 1, "f2", "the pricing table"), ("file", 1, "f3", "none")], "kind string, kind_rank int, id string, text string")
    queries = spark.createDataFrame([(1, "PRICING", None), (2, "pricing", "file"), (3, "absent", None)], "query_id int, query string, scope string")
    assert rows(search.search_graph(corpus, queries), "query_id", "rank", "kind", "id") == [(1, 1, "route", "r1"), (1, 2, "file", "f2"), (2, 1, "file", "f2"), (2, 2, "file", "r1")]


def test_retrieval_of_a_hub_in_parts(spark):
    nodes = spark.createDataFrame([("c:Hub", "component", "Hub", "hub.tsx", 1, 2)] + [(f"c:{i}", "component", f"C{i}", "gone.tsx", 1, 1) for i in range(3)], "node string, type string, label string, path string, start int, end int")
    edges = spark.createDataFrame([("renders", "c:Hub", f"c:{i}", i) for i in range(12_000)], "type string, src string, dst string, k long")
    assets = spark.createDataFrame([("hub.tsx", "one\ntwo\nthree")], "path string, content string")
    files = spark.createDataFrame([("/a", "hub.tsx")], "route string, asset string")
    requests = spark.createDataFrame([(1, "component_trace", "Hub"), (2, "hook_trace", "Hub"), (3, "route_trace", "a"), (4, "poem", "x"), (5, None, None)], "query_id int, intent string, target string")
    got = search.retrieval(requests, nodes, edges, assets, files)
    assert got.where("query_id = 1 and section = 'edges'").count() == 12_000 == got.where("query_id = 3 and section = 'edges'").count()
    assert rows(got.where("section = 'snippets'"), "query_id", "value") == [(q, "### hub.tsx:1-2\n\n```tsx\none\ntwo\n```") for q in (1, 3)]
    assert rows(got.where("section = 'warnings'"), "query_id", "value") == [(1, "- gone.tsx can't be read"), (2, "- Hub not found"), (4, "- intent poem isn't supported"), (5, "- intent none isn't supported")]
    parts = search.retrieval_document(requests, got).collect()
    whole = {q: "\n\n".join(r.text for r in sorted(parts, key=lambda r: r.part) if r.query_id == q) for q in range(1, 6)}
    assert max(r.text.count("\n") for r in parts) < search.PART and whole[1].count("--renders-->") == 12_000
    order = ["# Code Trace Context", "## Intent", "## Target", "## Symbols", "- Hub\n  - id: c:Hub", "## Graph Edges", "## Source Snippets", "## Warnings"]
    assert [whole[1].index(x) for x in order] == sorted(whole[1].index(x) for x in order) and whole[4].endswith("## Warnings\n\n- intent poem isn't supported")
    assert whole[5].startswith("# Code Trace Context\n\n## Intent\n\nunknown\n\n## Target\n\nunknown\n\n## Symbols\n\n- none")


def test_pieces_of_long_texts_take_time_in_proportion(spark, monkeypatch):
    """Finding each character anew took the square of the length: 400,000 characters, minutes."""
    import time

    text = "é" * 50_000 + "".join(chr(97 + i * i % 26) for i in range(350_000)) + "the end"
    catalog = spark.createDataFrame([(1, 0, text), (2, 0, "end")], "id long, rank_key int, text string")
    queries = spark.createDataFrame([(1, "éa"), (2, "the end"), (3, "xyzzy"), (4, "END")], "query_id int, query string")
    for bound in (64, 0):
        monkeypatch.setattr(search, "FEW_PIECES", bound, raising=False)
        began = time.time()
        assert rows(search.search_targets(catalog, queries), "query_id", "rank", "id") == [(1, 1, 1), (2, 1, 1), (4, 1, 1), (4, 2, 2)]
        assert time.time() - began < 30


def test_random_terms_by_a_search_for_few_pieces_and_by_an_index(spark, monkeypatch):
    rng = random.Random(8)
    texts = [(i, "file" if i % 2 else "route", i % 2, "".join(rng.choice("abA é😀") for _ in range(rng.randint(0, 9)))) for i in range(100)]
    corpus = spark.createDataFrame(texts, "id long, kind string, kind_rank int, text string")
    terms = [(i, "".join(rng.choice("ab é😀") for _ in range(rng.randint(1, 4))), "file" if i % 3 == 0 else None) for i in range(30)]
    queries = spark.createDataFrame(terms, "query_id int, query string, scope string")
    want = []
    for q, term, scope in terms:
        t = term.strip(" ").lower()
        hits = sorted((r, i, k) for i, k, r, x in texts if t and t in x.lower() and scope in (None, k))
        want += [(q, n, k, i) for n, (r, i, k) in enumerate(hits[:40], 1)]
    for bound in (64, 0):
        monkeypatch.setattr(search, "FEW_PIECES", bound, raising=False)
        assert rows(search.search_graph(corpus, queries), "query_id", "rank", "kind", "id") == sorted(want, key=repr)


def test_retrieval_document_agrees_with_its_sql_in_parts_and_buckets(spark, tmp_path):
    import shutil

    import duckdb

    from assetloom import catalogue

    db, small = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("nation", "region", "orders", "customer", "supplier", "lineitem"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path)
    kept = f"SELECT * FROM '{small}/customer.parquet' WHERE c_custkey < 100 UNION ALL SELECT 101 + 2 * i, 'more' || i, 3, 0, 'x' FROM range(5200) r(i)"
    db.execute(f"COPY (SELECT c_custkey::BIGINT AS c_custkey, c_name, 3::INTEGER AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment FROM ({kept})) TO '{tmp_path}/more.parquet'")
    shutil.copy(f"{tmp_path}/more.parquet", f"{tmp_path}/customer.parquet")
    for t in ("nation", "region", "orders", "customer", "supplier", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["retrieval_document"](spark, str(tmp_path)).collect()))
    assert got == sorted(db.execute(catalogue.ORACLE_SQL["retrieval_document"]).fetchall())
    assert max(part for _, part, _ in got) > 15


def test_context_of_hubs_is_found_without_their_expansion(spark):
    rng = random.Random(3)
    edges = [(rng.choice("ab"), f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 40)}", k) for k in range(150)]
    e = spark.createDataFrame(edges, "type string, src string, dst string, k long")
    nodes = spark.range(41).selectExpr("concat('n', id) as node", "'x' as label", "'y' as path")
    roots = spark.range(41).selectExpr("concat('n', id) as root")
    want = []
    for depth, limit in ((1, 3), (2, 4)):
        for r in (f"n{i}" for i in range(41)):
            inner = {r}
            for _ in range(depth - 1):
                inner |= {d for _, s, d, _ in edges if s in inner} | {s for _, s, d, _ in edges if d in inner}
            first = {}
            for kind, s, d, k in edges:
                if s in inner or d in inner:
                    for x in (s, d):
                        first[x] = min(first.get(x, (kind, k)), (kind, k))
            want += [(depth, r, i, x) for i, x in enumerate(sorted(first, key=lambda x: (x != r, first[x], x))[:limit], 1)]
    got = [(depth, *x) for depth, limit in ((1, 3), (2, 4)) for x in rows(search.retrieve_context(nodes, e, roots, depth, limit), "root", "ord", "node")]
    assert sorted(got) == sorted(want)


def test_context_leaves_edges_at_other_nodes_where_they_are(spark, monkeypatch):
    """Of 20,000 edges, those at the nodes around two roots are brought together or written; all were before."""
    from assetloom.plans import frontier

    written, real = [], search.saved

    def counted(df):
        frame = real(df)
        written.append(frame.count())
        return frame

    monkeypatch.setattr(search, "saved", counted)
    monkeypatch.setattr(frontier, "saved", counted)
    edges = spark.range(20_000).selectExpr("'e' as type", "concat('n', id) as src", "concat('n', id + 1) as dst", "id as k")
    nodes = spark.range(20_001).selectExpr("concat('n', id) as node", "'x' as label", "'y' as path")
    roots = spark.createDataFrame([("n7",), ("n100",)], "root string")
    got = search.retrieve_context(nodes, edges, roots, 2, 3)
    assert rows(got, "root", "ord", "node") == [("n100", 1, "n100"), ("n100", 2, "n98"), ("n100", 3, "n99"), ("n7", 1, "n7"), ("n7", 2, "n5"), ("n7", 3, "n6")]
    assert max(written) < 20
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def _random_requests(spark, n_edges):
    """A hub, edges in both directions, parallel and equal ones, loops, and requests that meet an edge at both ends."""
    rng = random.Random(12)
    edges = [(rng.choice("ab"), f"c{rng.randint(0, 9)}", f"c{rng.randint(0, 9)}", k % 70) for k in range(80)] + [("a", "c0", f"c{rng.randint(10, 400)}", k) for k in range(n_edges)]
    edges += edges[:20] + [("a", None, "c3", 1), ("b", "c4", None, 2)]
    e = spark.createDataFrame(edges, "type string, src string, dst string, k long")
    nodes = spark.createDataFrame([(f"c{i}", "component" if i % 3 else "hook", f"N{i // 2}", f"f{i % 7}.tsx", 1, 2) for i in range(401)], "node string, type string, label string, path string, start int, end int")
    assets = spark.createDataFrame([(f"f{i}.tsx", f"one {i}\ntwo\nthree") for i in range(6)], "path string, content string")
    files = spark.createDataFrame([("/a", "f1.tsx"), ("/b", "f6.tsx")], "route string, asset string")
    asked = [(q, ("component_trace", "hook_trace", "route_trace", "other")[q % 4], ("a", "b", "x")[q % 3] if q % 4 == 2 else f"N{q % 12}") for q in range(30)] + [(99, None, None)]
    return spark.createDataFrame(asked, "query_id int, intent string, target string"), nodes, e, assets, files, edges


def test_retrieval_sends_nodes_to_edges(spark, monkeypatch):
    """Rows of requests times edges were brought together to be made distinct; no step after the join does so now."""
    *tables, edges = _random_requests(spark, 2000)
    got = search.retrieval(*tables)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = rows(got, "query_id", "section", "ord", "subject", "value")
    label = {f"c{i}": ("component_trace" if i % 3 else "hook_trace", f"N{i // 2}") for i in range(401)}
    want = []
    for q, intent, target in tables[0].collect():
        at = set([min((n for n, x in label.items() if x == (intent, target)), default=None)] if intent in ("component_trace", "hook_trace") else [])
        at |= {d for _, s, d, _ in edges if s in at and s and d} | {s for _, s, d, _ in edges if d in at and s and d}
        if intent == "route_trace":
            at = {f"c{i}" for i in range(401) if f"f{i % 7}.tsx" == {"a": "f1.tsx", "b": "f6.tsx"}.get(target)}
        want += [(q, k, s) for t, s, d, k in {x for x in edges if x[1] in at - {None} or x[2] in at - {None}}]
    assert sorted(((r[0], r[2], r[3]) for r in found if r[1] == "edges"), key=repr) == sorted(want, key=repr) and len(want) > 10_000
    monkeypatch.setattr(search, "FEW", 0)
    assert rows(search.retrieval(*tables), "query_id", "section", "ord", "subject", "value") == found


def test_documents_are_those_of_the_rows(spark, monkeypatch):
    """The parts of a request's edges are made where they are joined, in several groups of requests; the texts of all parts were shuffled and numbered."""
    *tables, _ = _random_requests(spark, 6000)
    want = rows(search.retrieval_document(tables[0], search.retrieval(*tables)), "query_id", "part", "text")
    assert max(part for _, part, _ in want) > 15
    for few, size in ((200_000, 1 << 19), (200_000, 5000), (0, 20_000)):
        monkeypatch.setattr(search, "FEW", few)
        monkeypatch.setattr(search, "TASK_EDGES", size)
        got = search.retrieved_documents(*tables)
        assert rows(got, "query_id", "part", "text") == want
    from assetloom import catalogue

    plan = catalogue.QUERIES["retrieval_document"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
