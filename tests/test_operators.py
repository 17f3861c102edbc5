import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from seamline.functions import text as T
from seamline.functions.providers import provider
from seamline.operators import edges, evaluate, graph, incremental, orphans, parsers, snapshot, versions
from seamline.plans import settings as S
from seamline.plans.indexing import Index
from seamline.sources import rows, tree
from seamline.streaming import logs


def test_runs_and_orphans(spark):
    parents = [("file", k, None) for k in [1, 2, 3, 7, 65535, 65536, 65537, 70000]] + [("memory", 5, None)]
    p = spark.createDataFrame(parents * 2, "kind string, key long, first_seen timestamp_ntz")
    runs = {(r.kind, r.run_start, r.run_end) for r in orphans.key_runs(p).collect()}
    assert runs == {("file", 1, 3), ("file", 7, 7), ("file", 65535, 65535), ("file", 65536, 65537), ("file", 70000, 70000), ("memory", 5, 5)}
    refs = [(i, "to", "file", k, None) for i, k in enumerate([0, 1, 3, 4, 6, 7, 8, 65534, 65538, 70000, 70001, -5])] * 3
    r = spark.createDataFrame(refs, "edge_id long, side string, kind string, key long, made_at timestamp_ntz")
    dead = spark.createDataFrame([("file", 4), ("file", 7), ("file", None)], "kind string, key long")
    got = {(x.key, x.state) for x in orphans.orphan_references(r, p, dead).collect()}
    assert got == {(k, "missing") for k in (0, 6, 8, 65534, 65538, 70001, -5)} | {(4, "deleted")}
    none = p.limit(0)
    assert {x.state for x in orphans.orphan_references(r, none, dead).collect()} == {"missing", "deleted"}
    assert orphans.orphan_references(r.limit(0), p, dead).count() == 0


def test_late_and_hot_key(spark):
    p = spark.createDataFrame([("file", 1, 100)], "kind string, key long, t long").select("kind", "key", F.timestamp_seconds("t").cast("timestamp_ntz").alias("first_seen"))
    r = spark.createDataFrame([(i, "to", "file", 1, t) for i, t in enumerate([50, 100, 150, None] * 300)], "edge_id long, side string, kind string, key long, t long")
    r = r.select("edge_id", "side", "kind", "key", F.timestamp_seconds("t").cast("timestamp_ntz").alias("made_at"))
    dead = spark.createDataFrame([], "kind string, key long")
    out = orphans.orphan_references(r, p, dead).collect()
    assert len(out) == 300 and {x.state for x in out} == {"late"} and all(x.edge_id % 4 == 0 for x in out)


def test_pending(spark):
    files = spark.createDataFrame([(1, "AB12", 1), (1, "cd", 2), (2, None, 1), (3, "ee", 1), (4, "ff", 1), (5, "aa", None), (None, "x", 1)] * 2, "id long, checksum string, indexed_at int")
    state = spark.createDataFrame([(1, 1, "sha256: CD ", 5), (2, 1, "zz", 9), (1, 3, "ee", 1), (2, 3, "dd", 2), (1, 4, "ff", 1), (1, 4, "old", 0), (1, 9, "gone", 1)], "run_id long, file_id long, checksum string, processed_at int")
    runs = spark.createDataFrame([(1, " Succeeded"), (2, "failed")], "run_id long, status string")
    got = {(r.file_id, r.reason) for r in incremental.pending_files(files, state, runs).collect()}
    assert got == {(2, "unknown"), (5, "new")}
    assert incremental.pending_files(files.limit(0), state, runs).count() == 0
    assert {r.file_id for r in incremental.pending_files(files, state.limit(0), runs).collect()} == {1, 2, 3, 4, 5}


def rows_of(spark, *pairs):
    return incremental.content_hash(spark.createDataFrame(list(pairs), "key string, v string"), ["v"])


def test_state_store_survives_failures(spark, tmp_path, monkeypatch):
    store = incremental.StateStore(spark, str(tmp_path / "state"), "key")
    v1 = rows_of(spark, ("a", "1"), ("b", None), ("b", None), (None, "x"))
    todo = store.changed(v1)
    assert {(r.key, r.change) for r in todo.collect()} == {("a", "new"), ("b", "new")} and store.version() == 0
    for step in ("_claim", "_swap"):  # a run that dies before the claim, and one before any state is written
        with monkeypatch.context() as m:
            m.setattr(store, step, lambda *a: (_ for _ in ()).throw(OSError("died")))
            with pytest.raises(OSError):
                store.commit(todo, output=todo)
        assert store.version() == 0 and store.changed(v1).count() == 2 and store.outputs() is None
    assert store.commit(todo) == 1
    v2 = rows_of(spark, ("a", "1"), ("b", ""), ("c", "3"))
    assert {(r.key, r.change) for r in store.changed(v2).collect()} == {("b", "changed"), ("c", "new")}
    store.commit(store.changed(v2))
    assert store.changed(v2).count() == 0 and store.version() == 2
    assert store.read(1).count() == 2 and store.read().count() == 3
    assert store.vacuum(1) >= 1 and store.read().count() == 3
    nothing = spark.createDataFrame([("a", None, {"x": 1})], "key string, content_hash string, extra map<string,int>")
    assert [r.change for r in store.changed(nothing).collect()] == ["unknown"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = (incremental.StateStore(spark, str(tmp_path / "state"), "key", buckets=2) for _ in "ab")
    plain_claim, raced = b._claim, []

    def late(version, manifest):
        if not raced:  # the other writer commits between this one's merge and its claim
            raced.append(version)
            a.commit(rows_of(spark, ("k1", "1")))
        return plain_claim(version, manifest)

    monkeypatch.setattr(b, "_claim", late)
    assert b.commit(rows_of(spark, ("k2", "2"))) == 2 and raced == [1]
    assert {r.key for r in a.read().collect()} == {"k1", "k2"} == {r.key for r in b.read().collect()}
    with pytest.raises(incremental.VersionTaken):
        a._claim(2, {"buckets": {}, "output": None, "epochs": {}})
    assert {r.key for r in a.read().collect()} == {"k1", "k2"}
    assert not [n for n in os.listdir(tmp_path / "state") if n.startswith(".draft")]


def test_index_flow(spark, tmp_path):
    root = tmp_path / "repo"
    texts = {
        "app/__init__.py": "", "app/worker.py": "import app.service\n\ndef run(queue):\n    return service.retry_snapshot(queue)\n", "app/service.py": "class Retry:\n    def again(self, n):\n        return n\n\ndef retry_snapshot(queue):\n    return queue\n",
        "tests/test_service.py": "import app.service\n", "docs/adr-retry.md": "# Retry\n\nThe retry_snapshot stays.\n", "config/retry.toml": '[retry]\nmodule = "app.service"\nlimit = 3\n', ".venv/x/y.py": "z = 1", "inner/repo/a.py": "b = 2",
    }

    def put(path, text):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)

    for p, t in texts.items():
        put(p, t)
    index = Index(spark, str(tmp_path / "index"), provider(16))
    rid = index.add_repo("demo", str(root))
    index.add_repo("inner", str(root / "inner/repo"))
    with pytest.raises(ValueError):
        index.add_repo("demo", "/elsewhere")
    with pytest.raises(ValueError):
        index.repo("none")
    assert index.index_repo("demo") == {"repo": "demo", "indexed": 6, "skipped": 0, "discovered": 6}
    kinds = {r.edge_type: r["count"] for r in index.table("edges").groupBy("edge_type").count().collect()}
    assert set(kinds) == {"FILE_CONTAINS_SYMBOL", "FILE_IMPORTS_FILE", "TEST_COVERS_SYMBOL", "DOC_DESCRIBES_SYMBOL", "DOC_DESCRIBES_FILE", "CONFIG_AFFECTS_FILE"} and kinds["FILE_IMPORTS_FILE"] == 2 and kinds["FILE_CONTAINS_SYMBOL"] == 4
    ids = {r.qualified_name: (r.id, r.parent_symbol_id) for r in index.table("symbols").collect()}
    assert ids["Retry.again"][1] == ids["Retry"][0] and set(ids) == {"run", "Retry", "Retry.again", "retry_snapshot"}
    made = index.create_memories(spark.createDataFrame([(rid, "T", "why it retries", "decision")], "repo_id long, title string, content string, memory_type string"))
    links = [("symbol", ids["Retry"][0]), ("symbol", ids["run"][0])]
    index.link_memories(made.select(F.col("id").alias("from_memory_id")).crossJoin(spark.createDataFrame(links, "to_node_kind string, to_node_id long")))
    # one file changes, one goes, one is broken
    put("app/service.py", "def retry_snapshot(queue, n):\n    return n\n")
    (root / "docs/adr-retry.md").unlink()
    put("app/broken.py", "def (")
    before = index.version()
    assert index.index_repo("demo") == {"repo": "demo", "indexed": 2, "skipped": 4, "discovered": 6}
    assert {r.qualified_name for r in index.table("symbols").collect()} == {"run", "retry_snapshot"} and index.table("symbols", version=before).count() == 4
    own = index.table("edges").where("edge_type = 'APPLIES_TO'").collect()
    assert [(r.to_node_id, r.repo_id, r.weight) for r in own] == [(ids["run"][0], rid, 1.0)]  # the link to the symbol that is gone went with it
    assert {r.path: r.error for r in index.table("files").collect() if r.error} == {"app/broken.py": "SyntaxError: invalid syntax (<unknown>, line 1)"}
    nodes = {(r.node_kind, r.node_id) for r in index.table("node_embeddings").collect()}
    assert nodes == {("file", r.id) for r in index.table("files").collect()} | {("symbol", r.id) for r in index.table("symbols").collect()} | {("memory", r.id) for r in made.collect()}
    again = index.index_repo("demo")
    assert (again["indexed"], again["skipped"]) == (0, 6)
    # a run that began before another one committed changes nothing
    with pytest.raises(versions.VersionTaken):
        index.commit({"files": (index.table("files"), [rid])}, base=before)
    remote = provider(4, client=lambda: lambda texts: [[float(len(t)), 0, 0, 0] for t in texts], model_name="far")
    counts = index.reconcile_embeddings(remote)
    assert counts["final_embedding_count"] == len(nodes) and {(r.model_name, len(r.vector), r.dimensions) for r in index.table("node_embeddings").collect()} == {("far", 4, 4)}


def bfs(adj, start, lim, hops):
    queue, seen, out = deque([(start, 0)]), {start}, []
    while queue and len(out) < lim:
        node, h = queue.popleft()
        if h >= hops:
            continue
        for e, a, b in sorted(x for x in adj if node in x[1:])[:lim]:
            to = b if a == node else a
            if to not in seen:
                seen.add(to)
                out.append((to, h + 1))
                queue.append((to, h + 1))
    return out


def test_traverse_equals_queue(spark):
    rng = random.Random(3)
    all_edges, starts, want = [], [], {}
    eid = 0
    for g in range(25):
        adj = []
        for _ in range(rng.randint(2, 14)):
            a, b = (g * 100 + rng.randint(0, 6) for _ in range(2))
            adj.append((eid, a, b))
            eid += 1
        all_edges += adj
        lim, hops = rng.randint(1, 6), rng.randint(1, 2)
        starts.append((g, "file", g * 100, None, lim, hops))
        want[g] = bfs(adj, g * 100, lim, hops)
    e = spark.createDataFrame([(i, "file", a, "file", b, "T") for i, a, b in all_edges] * 2, "id long, fk string, fid long, tk string, tid long, edge_type string")
    s = spark.createDataFrame(starts, "sid long, nk string, nid long, types array<string>, lim int, hops int")
    got = {}
    for r in graph.traverse(e, s).orderBy("sid", "ord").collect():
        got.setdefault(r.sid, []).append((r.id, r.hops))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("mode", [*S.MODE_WEIGHTS, "unknown"])
def test_mixes(mode):
    for flags in [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]:
        for limit in (1, 4, 6, 8, 12, 30):
            mix = S.select_mix(mode, *flags, limit)
            least = (2, *(min(1, n) for n in mix[1:]))
            assert sum(mix) <= limit or mix == least
        assert sum(S.pack_mix(mode, *flags)) <= 8
    assert S.select_mix("docs", True, False, False, 12) == (2, 1, 3, 2)
    assert S.pack_mix("architecture", False, True, True) == (2, 2, 2 + 1, 1 + 1)[:4] or sum(S.pack_mix("architecture", False, True, True)) <= 8


def test_query_terms(spark):
    text = "Queries, INDEXING stopped because caches_x of the " + " ".join(f"word{i}" for i in range(250))
    r = spark.createDataFrame([(text,), ("of the",), ("",)], "t string").select(T.query_terms("t").alias("x")).collect()
    assert {"queries", "query", "querie", "indexing", "index", "indexings", "stopped", "stopp", "caches_x"} <= set(r[0].x)
    assert "because" not in r[0].x and len(r[0].x) <= 240 and r[1].x == ["of the", "of thes"] and r[2].x == []


def test_parsers(spark):
    py = 'import a.b\nfrom m import x\nfrom . import z\nclass C:\n    "doc"\n    def m(self, q, /, r, *s, k=1):\n        return q.some_name\nasync def f(a):\n    return g(" Two Words ", a)\n'
    ts = "import { a } from './a';\n\nexport function go(a, b) {\n}\nexport const LIMIT = 3;\n  class K {}\n// This class that wraps a function call(x) is old.\n"
    df = spark.createDataFrame([(1, "x/a.py", py), (2, "b.ts", ts), (3, "c.py", "def ("), (4, "README.md", "\n# Title of it\n"), (5, "e.py", None), (6, None, ""), (7, "d/n.yaml", "###\nx: 1"), (8, "e.JSX", ts)], "file_id long, path string, text string")
    out = {r.file_id: r for r in parsers.parse_files(df).collect()}
    line = lambda r: [(s.name, s.symbol_type, s.line_start, s.line_end, s.signature, s.docstring, s.qualified_name, s.parent_name, s.summary) for s in r.symbols]
    assert line(out[1]) == [
        ("C", "class", 4, 7, None, "doc", "C", None, "Python class C"),
        ("m", "method", 6, 7, "def m(r)", None, "C.m", "C", "Python callable m using some_name"),
        ("f", "function", 8, 9, "async def f(a)", None, "f", None, "Python callable f using two_words"),
    ]
    assert out[1].imports == ["a.b", "m"] and out[1].summary == "Python module a.py with 3 top-level symbols and 2 imports. Key symbols: C, m, f. Keywords: python, class, callable, using, some, name."
    assert line(out[2]) == [
        ("go", "function", 2, 5, "function go(a, b)", None, "go", None, "Typescript function go"),
        ("K", "class", 6, 7, "class K", None, "K", None, "Typescript class K"),
        ("LIMIT", "exported_constant", 5, 7, "const LIMIT", None, "LIMIT", None, "Typescript exported_constant LIMIT"),
    ]
    assert out[2].imports == ["./a"] and out[2].summary == "Typescript module b.ts with 3 exported symbols." and out[8].summary == "Javascript module e.JSX with 3 exported symbols."
    assert out[3].error.startswith("SyntaxError") and out[3].symbols == [] and out[4].summary == "Markdown document README.md: Title of it"
    assert out[5].summary == "Python module e.py with 0 top-level symbols and 0 imports." and out[6].summary == "Unknown document : " and out[7].summary == "Yaml document n.yaml: " and len(out) == 8


def test_source_tree(spark, tmp_path):
    for path, text in {"app/__init__.py": "", "app/deep/er/x.py": "x", ".hidden/y.py": "y", "README.md": "r", "node_modules/z/i.py": "n", "app/bad.py": b"a\xffb"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    tree.register(spark)
    df = spark.read.format("source_tree").option("include", "**/*.py,**/*.md").option("exclude", "node_modules/**").load(str(tmp_path))
    got = {r.path: r for r in df.collect()}
    # the globs are those of the queries: **/ asks for a folder, so files at the root need a glob of their own
    assert set(got) == {"app/__init__.py", "app/deep/er/x.py", ".hidden/y.py", "app/bad.py"}
    assert got["app/bad.py"].text == "ab" and got["app/__init__.py"].length == 0
    root = spark.read.format("source_tree").option("include", "*.md").load(str(tmp_path))
    assert [r.path for r in root.collect()] == ["README.md"]
    globs = ["**/*.py", "*.py", "a?c/[!x]*.md", "x+y/**"]
    paths = ["a.py", "b/a.py", "abc/y.md", "abc/x.md", "x+y/z", "xxy/z"]
    for g in globs:
        by_spark = {r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").where(F.col("p").rlike(T.glob_regex(g))).collect()}
        assert by_spark == {p for p in paths if tree.included(p, [g], [])}
    assert tree.git_head(str(tmp_path)) == (None, None)


def test_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 5}\n')
    (tmp_path / "c.csv").write_text('x,y\n1,"a\nb"\n')
    assert [rows.load_rows(spark, str(tmp_path / n)).count() for n in ("a.json", "b.jsonl", "c.csv")] == [2, 2, 1]
    with pytest.raises(ValueError):
        rows.load_rows(spark, "d.xml")


def test_snapshot(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, d string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "x")], "k long, d string")
    assert {(r.k, r.change) for r in snapshot.diff(new, old, ["k"], "d").collect()} == {(1, "removed"), (2, "changed"), (3, "same"), (4, "added")}
    assert sorted(tuple(r) for r in snapshot.upsert(old, new, ["k"]).collect() if r.d) == [(1, "a"), (2, "c"), (4, "x")]
    repos = spark.createDataFrame([(1, "/r"), (2, "/r/in/ner"), (3, "/s/")], "id long, local_path string")
    files = spark.createDataFrame([(1, "/r/a.py"), (1, "/r/in/ner/b.py"), (1, "/r/in/nerves/c.py"), (2, "/r/in/ner/b.py"), (3, "/s/x")], "repo_id long, full_path string")
    assert snapshot.outside_nested(files, repos).count() == 4


def test_gold(spark):
    items = spark.createDataFrame([("i", '[{"file": ".\\\\a/b.py", "start_line": 1, "end_line": 4}]'), ("n", None), ("z", "broken")], "instance_id string, gold_context string")
    g = evaluate.gold_spans(items)
    assert [(r.file, r["first"], r["last"]) for r in g.collect()] == [("a/b.py", 1, 4)]
    spans = spark.createDataFrame([("a/b.py", 4, 9), ("a/b.py", 2, 3), ("c", 1, 9)], "file string, low int, high int")
    assert evaluate.span_hits(g, spans).count() == 1
    gold = spark.createDataFrame([(1, "a", 1, 4), (1, "a", 9, 9), (1, "b", None, 3), (2, "a", 1, 2), (3, "a", 1, 1)], "q long, file string, first int, last int")
    cuts = spark.createDataFrame([(1, "a", 4, 6), (1, "a", 2, 3), (1, "c", 9, 9), (2, "x/a", 1, 9)], "q long, file string, low int, high int")
    assert {tuple(r) for r in evaluate.span_recall(gold, cuts, ["q"]).collect()} == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}


def test_skipped_paths_and_baseline_terms(spark):
    paths = {"a/b.py": False, "b.rst": False, "c.YML": False, "d.cfg": False, ".py": True, "x/.py": True, "a.ts": True, "build/a.py": True, "a/.pytest_cache/b.py": True, ".tox/a.py": False, "noext": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s for r in df.select("p", evaluate.skipped_path("p").alias("s")).collect()} == paths
    terms = spark.createDataFrame([("Why does the Retry_queue retry queues, and the retry?",)], "t string").select(evaluate.baseline_terms("t").alias("x")).first().x
    assert terms == ["why", "retry", "queue", "queues"]


def test_derived_edges(spark):
    f = spark.createDataFrame([(1, 1, "app/service.py", [], False), (2, 1, "app/worker.py", ["app.service", "os"], False), (3, 1, "tests/test_service.py", ["app.service"], True), (4, 2, "app/service.py", ["app.worker"], False)], "id long, repo_id long, path string, imports array<string>, is_test boolean")
    s = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 4), (14, None)], "id long, file_id long")
    assert {(r.repo_id, r.from_id, r.to_id) for r in edges.imports_file(f).collect()} == {(1, 2, 1), (1, 3, 1)}
    assert {(r.repo_id, r.from_id, r.to_id) for r in edges.test_covers_symbol(f, s).collect()} == {(1, 3, 10), (1, 3, 11)}


def test_edges_of_empty_tables(spark):
    f = spark.createDataFrame([], "id long, repo_id long, path string, language string, summary string, imports array<string>, excerpt string, is_doc boolean, is_test boolean, is_config boolean, is_code boolean")
    s = spark.createDataFrame([], "id long, file_id long, repo_id long, name string, qualified_name string, summary string")
    assert edges.doc_edges(edges.describes(f, s)).count() == edges.config_edges(f, s).count() == edges.test_covers_symbol(f, s).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    os.makedirs(src)
    spark.createDataFrame([("a", "1"), ("b", "2")], "key string, v string").coalesce(1).write.mode("append").parquet(src)
    store, seen = incremental.StateStore(spark, str(tmp_path / "s"), "key"), []

    def run(check="c"):
        stream = spark.readStream.schema("key string, v string").parquet(src)
        q = logs.merge_changed(stream, store, ["v"]).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(sorted((r.key, r.v) for r in store.outputs().collect()))

    run()
    spark.createDataFrame([("a", "1"), ("b", "3")], "key string, v string").coalesce(1).write.mode("append").parquet(src)
    run()
    run("lost")  # the query's own progress is lost: its epochs are committed already
    assert seen == [[("a", "1"), ("b", "2")]] + [[("a", "1"), ("b", "2"), ("b", "3")]] * 2
    counts = logs.windowed_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert counts.agg(F.sum("n")).first()[0] == 1000
