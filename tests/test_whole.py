"""Results that must be whole: nothing is left out by a kind, a row limit or a subset of the queries."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from seamline.operators import edges
from seamline.plans import table_queries

DATA = "/root/testdata/sf0.001"


def test_memory_links_of_both_kinds(spark):
    m = spark.createDataFrame([(1, 1, "lease router", None, "the sealed lease of a worker")], "id long, repo_id long, title string, summary string, content string")
    f = spark.createDataFrame([(i, 1, p, None) for i, p in ((1, "src/lease.py"), (2, "src/lease/router.py"), (3, "src/worker.py"))], "id long, repo_id long, path string, summary string")
    s = spark.createDataFrame([(2, 1, "seal", "lease.seal", "router of the worker"), (9, 1, "run", "x.run", "Lease"), (4, 2, "lease", None, None)], "id long, repo_id long, name string, qualified_name string, summary string")
    got = {(r.node_kind, r.node_id, r.score, r.nth) for r in edges.memory_links(m, f, s).collect()}
    assert got == {("symbol", 2, 4, 1), ("symbol", 9, 2, 2), ("file", 2, 2, 3), ("file", 3, 1, 4)}


def test_every_memory_is_listed(spark):
    all_ = {(r.repo_id, r.id) for r in table_queries._memories(spark, DATA).where("repo_id is not null").collect()}
    got = {(r.repo_id, r.id) for r in table_queries.list_memories(spark, "/root/testdata/sf0.01").collect()}
    more = {(r.repo_id, r.id) for r in table_queries._memories(spark, "/root/testdata/sf0.01").where("repo_id is not null").collect()}
    assert got == more and {(r.repo_id, r.id) for r in table_queries.list_memories(spark, DATA).collect()} == all_
    assert max(r.nth for r in table_queries.list_memories(spark, "/root/testdata/sf0.1").collect()) > 10


def test_topk_of_every_fiftieth_vector(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    got = {}
    for r in table_queries.vector_topk(spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.nth] = (r.vec_id, round(r.sim, 4))
    assert set(got) == {i for i in ids if i % 50 == 0}
    for i in got:
        sim = np.round(v @ v[ids == i][0], 6)
        best = [j for j in np.lexsort((ids, -sim)) if ids[j] != i and sim[j] > 0][:10]
        assert [got[i][n][1] for n in sorted(got[i])] == [round(float(sim[j]), 4) for j in best]


def test_neighbours_up_to_the_limit_of_the_reference(spark):
    n = {}
    for r in table_queries._edges(spark, DATA).where("fid is not null and tid is not null").select("fk", "fid", "tk", "tid").collect():
        for x in {(r.fk, r.fid), (r.tk, r.tid)}:
            n[x] = n.get(x, 0) + 1
    got = {}
    for r in table_queries.graph_neighbors(spark, DATA).collect():
        got[(r.kind, r.node)] = got.get((r.kind, r.node), 0) + 1
    assert got == {x: min(k, 20) for x, k in n.items()} and max(n.values()) > 3


FILE = "id long, repo_id long, path string, summary string, imports array<string>, excerpt string, is_config boolean, is_code boolean"
SYMBOL = "id long, file_id long, name string, summary string"


def test_settings_meet_code_as_pair_by_pair(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["Lease", "router_probe", "probe", "x", "py", "ÄRGER", "ärger2", "config", "routers", "token-ring", "überlease", "λόγος", "cut.off", "a"]
    some = lambda n: " ".join(rnd.choices(words, k=rnd.randint(0, n)))
    paths = [".py", "", "a.py", "x.ts", "src/router_probe.py", "src/Lease.js", "b c/probe.g.py", "über/lease.tsx", "src/a.py.py", "py/x.py", None]
    files, symbols = [], []
    for i in range(1, 121):
        config = i % 2 == 0
        said = rnd.choice(["", "see src.router_probe now", "x.a.py.", "use xsrc.leased", "b c.probe.g", "über.lease.tsx", ".py"]) if config else None
        path = rnd.choice(paths + [f"src/{rnd.choice(words)}{i}.py"]) if not config or rnd.random() < 0.1 else f"{rnd.choice(words)}/s{i}.toml"
        files.append((i, rnd.choice([1, 1, 2, None]), path, rnd.choice([None, some(3)]), rnd.choice([None, [], [some(1), None]]), said and said + " " + some(4), config, not config or i % 10 == 0))
        symbols += [(i * 10 + k, rnd.choice([i, None]), rnd.choice([None, some(1)]), rnd.choice([None, some(3)])) for k in range(i % 3)]
    want = {}
    for c in (f for f in files if f[6] and f[1] and f[2] is not None):
        text = f"{c[2]} {c[3] or ''} {c[5] or ''}".lower()
        terms = sorted({t for t in re.split(r"\W+", text) if len(t) >= 4} - set(edges.CONFIG_STOPWORDS), key=str.encode)
        for k in (f for f in files if terms and f[7] and f[1] == c[1] and f[2] is not None):
            hay = " ".join([k[2], k[3] or "", *(x for x in k[4] or [] if x)] + [f"{s[2] or ''} {s[3] or ''}" for s in symbols if s[1] == k[0]]).lower()
            hit = [t for t in terms if t in hay]
            hints = {re.sub(rf"\.{e}\Z", "", k[2]).replace("/", ".").lower() for e in ("py", "ts", "js")}
            hinted = any(h and h in text for h in hints)
            if len(hit) >= 2 or hinted:
                want[c[0], k[0]] = (c[1], len(hit), int(hinted), round(1 + min(len(hit), 4) * 0.1 + 0.2 * hinted, 6), " ".join(hit[:6]))
    f, s = spark.createDataFrame(files, FILE), spark.createDataFrame(symbols, SYMBOL)
    for block in (1024, 7):
        monkeypatch.setattr(edges, "BLOCK", block, raising=False)
        rows = edges.config_edges(f, s).collect()
        assert {(r.from_id, r.to_id): (r.repo_id, r.n_terms, r.hinted, r.weight, r.terms) for r in rows} == want and len(rows) == len(want)
    assert {v[2] for v in want.values()} == {0, 1} and {0, 1, 2, 3} <= {v[1] for v in want.values()}


def test_settings_in_slices(monkeypatch):
    settings = pa.table({"from_id": [1, 2, 3], "terms": [["aaaa", "bbbb", "cccc"], ["bbbb", "cccc"], ["dddd"]]})
    code = pa.table({"to_id": [7, 8], "hits": [["cccc", "bbbb"], ["cccc", "aaaa", "bbbb"]], "hinted_by": pa.array([[], [3, 99]], pa.list_(pa.int64()))})
    whole = edges._shared_terms((pa.scalar(4),), settings, code).to_pylist()
    assert [tuple(r.values())[1:] for r in whole] == [(1, 7, 2, 0, 1.2, "bbbb cccc"), (1, 8, 3, 0, 1.3, "aaaa bbbb cccc"), (2, 7, 2, 0, 1.2, "bbbb cccc"), (2, 8, 2, 0, 1.2, "bbbb cccc"), (3, 8, 0, 1, 1.2, "")]
    monkeypatch.setattr(edges, "MEETINGS", 1)
    assert edges._shared_terms((pa.scalar(4),), settings, code).to_pylist() == whole


def test_settings_of_a_large_repository(spark):
    """Nine million pairs of one repository, of which eleven count; pair by pair they take minutes."""
    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("lease", "probe", "token", "ledger", "queue") for b in range(1000, 1400)]
    files = [(i, 17, f"conf/s{i}.toml", None, None, " ".join(f"unused{rnd.randrange(500)}x" for _ in range(20)), True, False) for i in range(3000)]
    files += [(i, 17, f"lib/m{i}.py", " ".join(rnd.choices(words, k=300)), None, None, False, True) for i in range(5000, 8000)]
    files[5] = (5, 17, "conf/five.toml", None, None, "reads lib.m6000 twice", True, False)
    files += [(9000 + i, 17, f"lib/n{i}.py", "sharply planted", None, None, False, True) for i in range(10)] + [(9900, 17, "conf/z.toml", None, None, "planted, sharp", True, False)]
    f, s = spark.createDataFrame(files, FILE), spark.createDataFrame([], SYMBOL)
    began = time.time()
    got = {(r.from_id, r.to_id, r.n_terms, r.hinted) for r in edges.config_edges(f, s).collect()}
    assert got == {(5, 6000, 1, 1)} | {(9900, 9000 + i, 2, 0) for i in range(10)}
    assert time.time() - began < 60
