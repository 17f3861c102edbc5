"""Operators of the llm subpackage against brute force, exact round trips and small cases."""

import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import ann, docpairs, handwritten, leakage, split, tokens, truncation

DATA = "/root/testdata/sf0.001"


# 1 -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "doc,signature,says",
    [
        ("Keeps only those rows which were split already.", "def walk(tree)", True),
        ("noqa markers are removed from every line so that diffs stay plain.", "def f(a)", True),
        ("TODO lists left by workers are emptied here, before the run.", "def f(a)", True),
        ("See Quitro for background; this variant waits until the edge is rebuilt.", "def f(a)", True),
        ("Args:\n    queue: sealed timer that the worker has folded.", "def f(queue)", True),
        ("/**\n * Gibt die ältesten Einträge zuerst zurück.\n */", "f()", True),
        ("TODO(juniper): write a proper description of this one as soon as its interface has settled down.", "def f()", False),
        ("Copyright (c) 2025 Moith contributors. Use, copying and change are allowed under the terms named in the LICENSE file.", "def f()", False),
        ("Args:\n    chunk (str):\n    timer (str):\n\nReturns:\n    None", "def f(chunk, timer)", False),
        ("Parameters\n----------\nlock : int\nchecksum : int", "def f(lock, checksum)", False),
        ("_summary_\n\nArgs:\n    a (_type_): _description_", "def f(a)", False),
        ("This function will collect adapter.", "def collect_adapter(self)", False),
        ("Rebuild neighbour vector: heap, checksum.", "def rebuildNeighbourVector(heap, checksum)", False),
        ("Overrides parent method.", "def f()", False),
        ("{@inheritDoc}", "f()", False),
        ("eslint-disable-next-line no-unused-vars", "f()", False),
        ("This text was inserted by the template; please replace it with a description of what the function does.", "f()", False),
        ("", "f()", False),
        (None, None, False),
    ],
)
def test_describe(doc, signature, says):
    assert bool(docpairs.describe(doc, signature)) == says


def test_comment_spans():
    ts = 'const a = "// no";\n// one\n// two\nfunction f() {} // tail\n\n/** x\n * y */\n\nlet b;\n/* c */ let d;\n'
    assert [s[:3] for s in docpairs.comment_spans(ts, "typescript")] == [(2, 3, 4), (6, 7, 9)]
    py = 's = """\n# no\n"""\n# yes\ndef f():\n    pass\n'
    assert [s[:3] for s in docpairs.comment_spans(py, "Python")] == [(4, 4, 5)]
    assert docpairs.comment_spans("const re = /[`]/;\n/** Adds two. */\nfunction f() {}\nlet s = `x`;\n", "typescript") == [(2, 2, 3, "/** Adds two. */")]
    assert docpairs.comment_spans("a = b / c; // half\n// whole\nd = e / f;", "javascript") == [(2, 2, 3, "// whole")]


def test_documented_functions(spark):
    text = "\n".join(["// Counts how many stacks were loaded per preview.", "function a() {}", "// Counts how many stacks were loaded per preview.", "", "function b() {}", "// Never blocks the loop of a worker.", "let x = 1;", "function c() {}"])
    text += "\n" * 2040 + "/* Blocks until at least one marker is free. */\nfunction d() {}"
    last = text.count("\n") + 1
    rows = [(1, 1, "a", "function", "typescript", 2, 2, "function a()", None), (2, 1, "b", "Function ", "typescript", 5, 5, "function b()", None), (3, 1, "c", "function", "typescript", 8, 8, "function c()", None), (4, 1, "d", "METHOD", "typescript", None, last, "d()", None), (5, 1, "K", "class", "python", 1, 2, None, "Never blocks the loop of a worker."), (6, None, "e", "function", "python", None, None, "def e()", "Never blocks the loop of a worker."), (7, 9, "f", "function", "python", 1, 1, " ", "Never blocks the loop of a worker."), (8, 9, "g", "function", "python", 1, 1, "def g()", None)]
    sym = spark.createDataFrame(rows * 2, "id long, file_id long, name string, symbol_type string, language string, line_start int, line_end int, signature string, docstring string")
    src = spark.createDataFrame([(1, text), (9, None), (3, "")], "file_id long, content string")
    assert sorted(r.symbol_id for r in docpairs.documented_functions(sym, src).collect()) == [1, 4, 6]
    assert docpairs.documented_functions(sym.limit(0), src).count() == 0
    assert sorted(r.symbol_id for r in docpairs.documented_functions(sym, src.limit(0)).collect()) == [6]


# 3 -------------------------------------------------------------------------


def test_cuts_equal_greedy():
    rng = random.Random(0)

    def greedy(s, limit, ov):
        n, out, p = len(s) - 1, [], 0
        while True:
            reach, e = min(p + limit, n), -1
            if reach == n:
                return [*out, (p, n)]
            for low, classes in ((p + max(ov + 1, limit // 2), (5, 4, 3, 2)), (p + ov + 1, (5, 4, 3, 2, 1))):
                for k in classes:
                    c = [q for q in range(low, reach + 1) if s[q] >= k]
                    e = c[-1] if e < 0 and c else e
            e = reach if e < 0 else e
            out.append((p, e))
            p = e - ov

    for _ in range(60):
        texts = ["".join(rng.choice("ab  .\ńx") if rng.random() < 0.7 else "z" * rng.randint(1, 60) for _ in range(rng.randint(0, 120))) for _ in range(3)] + ["q" * rng.randint(0, 300)]
        st = [split.text_strength(t) for t in texts]
        size = np.array([len(s) - 1 for s in st])
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        item, a, b = split.cut_flat(np.concatenate(st), base, size, 50, 7)
        for i, s in enumerate(st):
            assert [(int(p), int(q)) for k, p, q in zip(item, a, b) if k == i] == greedy(s, 50, 7)


def test_split_texts_and_lines(spark):
    texts = {1: "a" * 251, 2: "word " * 200, 3: None, 4: "", 5: "é" * 250, 6: "x.\n\n" * 300}
    df = spark.createDataFrame(list(texts.items()) * 2, "item_id long, text string")
    out = split.split_texts(df).orderBy("item_id", "piece").collect()
    for i in (1, 2, 6):
        p = [r for r in out if r.item_id == i]
        assert p[0].start == 0 and p[-1].end == len(texts[i]) and all(r.end - r.start <= 250 and r.text == texts[i][r.start : r.end] for r in p)
        assert all(a.end - b.start == 30 for a, b in zip(p, p[1:])) and [r.piece for r in p] == list(range(len(p)))
    assert {r.item_id for r in out} == {1, 2, 6}
    code = "\n".join(("" if i % 30 == 0 else "    x") for i in range(1, 301))
    ranges = spark.createDataFrame([(1, 1, 1, 300), (2, 1, 1, 80), (3, 7, 5, 400), (4, 1, None, 3), (5, 1, 200, 900)] * 2, "item_id long, file_id long, low int, high int")
    lines = split.split_lines(ranges, spark.createDataFrame([(1, code), (7, None)], "file_id long, content string")).orderBy("item_id", "piece").collect()
    for i, lo, hi in ((1, 1, 300), (3, 5, 400), (5, 200, 900)):
        p = [r for r in lines if r.item_id == i]
        assert p[0].start == lo and p[-1].end == hi and all(r.end - r.start + 1 <= 80 for r in p) and all(a.end - b.start + 1 == 5 for a, b in zip(p, p[1:]))
    assert {r.item_id for r in lines} == {1, 3, 5}
    assert [r.end for r in lines if r.item_id == 1][0] in (59, 60)  # at a blank line


def test_long_items_in_blocks_equal_short_ones(spark):
    rng = random.Random(2)

    def text(n):
        out = ""
        while len(out) < n:
            out += "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) + rng.choice([" ", " ", ". ", "\n", "\n\n", "é\u0301", "\r\n"])
        return out[:n]

    texts = spark.createDataFrame([(1, text(5000)), (2, text(1001)), (3, "x" * 3000), (4, text(1000)), (5, text(2600)), (6, "ab " * 400), (7, text(8123)), (8, text(600))], "item_id long, text string")
    whole = sorted(map(tuple, split.split_texts(texts).collect()))
    assert sorted(map(tuple, split.split_texts(texts, block=600).collect())) == whole and {x[0] for x in whole} == set(range(1, 9))
    code = "\n".join(rng.choice(["", "def f():", "    x = 1", "    if x:", "        y = 2", ""]) for _ in range(3000))
    ranges = spark.createDataFrame([(1, 1, 1, 3000), (2, 1, 5, 900), (3, 1, 100, 400), (4, 2, 1, 2500), (5, 1, 2000, 3500), (6, 2, 3, 100)], "item_id long, file_id long, low long, high long")
    src = spark.createDataFrame([(1, code)], "file_id long, content string")
    lines = sorted(map(tuple, split.split_lines(ranges, src).collect()))
    assert sorted(map(tuple, split.split_lines(ranges, src, block=200).collect())) == lines
    blind = [x for x in lines if x[0] == 4]
    assert [(x[2], x[3]) for x in blind[:2]] == [(1, 80), (76, 155)] and blind[-1][3] == 2500


# 4 -------------------------------------------------------------------------


def _neighbourhood():
    """Files around those of the test: some that path or tags mark, with two kinds of heads, and many by hand."""
    rng = random.Random(8)
    code = "import {{ a{0} }} from './x{0}';\n\nexport function go{0}(n{0}) {{\n  return a{0}(n{0});\n}}\n"
    out = []
    for k in range(12):
        out.append((1000 + k, k % 5, f"src/generated/q{k}.ts", [], "x", f"// Code generated by tool{k}. DO NOT EDIT.\n" + code.format(100 + k)))
        out.append((1100 + k, k % 5, f"src/vendor/q{k}.ts", [], "x", f"// Vendored from lib{k} {k}.0; keep in step with upstream.\n" + code.format(100 + k)))
    nouns = [f"noun{k}" for k in range(300)]
    for k in range(300):
        head = rng.choice(["// Strips the DO NOT EDIT line that emitted modules carry.", "// Talks to the vendor portal of {}.", "// Copyright (c) The {} Authors.", "// Waits for the {} before it clears the {} of the day."])
        out.append((2000 + k, k % 7, f"src/h{k}.ts", [], "x", head.format(nouns[k], rng.choice(nouns)) + "\n" + code.format(100 + k)))
    return out


def test_not_handwritten(spark):
    mini = "!function(a,b){" + "".join(f"{c}=function(e){{return {c}[e]||b}};if(a&&b!=={c})for(;d<a.length;)" for c in "cdefghijklmnop") + "}"
    code = "import { a } from './x';\n\nexport function go(n) {\n  return a(n);\n}\n"
    rows = [
        (1, 1, "src/a.py", [], "x", code), (2, 1, "node_modules/z/i.js", [], "x", code), (3, 1, "src/b.min.js", None, None, None), (4, 1, "src/c.ts", ["Generated"], "x", code), (5, 1, "src/d.ts", ["not-generated"], "x", code),
        (6, 2, "src/e.ts", [], "x", "// Code generated by abc. DO NOT EDIT.\n" + code), (7, 2, "src/f.ts", [], "x", "// Strips the DO NOT EDIT line that emitted modules carry.\n" + code), (8, 2, "src/g.js", [], "x", mini), (9, 3, "src/h.py", [], "x", "x = bytes([" + ",".join(map(str, range(200))) + "])"),
        (10, 3, "src/k/__init__.py", [], "x", ""), (11, 3, None, None, None, None), (12, 4, "src/m.py", [], "x", "# Vendored from zenform 4.0; keep in step with upstream.\n" + code), (13, 4, "vendor_portal/n.py", ["vendor-portal"], "x", code), (14, 4, "src/__generated__/o.ts", [], "x", None),
    ]
    rows += _neighbourhood()
    df = spark.createDataFrame([(i, r, p, t, c, i, {"content_excerpt": e} if e is not None else {}) for i, r, p, t, c, e in rows] * 2, "id long, repo_id long, path string, tags array<string>, checksum string, indexed_at int, metadata_json map<string,string>")
    got = {r.file_id: (r.label, r.evidence) for r in handwritten.not_handwritten(df).collect()}
    assert {i for i in got if i < 100} == {2, 3, 4, 6, 8, 9, 12, 14} and {i for i in got if i >= 2000} == set()
    assert got[6] == ("generated", "family") and got[12] == ("vendored", "family") and got[8] == ("minified", "composition") and got[9] == ("blob", "composition")
    # the same files, none of which path or tags mark: no head is known in advance, so nothing tells the families from others
    told = F.when(F.col("id") >= 1000, F.lit("src/plain.ts")).otherwise(F.col("path"))
    assert {6, 12} & {r.file_id for r in handwritten.not_handwritten(df.withColumn("path", told)).collect()} == set()
    newer = spark.createDataFrame([(4, 1, "src/c.ts", [], "y", 99, {})], df.schema)
    assert 4 not in {r.file_id for r in handwritten.not_handwritten(df.unionByName(newer)).collect()}
    assert handwritten.not_handwritten(df.limit(0)).count() == 0


def _excerpts(spark, texts):
    return spark.createDataFrame([(i, i, f"src/f{i}.ts", [], i, {"content_excerpt": e}) for i, e in texts.items()], "id long, repo_id long, path string, tags array<string>, indexed_at int, metadata_json map<string,string>")


def test_bodies_meet_under_other_headers(spark):
    body = "\n".join(f"export function go{'(' * (k % 4)}n{')' * (k % 4)} {'{ return' if k % 3 else '[ throw'} a{'+' * (k % 5)}b; }}" for k in range(40))
    files = _excerpts(spark, {1: "// utils\n" + body, 2: "// sums\n// of all kinds of rows, and more\n" + body, 3: "// sums\n// of all kinds of rows, and more\nlet x;"})
    unit = handwritten.units(handwritten.current_files(files), frozenset("utils sums of all kinds rows and more".split())).withColumn("cls", F.xxhash64("sort", "text"))
    classes = handwritten.banded(unit.select("cls", "sort", "text").distinct())
    of = {}
    for r in unit.join(handwritten.clusters(classes), "cls").collect():
        of.setdefault(r.file_id, set()).add(r.cluster)
    assert of[1] & of[2] and of[2] & of[3] and not of[1] & of[3]


def test_clusters_lose_no_link(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {"A": words[:60] + [f"a{i}" for i in range(40)], "B": words, "C": words[:96] + ["c1", "c2", "c3", "c4"]}  # B and C are similar, A to neither
    for order in ((1, 2, 3), (2, 1, 3), (3, 2, 1)):  # whichever is least in the band that all three share
        rows = [(k, " ".join(v), [7]) for k, v in zip(order, texts.values())]
        of = {r.cls: r.cluster for r in handwritten.clusters(spark.createDataFrame(rows, "cls long, text string, bands array<long>")).collect()}
        assert of[order[1]] == of[order[2]] != of[order[0]] == order[0]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(64)] + [(102, 101)], "cls long, other long")
    assert {(r.cls, r.cluster) for r in handwritten.components(chain).collect()} == {(i, 0) for i in range(65)} | {(101, 101), (102, 101)}


def test_long_heads_and_bare_lines():
    licence = "".join(f"// line {k} of a licence\n" for k in range(30))
    notes, code = handwritten.notes_and_code(licence + "// the last line counts as well\nlet x = 1;")
    assert len(notes) == 31 and notes[-1] == "the last line counts as well" and code == "let x = 1;"
    assert handwritten.notes_and_code("Vendored from abc 5; keep it (all) in step\nimport x")[0] == ["Vendored from abc 5; keep it (all) in step"]
    for text in ("x = f(a, b, c, d)", "!function(a,b){return a}", "import a from './b' or so", "", "  \n"):
        assert handwritten.notes_and_code(text)[0] == []


# 6 -------------------------------------------------------------------------


def _vectors(spark, arrays, kind="file"):
    return spark.createDataFrame([(i, kind, v) for i, v in arrays], "id long, node_kind string, vector array<float>")


def _brute(x, k, least):
    n = {i: np.asarray(v, dtype=float) / np.linalg.norm(v) for i, v in x}
    pairs = set()
    for i in n:
        best = sorted(((round(float(n[i] @ n[j]), 6), -j) for j in n if j != i), reverse=True)[:k]
        pairs |= {(min(i, -j), max(i, -j)) for s, j in best if s >= least}
    return pairs


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = []
    for c in range(40):
        centre = rng.normal(size=48)
        x += [(c * 10 + j, ((centre + 0.25 * rng.normal(size=48)) * (j + 1)).tolist()) for j in range(int(rng.integers(1, 9)))]
    x += [(1000 + j, x[0][1]) for j in range(9)]  # equal vectors
    odd = [(2000, None), (2001, [0.0] * 48), (2002, []), (2003, [float("nan")] * 48)]
    df = _vectors(spark, x + x + odd).unionByName(_vectors(spark, [(3000, x[0][1]), (3001, x[0][1])], " FILE "))
    got = {tuple(r) for r in ann.similar_pairs(df).collect()}
    true = _brute(x + [(3000, x[0][1]), (3001, x[0][1])], 5, 0.9)
    assert len(got & true) >= 0.97 * len(true) and got <= true
    assert ann.similar_pairs(df.limit(0)).count() == 0
    assert ann.similar_pairs(_vectors(spark, x[:2], "a").unionByName(_vectors(spark, [(9, x[0][1][:40])], "a"))).count() <= 1


def test_longer_codes_keep_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(700, 64))
    x = [(i, (c + 0.12 * rng.normal(size=64)).tolist()) for i, c in enumerate(np.repeat(centres, 6, axis=0))]
    assert ann.extra_axes(len(x), bucket=8) > 0 and ann.extra_axes(len(x)) == 0
    got = {(r.src, r.dst) for r in ann.nearest_neighbours(_vectors(spark, x), bucket=8).collect()}
    true = {(r.src, r.dst) for r in ann.brute_force(_vectors(spark, x), _vectors(spark, x)).collect()}
    assert len(true) > 15_000 and len(got & true) >= 0.9 * len(true) and got <= true


def test_crowded_buckets_lose_no_neighbour(spark):
    rng = np.random.default_rng(3)
    centre, rest = rng.normal(size=64), rng.normal(size=(1500, 64))
    centre /= np.linalg.norm(centre)
    rest -= np.outer(rest @ centre, centre)
    x = [(i, (0.95 * centre + 0.31 * r / np.linalg.norm(r)).tolist()) for i, r in enumerate(rest)]
    x += [(2000 + i, x[0][1]) for i in range(3)]
    got = {(r.src, r.dst) for r in ann.nearest_neighbours(_vectors(spark, x), 5, 0.9, crowd=300, block=200).collect()}
    true = {(r.src, r.dst) for r in ann.brute_force(_vectors(spark, x), _vectors(spark, x)).collect()}
    assert len(true) == 5 * len(x) and len(got & true) >= 0.999 * len(true)


def test_recall(spark):
    r = ann.recall(spark.read.parquet(f"{DATA}/node_embeddings.parquet"), every=5).first()
    assert r.n_true == 0 or r.recall >= 0.9


# 7 -------------------------------------------------------------------------


def test_encoding(spark):
    texts = [None, "", " ", "<|endoftext|> and 'tis", "a" * 3000, " \n\n \t", "\x00\x7f￾", "é👩‍👩‍👧 索引", "def f(x):\n    return x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(df).collect()}
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tokens.decode_documents(tokens.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


# 8 -------------------------------------------------------------------------


def _passage(d, q, top):
    """Brute force: whether q has 20 words or more that d holds with at most ``top`` changes and one in ten."""
    none = -(10**6)
    far = np.full((top + 1, len(d) + 1), none)
    for x in q:
        now = np.full_like(far, none)
        if x is not None:
            same = np.array([w == x for w in d])
            for e in range(top + 1):
                best = np.where(same, (np.maximum(far[0, :-1], 0) if e == 0 else far[e, :-1]) + 1, none)
                if best.max(initial=none) >= max(20, 10 * e):
                    return True
                if e:
                    best = np.maximum.reduce([best, far[e - 1, :-1] + 1, far[e - 1, 1:] + 1, now[e - 1, :-1]])
                now[e, 1:] = best
        far = now
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    vocab = ["the", "of", "a"] * 30 + [f"w{i}" for i in range(60)]  # few words, so that many chance pairs meet
    items = {f"i{k}": [rng.choice(vocab) for _ in range(rng.choice([15, 25, 60, 140]))] for k in range(12)}
    docs = {}
    for k in range(160):
        src = rng.choice(list(items.values()))
        n = rng.choice([17, 18, 20, 22, 30, 31, 40, 60])
        at = rng.randrange(max(1, len(src) - n + 1))
        piece = src[at : at + n]
        middle = rng.random() < 0.5  # changes anywhere, or all within ten words
        for _ in range(rng.randint(0, n // 8)):
            j = len(piece) // 2 - 4 + rng.randrange(9) if middle and len(piece) > 12 else rng.randrange(len(piece))
            piece[j : j + 1] = rng.choice([["other"], [], [piece[j], "more"]])
        docs[k] = [rng.choice(vocab) for _ in range(rng.randint(0, 80))] + piece + [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
    want = {(k, i) for k, d in docs.items() for i, q in items.items() if _passage(d, q, len(q) // 10)}
    d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(q)) for i, q in items.items()], "instance_id string, problem_statement string")
    assert 40 < len(want) < 160 and {tuple(r) for r in leakage.leaked(d, it).collect()} == want
    # segments shorter than a document, and an index that is written and read again
    small = leakage.build_index(d, segment=150, overlap=100).checkpoint()
    assert small.count() > 100 and {tuple(r) for r in leakage.leaked(d, it, small).collect()} == want


def test_index_holds_every_word(spark):
    texts = {1: "A b a, c", 2: None, 3: "", 4: "b\n" * 500, 5: "...", 6: "c"}
    terms, n = leakage.Terms(), {}
    for r in leakage.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1), segment=400, overlap=50).collect():
        seg = leakage.Segment(r)
        for w in "abc":
            i = int(seg.local(np.array([terms[w]]))[0])
            for p in seg.postings(i) if i != leakage.ABSENT else []:
                k = np.searchsorted(seg.starts, p, side="right") - 1
                n.setdefault((w, int(seg.docs[k])), []).append(int(p - seg.starts[k]))
    assert n["a", 1] == [0, 2] and n["b", 1] == [1] and n["c", 6] == [0]
    assert sorted(n["b", 4]) == sorted([*range(400), *range(150)]) and {k for _, k in n} == {1, 4, 6}  # parts overlap by 50 words


def test_leaks(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    boiler = " ".join(rng.choice(vocab) for _ in range(40))
    items = {f"i{k}": " ".join(rng.choice(vocab) for _ in range(70)) for k in range(8)}
    for k in range(3):
        items[f"i{k}"] += " " + boiler
    own = {k: v.split() for k, v in items.items()}
    noise = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    changed = own["i1"][10:32]
    changed[5], changed[12] = "other", "words"
    dropped = own["i2"][5:36]
    del dropped[9], dropped[20]
    docs = {
        1: noise(50) + " " + " ".join(own["i0"][3:25]) + " " + noise(30), 2: noise(9) + " <b>" + "**, > ".join(x.upper() for x in changed) + "</b>", 3: "\r\n> ".join([noise(5), *dropped, noise(4)]), 4: noise(20) + " " + boiler + " " + noise(5),
        5: noise(20) + " " + " ".join(own["i3"][0:17]) + " " + noise(40), 6: None, 7: "", 8: items["i4"] + " " + items["i5"], 9: noise(3000), 10: items["i4"],
    }
    d = spark.createDataFrame(list(docs.items()) * 2, "doc_id long, text string")
    it = spark.createDataFrame([*items.items(), ("null", None), ("empty", ""), ("short", "too few words")] * 2, "instance_id string, problem_statement string")
    assert {tuple(r) for r in leakage.leaked(d, it).collect()} == {(1, "i0"), (2, "i1"), (3, "i2"), (8, "i4"), (8, "i5"), (10, "i4")}
    assert leakage.leaked(d.limit(0), it).count() == 0 and leakage.leaked(d, it.limit(0)).count() == 0


# 9 -------------------------------------------------------------------------

WHOLE = ["A sentence that ends.", "Is it?\n", "- skip the pinned lock", "Refs: QUARRY-3791", "text.\n\n-- \nthe orbit crew", "Done.\n\nSee https://notes.lugar.invalid/payload/9475", "| a | b |\n|---|---|\n| c | 70 |", "text.\n```sh\nx = (1\n```", '{\n  "a": [1, 2]\n}', "[a.b]\nx = 1\ny = true\nz = \"q\"", "def f(a):\n    b = g(a, 2)\n    return a", "Hash the router before window replay", "", " \n\t"]
CUT = ["A sentence, with a clause, that was cut in the mid", "- merge the", "One. Rolling back to 855 left one spar…", "text.\n```sh\nx = 1\ny = ", '{\n  "a": [1, 2', "def f(a):\n    b = g(a, h(", "One. Two is (message truncated)", "Broken a�", "| a | b |\n|---|---|\n| c | 7", "Text, and then,", "def f(a):\n    return outl", "[a.b]\nx = 1\ny = true\nz = \"q", "See https://notes.", "Fine.\n\nRefs: QUAR"]


WHOLE += ['All good (see "x" and `y`).', '5" pipe fits.', "„Gut“, sagte sie.", "«Bon», dit-il.", "»Gut«, sagte er.", 'He said "fine." Done.', "<p>Fine.", "A <b>bold</b> end.", "Two ** stars are no mark."]
CUT += ['He said "we will ship the router tomorrow.', "<b>very important and it ends here.", "open **bold mark that ends.", "«Bon, dit-il.", "It was written [" + " " * 130 + "truncated]", "Half of it [message truncated (12 kB)]", "Some text -- truncated --", "Too long, read more >>"]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert truncation.judge(text)[0] in ("whole", "ask")


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert truncation.judge(text)[0] == "cut"


def test_truncation_tables(spark):
    rows = [(i, t, "s") for i, t in enumerate(WHOLE + CUT)] + [(100, None, None), (101, "Null source is cut in the", None)]
    rows += [(200 + i, "x" * 70 + f"{i:02d} then it goes on and"[:20], "fixed") for i in range(30)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    assert got == set(range(len(WHOLE), len(WHOLE) + len(CUT))) | {101} | set(range(200, 230))
    rates = {r.source: (r.n_texts, r.n_cut) for r in truncation.truncation_rates(df).collect()}
    assert rates["fixed"] == (30, 30) and rates["s"] == (len(WHOLE) + len(CUT) - 2, len(CUT)) and rates[""] == (1, 1)
    limits = truncation.field_limits(spark.createDataFrame([("s", 90, 90)] * 30 + [("s", n, n) for n in range(60, 130)], "source string, chars int, octets int"))
    assert {(r.source, r.unit, r.length) for r in limits.collect()} == {("s", "chars", 90), ("s", "octets", 90)}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_baseline_follows_the_source(spark):
    lines = [(i, f"Intro.\n\n- take the noun{i % 10}\n- drop the noun{(i + 1) % 10}\n\nEnd.", s) for i, s in enumerate(["a", "b"] * 150)]
    odd = [(1000 + i, "Intro.\n\n- take it slowly\n\nEnd.", "b") for i in range(30)]
    ask = [(2000, "Intro.\n\n- take the noun3", "a"), (2001, "Intro.\n\n- take it slowl", "b"), (2002, "Intro.\n\n- take it slowly", "b"), (2003, "Intro.\n\n- take the noun3", "unseen")]
    df = lambda times: spark.createDataFrame((lines + odd) * times + ask, "doc_id long, text string, source string")
    for times in (1, 4):  # shares, not counts: a larger corpus gives the same verdicts
        assert {r.doc_id for r in truncation.truncated(df(times)).collect()} == {2001}


# queries -------------------------------------------------------------------


def test_query_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from seamline.llm import queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    for name, sql in queries.SQL.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect())) == sorted(con.execute(sql).fetchall())
