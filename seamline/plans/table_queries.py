"""Queries of the single operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import token_buckets, top_similar
from ..operators import catalog, edges, evaluate, parsers, snapshot
from ..session import table
from .indexing import EXCLUDE, INCLUDE
from .indexing import effective_excludes as effective_excludes_of
from .retrieval_queries import BASE

QUESTION = "Why does the retry snapshot lose its sealed lease before the router is rebuilt?"
FORTUNE = (100, "The decision: Calpex will hash the ticket while the sealed worker stays cold")


def _files(s, d):
    return catalog.files(table(s, d, "files"))


def _symbols(s, d):
    return catalog.symbols(table(s, d, "symbols"))


def _memories(s, d):
    return catalog.memories(table(s, d, "memories"))


def _edges(s, d):
    return catalog.edges(table(s, d, "edges"))


def _vectors(s, d):
    return catalog.embeddings(table(s, d, "node_embeddings"))


def _any(globs):
    return "|".join(T.glob_regex(g) for g in globs)


def glob_filter(s, d):
    return _files(s, d).where(F.col("path").rlike(_any(INCLUDE)) & ~F.col("path").rlike(_any(EXCLUDE))).select("id", "path")


def effective_excludes(s, d):
    r = catalog.once(table(s, d, "repos"))
    return r.select("id", F.array_join(effective_excludes_of("exclude_globs"), " ").alias("globs"))


def repo_files(s, d):
    return _files(s, d).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("n"))


def repo_lookup(s, d):
    return catalog.once(table(s, d, "repos")).where(F.col("name").startswith("dakzo")).select("id", "name", "local_path")


def list_repos(s, d):
    return catalog.once(table(s, d, "repos")).select("id", "name", F.row_number().over(Window.orderBy("name", "id")).alias("nth"))  # sixty rows at every scale


def list_memories(s, d):
    w = Window.partitionBy("repo_id").orderBy(F.desc("updated_at"), "id")
    return _memories(s, d).where("repo_id is not null").withColumn("nth", F.row_number().over(w)).select("repo_id", "id", "nth")


def vector_dims(s, d):
    return _vectors(s, d).groupBy("model_name", F.coalesce("dimensions", F.lit(-1)).alias("dimensions"), F.coalesce(F.when(F.col("vector").isNotNull(), F.size("vector")), F.lit(-1)).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def snippet_lines(s, d):
    src = table(s, d, "source_files").where("content is not null").select("file_id", F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("lines"))
    sym = _symbols(s, d).where("line_start >= 1 and line_end >= line_start").select("id", "file_id", "line_start", "line_end")
    cut = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return sym.join(src, "file_id").select("id", F.length(cut).cast("long").alias("chars"), F.md5(cut).alias("digest"))


def log_recent(s, d):
    e = table(s, d, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))).alias("nth")).where("nth <= 10")


def log_stage_counts(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def classify_files(s, d):
    return _files(s, d).select("id", *(F.col(c).cast("int").alias(c) for c in ("is_test", "is_doc", "is_config", "is_code", "is_support")))


def skip_paths(s, d):
    return _files(s, d).select("id", evaluate.skipped_path("path").cast("int").alias("skipped"))


def active_memories(s, d):
    return _memories(s, d).where("status = 'active'").groupBy(F.coalesce("repo_id", F.lit(-1).cast("long")).alias("owner")).agg(F.count(F.lit(1)).alias("n"))


def doc_parse(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    bare = F.regexp_replace(F.coalesce(F.try_element_at(F.filter(F.split("text", "\r\n|\r|\n"), lambda x: x.rlike(r"[^ \t]")), F.lit(1)), F.lit("")), r"^[# \t]+|[# \t]+$", "")
    return docs.select("doc_id", F.concat(F.lit("Markdown document "), F.col("doc_id").cast("string"), F.lit(": "), F.substring(bare, 1, 120)).alias("summary"))


def checksum(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")).distinct()


def embed_bow(s, d):
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return token_buckets(docs, "doc_id", "text", 16)


def vector_topk(s, d):
    e = table(s, d, "embeddings")
    return top_similar(e.where("vec_id % 50 = 0"), e, 10)


def graph_neighbors(s, d):
    e = _edges(s, d).where("fid is not null and tid is not null")
    same = (F.col("fk") == F.col("tk")) & (F.col("fid") == F.col("tid"))
    both = e.select(F.col("fk").alias("kind"), F.col("fid").alias("node"), "id", F.col("tk").alias("to_kind"), F.col("tid").alias("to_id")).unionByName(e.where(~same).select(F.col("tk").alias("kind"), F.col("tid").alias("node"), "id", F.col("fk").alias("to_kind"), F.col("fid").alias("to_id")))
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "node").orderBy("id"))).where("nth <= 20")


def graph_edges(s, d):
    return _edges(s, d).groupBy("fk", "tk", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


def contains_edges(s, d):
    return edges.contains_symbol(_symbols(s, d))


def import_edges(s, d):
    return edges.imports_file(_files(s, d))


def test_cover_edges(s, d):
    return edges.test_covers_symbol(_files(s, d), _symbols(s, d))


def _linked_files(s, d):
    """Files whose imports name the module of the next file of the repository, and a module that does not exist."""
    nxt = F.lead(T.module_key("path")).over(Window.partitionBy("repo_id").orderBy("id"))
    return _files(s, d).withColumn("imports", F.array_compact(F.array(nxt, F.lit("no.such.module"))))


def import_edges_linked(s, d):
    return edges.imports_file(_linked_files(s, d))


def test_cover_edges_linked(s, d):
    return edges.test_covers_symbol(_linked_files(s, d), _symbols(s, d))


def doc_edges(s, d):
    return edges.doc_edges(edges.describes(_files(s, d), _symbols(s, d)))


def config_edges(s, d):
    return edges.config_edges(_files(s, d), _symbols(s, d))


def memory_links(s, d):
    return edges.memory_links(_memories(s, d), _files(s, d), _symbols(s, d))


def memory_from_docs(s, d):
    m = _memories(s, d).select("repo_id", "title").distinct()
    lines = F.filter(F.split("excerpt", "\n"), lambda x: F.trim(x) != "")
    f = _files(s, d).where("is_doc and excerpt is not null").withColumn("lines", lines)
    title = F.regexp_replace(F.try_element_at(F.filter("lines", lambda x: x.startswith("#")), F.lit(1)), r"^#+\s*", "")
    body = F.try_element_at(F.filter("lines", lambda x: ~x.startswith("#")), F.lit(1))
    kind = F.when(F.contains("path", F.lit("/adr/")), "decision").when(F.contains("path", F.lit("/runbooks/")), "runbook_note").otherwise("design_note")
    return f.select("repo_id", "id", title.alias("title"), body.alias("summary"), kind.alias("memory_type")).where("title is not null").join(m, ["repo_id", "title"], "left_anti")


def parent_resolution(s, d):
    return edges.resolved_parents(_symbols(s, d))


def _state(s, d):
    return table(s, d, "index_state").where("file_id is not null").groupBy("file_id").agg(F.max_by("checksum", F.struct("processed_at", "run_id", "checksum")).alias("digest"))


def change_diff(s, d):
    new = _files(s, d).select(F.col("id").alias("file_id"), F.col("checksum").alias("digest"))
    return snapshot.diff(new, _state(s, d), ["file_id"], "digest").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def prune(s, d):
    return snapshot.prune(_state(s, d), _files(s, d).select(F.col("id").alias("file_id")), ["file_id"]).select("file_id")


def upsert(s, d):
    new = _files(s, d).select(F.col("id").alias("file_id"), F.col("checksum").alias("digest"))
    return snapshot.upsert(_state(s, d), new, ["file_id"])


def cascade(s, d):
    gone = table(s, d, "node_tombstones").select(F.lower(F.trim("node_kind")).alias("kind"), F.col("node_id").alias("id"))
    return snapshot.cascade(_edges(s, d).select("id", "fk", "fid", "tk", "tid"), gone).groupBy("fk", "tk").agg(F.count(F.lit(1)).alias("n"))


def reconcile(s, d):
    nodes = _files(s, d).select(F.lit("file").alias("kind"), "id").unionByName(_symbols(s, d).select(F.lit("symbol").alias("kind"), "id")).unionByName(_memories(s, d).select(F.lit("memory").alias("kind"), "id"))
    return snapshot.reconcile(nodes, _vectors(s, d))


def nested_exclusion(s, d):
    r = catalog.once(table(s, d, "repos")).select("id", "local_path")
    f = _files(s, d).join(F.broadcast(r.withColumnRenamed("id", "repo_id")), "repo_id").select("repo_id", F.concat_ws("/", "local_path", "path").alias("full_path"))  # sixty repositories at every scale
    return snapshot.outside_nested(f, r).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


def memory_link_targets(s, d):
    e = _edges(s, d).where("fk = 'memory' and tid is not null")
    nodes = _files(s, d).select(F.lit("file").alias("tk"), F.col("id").alias("tid")).unionByName(_symbols(s, d).select(F.lit("symbol").alias("tk"), F.col("id").alias("tid"))).withColumn("there", F.lit(1))
    return e.join(nodes, ["tk", "tid"], "left").groupBy("tk", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("n_valid"))


def gold_spans(s, d):
    return evaluate.gold_spans(table(s, d, "eval_items"))


def _symbol_spans(s, d):
    f = _files(s, d).select(F.col("id").alias("file_id"), evaluate.plain_path("path").alias("file"))
    return _symbols(s, d).where("line_start is not null and line_end is not null").join(f, "file_id").select("file_id", "id", "file", F.least("line_start", "line_end").alias("low"), F.greatest("line_start", "line_end").alias("high"))


def span_overlap(s, d):
    return evaluate.span_hits(evaluate.gold_spans(table(s, d, "eval_items")), _symbol_spans(s, d).select("file", "low", "high"))


def span_recall(s, d):
    """Gold made of each file's first symbol, widened by its line number; hits are the spans of all other symbols of the file."""
    spans = _symbol_spans(s, d)
    first = spans.groupBy("file_id", "file").agg(F.min("id").alias("id")).join(spans.select("id", "low", "high"), "id")
    gold = first.select("file_id", "file", F.col("low").alias("first"), (F.col("high") + F.col("id") % 40).alias("last"))
    return evaluate.span_recall(gold, spans.join(first.select("id"), "id", "left_anti"), ["file_id"])


def baseline_retriever(s, d):
    terms = s.createDataFrame([(QUESTION,)], "question string").select(evaluate.baseline_terms("question").alias("terms"))
    text = table(s, d, "source_files").where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max("content").alias("content"))
    f = _files(s, d).where(~evaluate.skipped_path("path")).join(text, "id", "left").crossJoin(F.broadcast(terms))  # one stated question
    x = f.select("id", "path", evaluate.baseline_score("terms", "path", F.coalesce("content", "excerpt")).alias("score")).where("score > 0")
    return x.orderBy(F.desc("score"), F.length("path"), "path", "id").limit(25)


def row_filters(s, d):
    i = table(s, d, "eval_items").distinct()
    return i.where(F.col("gold_context").isNotNull()).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def skip_accounting(s, d):
    i = table(s, d, "eval_items").select("instance_id", "repo").distinct()
    names = catalog.once(table(s, d, "repos")).select(F.regexp_extract("name", r"^([a-z]+)-([a-z]+)", 1).alias("a"), F.regexp_extract("name", r"^([a-z]+)-([a-z]+)", 2).alias("b"), "current_commit_sha")
    known = names.groupBy(F.concat_ws("/", "a", "b").alias("repo")).agg(F.max("current_commit_sha").alias("commit"))
    j = i.join(known.withColumn("mapped", F.lit(True)), "repo", "left")
    why = F.when(F.col("mapped").isNull(), "repo_not_mapped").when(F.col("commit").isNull(), "commit_mismatch").otherwise("evaluated")
    return j.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def term_lookup(s, d):
    words = [w for w in FORTUNE[1].lower().split() if len(w) > 3]
    docs = table(s, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    hit = F.size(F.filter(F.array(*map(F.lit, words)), lambda t: F.contains(F.lower("text"), t)))
    return docs.select("doc_id", hit.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_docs"))


def parse_sources(s, d):
    paths = _files(s, d).select(F.col("id").alias("file_id"), "path")
    src = table(s, d, "source_files").select("file_id", F.col("content").alias("text")).join(paths, "file_id")
    return parsers.parse_files(src).select("file_id", "language", F.size("symbols").alias("n_symbols"), F.size("imports").alias("n_imports"), "summary", "error")


def path_tags(s, d):
    return _files(s, d).select("id", F.array_join(parsers.path_tags("path"), " ").alias("tags"))


def best_per_path(s, d):
    f = table(s, d, "files").where("path is not null").select("path", F.length(F.coalesce("summary", F.lit(""))).alias("score"), "id", "indexed_at")
    w = Window.partitionBy("path").orderBy(F.desc("score"), "id", F.desc("indexed_at"))
    return f.withColumn("n", F.row_number().over(w)).where("n = 1").select("path", "score", "id")


_CURRENT_STATE = "state AS (SELECT file_id, checksum AS digest FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY processed_at DESC NULLS LAST, run_id DESC NULLS LAST, checksum DESC NULLS LAST) AS n FROM index_state WHERE file_id IS NOT NULL) WHERE n = 1)"
_W4 = r"list_filter(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}{}]+'), lambda t: length(t) >= 4)"
_MODULES = "modules AS (SELECT repo_id, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module, max(id) AS file_id FROM files_now GROUP BY ALL)"
_COVER = f"{_MODULES}, cover AS (SELECT DISTINCT i.repo_id, i.id AS from_id, m.file_id AS to_id FROM (SELECT repo_id, id, unnest(imports) AS module FROM files_now WHERE is_test) i JOIN modules m ON m.repo_id = i.repo_id AND m.module = i.module)"
_DESCRIBES = f"""dw AS (SELECT repo_id, id AS doc_id, unnest(list_distinct({_W4.format("lower(path || ' ' || coalesce(summary, '') || ' ' || coalesce(excerpt, ''))", '_')})) AS w FROM files_now WHERE is_doc),
sw AS (SELECT f.repo_id, f.id AS file_id, s.id AS symbol_id, unnest(list_distinct(list_concat({_W4.format("coalesce(s.name, '') || ' ' || coalesce(s.qualified_name, '')", '')}, {_W4.format('f.path', '')}))) AS w FROM syms s JOIN files_now f ON f.id = s.file_id),
pairs AS (SELECT DISTINCT dw.repo_id, doc_id, file_id, symbol_id FROM dw JOIN sw ON sw.repo_id = dw.repo_id AND sw.w = dw.w)"""
_TEXT_TERMS = ", ".join(f"'{w}'" for w in FORTUNE[1].lower().split() if len(w) > 3)
# Spelled here once more, so that the SQL does not share the constant it is to prove.
_STOP = """'about', 'after', 'also', 'and', 'are', 'because', 'been', 'before', 'but', 'can', 'could', 'does', 'for', 'from', 'had', 'has', 'have', 'how', 'into',
 'not', 'our', 'out', 'same', 'should', 'than', 'that', 'the', 'then', 'there', 'these', 'this', 'when', 'where', 'which', 'while', 'with', 'would', 'you'"""

SQL = {
    "glob_filter": BASE + r""" SELECT id, path FROM files_now WHERE (path LIKE '%/%.py' OR path LIKE '%/%.ts' OR path LIKE '%/%.tsx' OR path LIKE '%/%.js' OR path LIKE '%/%.jsx' OR path LIKE '%/%.md' OR path LIKE '%/%.json' OR path LIKE '%/%.yaml' OR path LIKE '%/%.yml' OR path LIKE '%/%.toml')
 AND NOT regexp_matches(path, '(^|/)(\.git|node_modules|\.venv|venv|dist|build|__pycache__|\.pytest_cache)/')""",
    "effective_excludes": """SELECT DISTINCT id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ' ') AS globs FROM (SELECT id, list_concat(coalesce(exclude_globs, []),
 ['.git/**', '**/.git/**', 'node_modules/**', '**/node_modules/**', '.venv/**', '**/.venv/**', 'venv/**', '**/venv/**', 'dist/**', '**/dist/**', 'build/**', '**/build/**', '__pycache__/**', '**/__pycache__/**', '.pytest_cache/**', '**/.pytest_cache/**',
  '**/.git/**', '**/node_modules/**', '**/.venv/**', '**/venv/**', '**/dist/**', '**/build/**', '**/__pycache__/**', '**/.pytest_cache/**']) AS g FROM repos)""",
    "path_tags": BASE + r""" SELECT id, array_to_string(list_filter([
  CASE WHEN (kind = 'py' AND contains(p, 'test')) OR (kind = 'script' AND (contains(p, '.test.') OR contains(p, '.spec.'))) THEN 'test' END,
  CASE WHEN kind = 'py' AND (contains(p, 'config') OR starts_with(name, 'settings')) THEN 'config' END,
  CASE WHEN kind = 'doc' AND (contains(p, 'adr') OR contains(p, 'decision')) THEN 'architecture' END,
  CASE WHEN kind = 'doc' AND contains(p, 'readme') THEN 'docs' END], lambda x: x IS NOT NULL), ' ') AS tags
 FROM (SELECT id, lower(path) AS p, regexp_extract(path, '[^/]*$') AS name, CASE WHEN lower(path) LIKE '%.py' THEN 'py' WHEN regexp_matches(lower(path), '\.(ts|tsx|js|jsx)$') THEN 'script' ELSE 'doc' END AS kind FROM files_now)""",
    "baseline_retriever": BASE + f""", c AS (SELECT file_id AS id, max(content) AS content FROM source_files WHERE file_id IS NOT NULL GROUP BY 1),
 t AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower('{QUESTION}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS terms),
 f AS (SELECT f.id, path, lower(path) AS p, lower(regexp_extract(path, '[^/]*$')) AS name, lower(left(coalesce(content, excerpt, ''), 8000)) AS x FROM files_now f LEFT JOIN c ON c.id = f.id
   WHERE NOT list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.pytest_cache', '.venv', 'node_modules', 'build', 'dist']) AND regexp_matches(lower(path), '[^/]\\.(py|md|rst|toml|yaml|yml|json|cfg|ini)$')),
 s AS (SELECT id, path, list_sum(list_transform(terms, lambda w: contains(name, w)::INT * 8 + contains(p, w)::INT * 5 + contains(x, w)::INT))::INT AS score FROM f, t)
 SELECT id, path, score FROM s WHERE score > 0 ORDER BY score DESC, length(path), path, id LIMIT 25""",
    "import_edges_linked": BASE + f", {_MODULES}, i AS (SELECT repo_id, id, lead(replace(regexp_replace(path, '\\.py$', ''), '/', '.')) OVER (PARTITION BY repo_id ORDER BY id) AS module FROM files_now) SELECT i.repo_id, i.id AS from_id, m.file_id AS to_id, 'FILE_IMPORTS_FILE' AS edge_type FROM i JOIN modules m ON m.repo_id = i.repo_id AND m.module = i.module",
    "test_cover_edges_linked": BASE + f", {_MODULES}, i AS (SELECT repo_id, id, is_test, lead(replace(regexp_replace(path, '\\.py$', ''), '/', '.')) OVER (PARTITION BY repo_id ORDER BY id) AS module FROM files_now) SELECT i.repo_id, i.id AS from_id, s.id AS to_id, 'TEST_COVERS_SYMBOL' AS edge_type FROM i JOIN modules m ON m.repo_id = i.repo_id AND m.module = i.module JOIN syms s ON s.file_id = m.file_id WHERE i.is_test",
    "repo_files": BASE + " SELECT repo_id, language, count(*) AS n FROM files_now GROUP BY ALL",
    "repo_lookup": "SELECT DISTINCT id, name, local_path FROM repos WHERE name LIKE 'dakzo%'",
    "list_repos": "SELECT id, name, row_number() OVER (ORDER BY name, id) AS nth FROM (SELECT DISTINCT id, name FROM repos)",
    "list_memories": BASE + " SELECT repo_id, id, row_number() OVER (PARTITION BY repo_id ORDER BY updated_at DESC NULLS LAST, id) AS nth FROM mems WHERE repo_id IS NOT NULL",
    "vector_dims": BASE + " SELECT model_name, coalesce(dimensions, -1) AS dimensions, coalesce(len(vector), -1)::INT AS actual, count(*) AS n FROM vecs GROUP BY ALL",
    "snippet_lines": BASE + r""", src AS (SELECT file_id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM source_files WHERE content IS NOT NULL),
 cuts AS (SELECT s.id, coalesce(array_to_string(src.lines[s.line_start:s.line_end], chr(10)), '') AS cut FROM syms s JOIN src USING (file_id) WHERE line_start >= 1 AND line_end >= line_start) SELECT id, length(cut) AS chars, md5(cut) AS digest FROM cuts""",
    "log_recent": "SELECT * FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 10",
    "log_stage_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "classify_files": BASE + " SELECT id, is_test::INT AS is_test, is_doc::INT AS is_doc, is_config::INT AS is_config, is_code::INT AS is_code, (is_test OR is_doc OR is_config)::INT AS is_support FROM files_now",
    "skip_paths": BASE + r""" SELECT id, (list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.pytest_cache', '.venv', 'node_modules', 'build', 'dist']) OR NOT regexp_matches(lower(path), '[^/]\.(py|md|rst|toml|yaml|yml|json|cfg|ini)$'))::INT AS skipped FROM files_now""",
    "active_memories": BASE + " SELECT coalesce(repo_id, -1) AS owner, count(*) AS n FROM mems WHERE status = 'active' GROUP BY 1",
    "doc_parse": r"SELECT doc_id, 'Markdown document ' || doc_id || ': ' || left(regexp_replace(coalesce(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: regexp_matches(x, '[^ \t]'))[1], ''), '^[# \t]+|[# \t]+$', '', 'g'), 120) AS summary FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)",
    "checksum": "SELECT DISTINCT doc_id, sha256(text) AS digest FROM documents",
    "embed_bow": r"SELECT doc_id, ('0x' || sha256(t)[1:2])::INT % 16 AS bucket, sum(CASE WHEN ('0x' || sha256(t)[3:4])::INT % 2 = 1 THEN -n ELSE n END)::DOUBLE AS value FROM (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s\x{0B}]+')) AS t FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)) WHERE t <> '' GROUP BY ALL) GROUP BY ALL",
    "vector_topk": "SELECT * FROM (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS nth FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)), 6) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) WHERE sim > 0) WHERE nth <= 10",
    "graph_neighbors": BASE + ", b AS (SELECT fk AS kind, fid AS node, id, tk AS to_kind, tid AS to_id FROM edg WHERE fid IS NOT NULL AND tid IS NOT NULL UNION ALL SELECT tk, tid, id, fk, fid FROM edg WHERE fid IS NOT NULL AND tid IS NOT NULL AND NOT (fk = tk AND fid = tid)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, node ORDER BY id) AS nth FROM b) WHERE nth <= 20",
    "graph_edges": BASE + " SELECT fk, tk, edge_type, count(*) AS n, round(sum(weight), 3) AS weight FROM edg GROUP BY ALL",
    "contains_edges": BASE + " SELECT repo_id, file_id AS from_id, id AS to_id, 'FILE_CONTAINS_SYMBOL' AS edge_type FROM syms WHERE file_id IS NOT NULL",
    "import_edges": BASE + f", {_MODULES} SELECT i.repo_id, i.id AS from_id, m.file_id AS to_id, 'FILE_IMPORTS_FILE' AS edge_type FROM (SELECT repo_id, id, unnest(imports) AS module FROM files_now) i JOIN modules m ON m.repo_id = i.repo_id AND m.module = i.module",
    "test_cover_edges": BASE + f", {_COVER} SELECT c.repo_id, c.from_id, s.id AS to_id, 'TEST_COVERS_SYMBOL' AS edge_type FROM cover c JOIN syms s ON s.file_id = c.to_id",
    "doc_edges": BASE + f", {_DESCRIBES} SELECT repo_id, doc_id AS from_id, symbol_id AS to_id, 'DOC_DESCRIBES_SYMBOL' AS edge_type, 0.8::DOUBLE AS weight, 1::BIGINT AS n FROM pairs UNION ALL SELECT repo_id, doc_id, file_id, 'DOC_DESCRIBES_FILE', 0.9, count(*) FROM pairs GROUP BY repo_id, doc_id, file_id",
    "config_edges": BASE + f""", cfg AS (SELECT * FROM (SELECT repo_id, id AS from_id, lower(path || ' ' || coalesce(summary, '') || ' ' || coalesce(excerpt, '')) AS txt, list_distinct(list_filter({_W4.format("lower(path || ' ' || coalesce(summary, '') || ' ' || coalesce(excerpt, ''))", '_')}, lambda t: t NOT IN ('config', 'configs', 'document', 'settings', 'default', 'value', 'values', 'enabled', 'workspace'))) AS terms FROM files_now WHERE is_config) WHERE len(terms) > 0),
 nm AS (SELECT file_id AS id, string_agg(lower(coalesce(name, '')) || ' ' || lower(coalesce(summary, '')), ' ') AS names FROM syms GROUP BY 1),
 code AS (SELECT repo_id, f.id AS to_id, lower(path) || ' ' || lower(coalesce(summary, '')) || ' ' || lower(array_to_string(coalesce(imports, []), ' ')) || ' ' || coalesce(names, '') AS hay,
   [lower(replace(regexp_replace(path, '\\.py$', ''), '/', '.')), lower(replace(regexp_replace(path, '\\.ts$', ''), '/', '.')), lower(replace(regexp_replace(path, '\\.js$', ''), '/', '.'))] AS hints FROM files_now f LEFT JOIN nm ON nm.id = f.id WHERE is_code),
 x AS (SELECT c.repo_id, from_id, to_id, list_sort(list_filter(terms, lambda t: contains(hay, t))) AS hit, len(list_filter(hints, lambda h: h <> '' AND contains(txt, h))) > 0 AS hinted FROM cfg c JOIN code k ON k.repo_id = c.repo_id)
 SELECT repo_id, from_id, to_id, len(hit)::INT AS n_terms, hinted::INT AS hinted, round(1.0 + least(len(hit), 4) * 0.1 + CASE WHEN hinted THEN 0.2 ELSE 0 END, 6)::DOUBLE AS weight, array_to_string(hit[1:6], ' ') AS terms FROM x WHERE len(hit) >= 2 OR hinted""",
    "memory_links": BASE + f""", mw AS (SELECT repo_id, id AS memory_id, unnest(list_distinct(list_filter({_W4.format("lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content, ''))", '_')}, lambda t: t NOT IN ({_STOP})))) AS w FROM mems WHERE repo_id IS NOT NULL),
 nw AS (SELECT repo_id, 'file' AS node_kind, id AS node_id, unnest(list_distinct({_W4.format("lower(path || ' ' || coalesce(summary, ''))", '')})) AS w FROM files_now
   UNION ALL SELECT repo_id, 'symbol', id, unnest(list_distinct({_W4.format("lower(coalesce(name, '') || ' ' || coalesce(qualified_name, '') || ' ' || coalesce(summary, ''))", '')})) FROM syms),
 hits AS (SELECT memory_id, node_kind, node_id, count(*) + (node_kind = 'symbol')::INT AS score FROM mw JOIN nw ON nw.repo_id = mw.repo_id AND nw.w = mw.w GROUP BY memory_id, node_kind, node_id)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, node_kind DESC, node_id DESC) AS nth FROM hits) WHERE nth <= 4""",
    "memory_from_docs": BASE + r""", l AS (SELECT *, list_filter(string_split(excerpt, chr(10)), lambda x: trim(x) <> '') AS lines FROM files_now WHERE is_doc AND excerpt IS NOT NULL),
 m AS (SELECT repo_id, id, regexp_replace(list_filter(lines, lambda x: x LIKE '#%')[1], '^#+\s*', '') AS title, list_filter(lines, lambda x: x NOT LIKE '#%')[1] AS summary, CASE WHEN contains(path, '/adr/') THEN 'decision' WHEN contains(path, '/runbooks/') THEN 'runbook_note' ELSE 'design_note' END AS memory_type FROM l)
 SELECT * FROM m WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mems WHERE mems.repo_id = m.repo_id AND mems.title = m.title)""",
    "parent_resolution": BASE + ", n AS (SELECT file_id, name AS qualifier, max(id) AS parent_id FROM syms GROUP BY ALL) SELECT s.id, n.parent_id FROM syms s JOIN n ON n.file_id = s.file_id AND n.qualifier = split_part(s.qualified_name, '.', 1) WHERE contains(s.qualified_name, '.') AND n.parent_id <> s.id",
    "change_diff": BASE + f", {_CURRENT_STATE} SELECT CASE WHEN s.file_id IS NULL THEN 'added' WHEN f.id IS NULL THEN 'removed' WHEN f.checksum IS NOT DISTINCT FROM s.digest THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM files_now f FULL JOIN state s ON s.file_id = f.id GROUP BY 1",
    "prune": BASE + f", {_CURRENT_STATE} SELECT file_id FROM state WHERE file_id IN (SELECT id FROM files_now)",
    "upsert": BASE + f", {_CURRENT_STATE} SELECT id AS file_id, checksum AS digest FROM files_now UNION ALL SELECT file_id, digest FROM state WHERE file_id NOT IN (SELECT id FROM files_now)",
    "cascade": BASE + ", gone AS (SELECT DISTINCT lower(trim(node_kind)) AS kind, node_id AS id FROM node_tombstones) SELECT fk, tk, count(*) AS n FROM edg e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.kind = e.fk AND g.id = e.fid) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.kind = e.tk AND g.id = e.tid) GROUP BY ALL",
    "reconcile": BASE + ", n AS (SELECT 'file' AS kind, id FROM files_now UNION ALL SELECT 'symbol', id FROM syms UNION ALL SELECT 'memory', id FROM mems), v AS (SELECT DISTINCT node_kind AS kind, node_id AS id FROM vecs) SELECT coalesce(n.kind, v.kind) AS kind, count(n.id) AS n_nodes, count(*) FILTER (n.id IS NOT NULL AND v.id IS NOT NULL) AS n_embedded, count(*) FILTER (n.id IS NULL) AS n_stale FROM n FULL JOIN v ON v.kind = n.kind AND v.id = n.id GROUP BY 1",
    "nested_exclusion": BASE + ", r AS (SELECT DISTINCT id, regexp_replace(local_path, '/+$', '') AS root FROM repos), f AS (SELECT f.repo_id, r.root, r.root || '/' || f.path AS p FROM files_now f JOIN r ON r.id = f.repo_id) SELECT repo_id, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id <> f.repo_id AND length(r.root) > length(f.root) AND starts_with(f.p, r.root || '/')) GROUP BY 1",
    "memory_link_targets": BASE + ", n AS (SELECT 'file' AS k, id FROM files_now UNION ALL SELECT 'symbol', id FROM syms) SELECT e.tk, e.edge_type, count(*) AS n, count(n.id) AS n_valid FROM edg e LEFT JOIN n ON n.k = e.tk AND n.id = e.tid WHERE e.fk = 'memory' AND e.tid IS NOT NULL GROUP BY ALL",
    "gold_spans": r"SELECT instance_id, (i - 1)::INT AS nth, regexp_replace(replace(json_extract_string(g, '$[' || (i - 1) || '].file'), '\', '/'), '^[./]+', '') AS file, json_extract(g, '$[' || (i - 1) || '].start_line')::INT AS first, json_extract(g, '$[' || (i - 1) || '].end_line')::INT AS last FROM (SELECT instance_id, g, unnest(range(1, json_array_length(g)::BIGINT + 1)) AS i FROM (SELECT DISTINCT instance_id, gold_context::JSON AS g FROM eval_items WHERE gold_context IS NOT NULL))",
    "row_filters": "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM (SELECT DISTINCT * FROM eval_items) WHERE gold_context IS NOT NULL GROUP BY 1",
    "skip_accounting": "WITH k AS (SELECT regexp_extract(name, '^([a-z]+)-([a-z]+)', 1) || '/' || regexp_extract(name, '^([a-z]+)-([a-z]+)', 2) AS repo, max(current_commit_sha) AS c FROM repos GROUP BY 1) SELECT CASE WHEN k.repo IS NULL THEN 'repo_not_mapped' WHEN k.c IS NULL THEN 'commit_mismatch' ELSE 'evaluated' END AS outcome, count(*) AS n FROM (SELECT DISTINCT instance_id, repo FROM eval_items) i LEFT JOIN k ON k.repo = i.repo GROUP BY 1",
    "term_lookup": f"SELECT len(list_filter([{_TEXT_TERMS}], lambda t: contains(lower(text), t)))::INT AS n, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) GROUP BY 1",
    "best_per_path": "SELECT path, score, id FROM (SELECT path, length(coalesce(summary, ''))::INT AS score, id, row_number() OVER (PARTITION BY path ORDER BY length(coalesce(summary, '')) DESC, id, indexed_at DESC) AS n FROM files WHERE path IS NOT NULL) WHERE n = 1",
}
_SPANS = r"sp AS (SELECT s.id, s.file_id, regexp_replace(replace(f.path, '\', '/'), '^[./]+', '') AS file, least(s.line_start, s.line_end) AS low, greatest(s.line_start, s.line_end) AS high FROM syms s JOIN files_now f ON f.id = s.file_id WHERE s.line_start IS NOT NULL AND s.line_end IS NOT NULL)"
SQL["span_overlap"] = BASE + ", gold AS (" + SQL["gold_spans"] + "), " + _SPANS + " SELECT * FROM gold g WHERE EXISTS (SELECT 1 FROM sp WHERE sp.file = g.file AND g.first <= sp.high AND g.last >= sp.low)"
SQL["span_recall"] = BASE + ", " + _SPANS + """, g AS (SELECT file_id, id, low AS first, high + id % 40 AS last FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id) AS n FROM sp) WHERE n = 1),
 h AS (SELECT g.file_id, max((g.first <= o.high AND g.last >= o.low)::INT) AS hit FROM g JOIN sp o ON o.file_id = g.file_id AND o.id <> g.id GROUP BY 1) SELECT file_id, 1::BIGINT AS n_spans, hit::BIGINT AS n_hit, hit::DOUBLE AS recall FROM h"""

QUERIES = {
    f.__name__: f
    for f in (
        glob_filter, effective_excludes, repo_files, repo_lookup, list_repos, list_memories, vector_dims, snippet_lines, log_recent, log_stage_counts, classify_files, skip_paths, active_memories, doc_parse, checksum, embed_bow, vector_topk,
        graph_neighbors, graph_edges, contains_edges, import_edges, import_edges_linked, test_cover_edges, test_cover_edges_linked, doc_edges, config_edges, memory_links, memory_from_docs, parent_resolution, change_diff, prune, upsert, cascade, reconcile, nested_exclusion, memory_link_targets,
        gold_spans, span_overlap, span_recall, baseline_retriever, row_filters, skip_accounting, term_lookup, best_per_path, parse_sources, path_tags,
    )
}
