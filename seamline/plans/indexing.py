"""An index of repositories: scan, compare, parse, link and embed as one flow of snapshots.

An ``Index`` is a folder of tables. Each table is kept in parts by repository;
a run writes new parts for the repositories it has indexed and commits them all
in one version, so readers see either the old index or the new one. Rows of
other repositories are neither read nor rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import EmbeddingProvider, provider
from ..operators import catalog, edges, parsers, snapshot
from ..operators.versions import Versions, VersionTaken
from ..session import cut
from ..sources import tree

# Default globs of a scan.
INCLUDE = ("**/*.py", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.md", "**/*.json", "**/*.yaml", "**/*.yml", "**/*.toml")
EXCLUDE = (
    ".git/**", "**/.git/**", "node_modules/**", "**/node_modules/**", ".venv/**", "**/.venv/**", "venv/**", "**/venv/**",
    "dist/**", "**/dist/**", "build/**", "**/build/**", "__pycache__/**", "**/__pycache__/**", ".pytest_cache/**", "**/.pytest_cache/**",
)
# What an index run leaves out in any case.
ALWAYS_EXCLUDE = ("**/.git/**", "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/dist/**", "**/build/**", "**/__pycache__/**", "**/.pytest_cache/**")
# Languages whose text is kept in part, characters kept of it and of what was embedded.
EXCERPT_LANGUAGES, EXCERPT_CHARS, PREVIEW_CHARS = ("markdown", "json", "yaml", "toml"), 4000, 250
#: Edges that a run makes anew; all others are someone's own.
DERIVED = ("FILE_CONTAINS_SYMBOL", "FILE_IMPORTS_FILE", "TEST_COVERS_SYMBOL", "DOC_DESCRIBES_SYMBOL", "DOC_DESCRIBES_FILE", "CONFIG_AFFECTS_FILE")
SCHEMAS = {
    "repos": "id long, name string, local_path string, default_branch string, active_branch string, current_commit_sha string, include_globs array<string>, exclude_globs array<string>, created_at timestamp, updated_at timestamp",
    "files": "id long, repo_id long, path string, language string, checksum string, commit_sha string, summary string, imports array<string>, tags array<string>, metadata_json map<string,string>, indexed_at timestamp, error string",
    "symbols": "id long, repo_id long, file_id long, parent_symbol_id long, name string, qualified_name string, symbol_type string, language string, line_start int, line_end int, signature string, docstring string, summary string",
    "memories": "id long, repo_id long, title string, content string, summary string, memory_type string, status string, source string, confidence double, author string, owner string, valid_from timestamp, valid_to timestamp, created_at timestamp, updated_at timestamp, metadata_json map<string,string>",
    "edges": "id long, repo_id long, from_node_kind string, from_node_id long, to_node_kind string, to_node_id long, edge_type string, weight double, metadata_json map<string,string>, created_at timestamp",
    "node_embeddings": "id long, repo_id long, node_kind string, node_id long, embedding_role string, model_name string, dimensions int, vector array<float>, content_preview string",
    "retrieval_logs": "id long, repo_id long, query_text string, mode string, retrieved_node_ids array<struct<node: string, rank: int>>, scores array<struct<node: string, score: double>>, diagnostics_json string, packed_context string, created_at timestamp",
}


def effective_excludes(own: Column | str) -> Column:
    """A repository's own globs, the defaults and those of every run, each once in this order."""
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(*map(F.lit, EXCLUDE + ALWAYS_EXCLUDE))))


def stable_id(*columns: Column | str) -> Column:
    """A positive 63-bit id that follows from a natural key."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1))


class Index(Versions):
    """Tables of SCHEMAS under a folder, with the writers of the index.

    Ids follow from natural keys, so a run that is repeated gives the same rows.
    Fields that a table's older parts lack read as null.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: EmbeddingProvider | None = None):
        super().__init__(spark, root)
        self.embedder = embedder or provider()

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self._load(version) if version else {}

    def table(self, name: str, repos: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table, of all repositories or of some; empty before the first write."""
        parts = self._manifest(version).get(name, {})
        wanted = None if repos is None else {str(r) for r in repos}
        folders = [f"{self.root}/{f}" for p, fs in parts.items() if wanted is None or p in wanted for f in fs]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMAS[name])

    def _write(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        folder = f"{name}-{uuid.uuid4().hex}"
        columns = [c.split(":")[0].strip() for c in self.spark.createDataFrame([], SCHEMAS[name]).columns]
        rows = df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema))
        part = F.col("id") if name == "repos" else F.coalesce("repo_id", F.lit(-1).cast("long"))
        # few files a part, and a large repository in several
        rows.withColumn("part", part).hint("rebalance", F.col("part")).write.partitionBy("part").parquet(f"{self.root}/{folder}")
        return {n[5:]: [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("part=")}

    def commit(self, replaced: dict[str, tuple[DataFrame, list[int]]] | None = None, appended: dict[str, DataFrame] | None = None, base: int | None = None, attempts: int = 8) -> int:
        """Write and swap: ``replaced`` gives a table's new rows of some repositories, ``appended`` rows to add.

        If another writer commits in between, the swap is tried again on top of
        it, unless it changed a part that this commit replaces: then VersionTaken
        is raised and nothing is changed.
        """
        base = self.version() if base is None else base
        seen = self._manifest(base)
        new = {n: (self._write(n, df), {str(r) for r in repos}) for n, (df, repos) in (replaced or {}).items()}
        more = {n: self._write(n, df) for n, df in (appended or {}).items()}
        for _ in range(attempts):
            at = self.version()
            manifest = self._manifest(at)
            for n, (parts, repos) in new.items():
                if any(manifest.get(n, {}).get(r) != seen.get(n, {}).get(r) for r in repos):
                    raise VersionTaken(f"{self.root}: {n} changed since version {base}")
                manifest[n] = {**{p: f for p, f in manifest.get(n, {}).items() if p not in repos}, **parts}
            for n, parts in more.items():
                manifest[n] = {**manifest.get(n, {}), **{p: manifest.get(n, {}).get(p, []) + f for p, f in parts.items()}}
            try:
                self._claim(at + 1, manifest)
                return at + 1
            except VersionTaken:
                continue
        raise VersionTaken(f"{self.root}: {attempts} commits lost to other writers")

    # repositories ----------------------------------------------------------

    def add_repo(self, name: str, local_path: str, default_branch: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> int:
        """Register a repository with the default globs unless others are given; its name and path must be new."""
        known = self.table("repos").where((F.col("name") == name) | (F.col("local_path") == local_path.rstrip("/")))
        if not known.isEmpty():
            raise ValueError(f"Repo exists already: {name}")
        branch, commit = tree.git_head(local_path)
        row = self.spark.createDataFrame([(name, local_path.rstrip("/"), default_branch, branch, commit, include or list(INCLUDE), exclude or list(EXCLUDE))], "name string, local_path string, default_branch string, active_branch string, current_commit_sha string, include_globs array<string>, exclude_globs array<string>")
        row = cut(row.select(stable_id("name").alias("id"), "*", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")))
        self.commit(appended={"repos": row})
        return row.first()["id"]

    def repo(self, name: str):
        """The row of a repository; raises ValueError if there is none."""
        row = self.table("repos").where(F.col("name") == name).orderBy(F.desc("updated_at")).first()
        if row is None:
            raise ValueError(f"Unknown repo: {name}")
        return row

    def scan(self, name: str) -> DataFrame:
        """(repo_id, path, text) of the files of a repository's tree, by its globs, without repositories inside it."""
        repo = self.repo(name)
        tree.register(self.spark)
        exclude = list(dict.fromkeys((repo.exclude_globs or []) + list(EXCLUDE + ALWAYS_EXCLUDE)))
        found = self.spark.read.format("source_tree").option("include", ",".join(repo.include_globs or INCLUDE)).option("exclude", ",".join(exclude)).load(repo.local_path)
        full = found.select(F.lit(repo.id).alias("repo_id"), F.concat(F.lit(repo.local_path + "/"), "path").alias("full_path"), "text")
        kept = snapshot.outside_nested(full, self.table("repos").select("id", "local_path"))
        return kept.select("repo_id", F.substring("full_path", len(repo.local_path) + 2, 2**31 - 1).alias("path"), "text")

    def index_repo(self, name: str) -> dict:
        """Bring the index of a repository up to its tree; counts of files."""
        texts = cut(self.scan(name))
        counts = self.index_texts(texts, [self.repo(name).id]).first()
        return {"repo": name, **({k: counts[k] for k in ("indexed", "skipped", "discovered")} if counts else {"indexed": 0, "skipped": 0, "discovered": 0})}

    # the flow --------------------------------------------------------------

    def index_texts(self, texts: DataFrame, repos: list[int]) -> DataFrame:
        """Index (repo_id, path, text), the whole trees of ``repos``; (repo_id, indexed, skipped, discovered).

        Files with the checksum they had are left as they are, files that are
        gone are dropped with their symbols, edges and vectors, changed files
        replace their symbols. Edges that someone made stay unless a node of
        theirs is gone. A file that does not parse keeps its row with the error.
        """
        base = self.version()
        old = {n: self.table(n, repos, base) for n in ("files", "symbols", "edges", "node_embeddings", "memories")}
        texts = texts.where(F.col("path").isNotNull()).select("repo_id", "path", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["repo_id", "path"])
        scanned = texts.withColumn("checksum", F.sha2("text", 256)).withColumn("file_id", stable_id("repo_id", "path"))
        change = cut(snapshot.diff(scanned.select("file_id", "checksum"), old["files"].select(F.col("id").alias("file_id"), "checksum"), ["file_id"], "checksum"))
        todo = scanned.join(change.where("change in ('added', 'changed')").select("file_id"), "file_id", "left_semi")
        todo = todo.withColumn("excerpt", F.substring("text", 1, EXCERPT_CHARS))
        parsed = cut(parsers.parse_files(todo, ("repo_id", "path", "checksum", "excerpt")))
        commits = self.table("repos").select(F.col("id").alias("repo_id"), F.col("current_commit_sha").alias("commit_sha")).dropDuplicates(["repo_id"])
        excerpt = F.when(F.col("language").isin(*EXCERPT_LANGUAGES), F.map_concat(F.create_map(F.lit("parser"), "language"), F.create_map(F.lit("content_excerpt"), "excerpt"))).otherwise(F.create_map(F.lit("parser"), "language"))
        files_new = parsed.join(commits, "repo_id", "left").select(F.col("file_id").alias("id"), "repo_id", "path", "language", "checksum", "commit_sha", "summary", "imports", parsers.path_tags("path").alias("tags"), excerpt.alias("metadata_json"), F.current_timestamp().alias("indexed_at"), "error")
        stays = change.where("change != 'removed'").select(F.col("file_id").alias("id"))
        files = cut(snapshot.upsert(snapshot.prune(old["files"], stays, ["id"]), files_new, ["id"]))
        # symbols: those of untouched files, and all of the parsed ones
        touched = change.where("change != 'same'").select("file_id")
        made = parsed.select("repo_id", "file_id", "language", F.explode("symbols").alias("s")).select("repo_id", "file_id", "language", "s.*")
        made = made.withColumn("id", stable_id("file_id", "name", "line_start", "line_end")).dropDuplicates(["id"])
        parents = edges.resolved_parents(made).withColumnRenamed("parent_id", "parent_symbol_id")
        made = made.join(parents, "id", "left")
        symbols = cut(old["symbols"].join(touched, "file_id", "left_anti").unionByName(made.select(*old["symbols"].columns)))
        # what is gone takes its edges and vectors along
        gone = change.where("change = 'removed'").select(F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(old["symbols"].select("id").join(symbols.select("id"), "id", "left_anti").select(F.lit("symbol").alias("kind"), "id"))
        own = old["edges"].where(~F.col("edge_type").isin(*DERIVED))
        kept = snapshot.cascade(own.withColumnsRenamed({"from_node_kind": "fk", "from_node_id": "fid", "to_node_kind": "tk", "to_node_id": "tid"}), gone).withColumnsRenamed({"fk": "from_node_kind", "fid": "from_node_id", "tk": "to_node_kind", "tid": "to_node_id"})
        linked = kept.unionByName(self.derived_edges(files, symbols), allowMissingColumns=True)
        stale = gone.unionByName(parsed.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"))).unionByName(made.select(F.lit("symbol").alias("kind"), "id"))
        fresh = self.embedded(files_new.select(F.lit("file").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "path").alias("content")).unionByName(made.select(F.lit("symbol").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "signature", "name").alias("content"))))
        vectors = old["node_embeddings"].join(stale.select(F.col("kind").alias("node_kind"), F.col("id").alias("node_id")).distinct(), ["node_kind", "node_id"], "left_anti").unionByName(fresh)
        self.commit({"files": (files, repos), "symbols": (symbols, repos), "edges": (linked, repos), "node_embeddings": (vectors, repos)}, base=base)
        counts = change.where("change != 'removed'").join(files.select(F.col("id").alias("file_id"), "repo_id"), "file_id")
        return counts.groupBy("repo_id").agg(F.count_if(F.col("change") != "same").alias("indexed"), F.count_if(F.col("change") == "same").alias("skipped"), F.count(F.lit(1)).alias("discovered"))

    def derived_edges(self, files: DataFrame, symbols: DataFrame) -> DataFrame:
        """All edges that follow from files and symbols, in the form of the table."""
        f, s = cut(catalog.files(files)), catalog.symbols(symbols)

        def rows(df, to_kind, weight="weight"):
            w = F.col("weight") if weight in df.columns else F.lit(1.0)
            terms = F.create_map(F.lit("matched_terms"), "terms") if "terms" in df.columns else F.create_map().cast("map<string,string>")
            return df.select("repo_id", F.lit("file").alias("from_node_kind"), F.col("from_id").alias("from_node_id"), F.lit(to_kind).alias("to_node_kind"), F.col("to_id").alias("to_node_id"), "edge_type", w.alias("weight"), terms.alias("metadata_json"))

        doc = edges.doc_edges(edges.describes(f, s))
        out = (
            rows(edges.contains_symbol(s), "symbol").unionByName(rows(edges.imports_file(f), "file")).unionByName(rows(edges.test_covers_symbol(f, s), "symbol"))
            .unionByName(rows(doc.where("edge_type = 'DOC_DESCRIBES_SYMBOL'"), "symbol")).unionByName(rows(doc.where("edge_type = 'DOC_DESCRIBES_FILE'"), "file"))
            .unionByName(rows(edges.config_edges(f, s).withColumn("edge_type", F.lit("CONFIG_AFFECTS_FILE")), "file"))
        )
        return out.withColumn("id", stable_id("edge_type", "from_node_id", "to_node_id")).withColumn("created_at", F.current_timestamp()).dropDuplicates(["id"])

    def embedded(self, nodes: DataFrame) -> DataFrame:
        """Rows of node_embeddings for (node_kind, node_id, repo_id, content)."""
        nodes = nodes.withColumn("id", stable_id("node_kind", "node_id", F.lit("summary"))).dropDuplicates(["id"])
        vector = self.embedder.embed(nodes.select("id", "content"), "id", "content").select("id", F.col("vector").cast("array<float>").alias("vector"))
        return nodes.join(vector, "id").select(
            "id", "repo_id", "node_kind", "node_id", F.lit("summary").alias("embedding_role"), F.lit(self.embedder.model_name).alias("model_name"), F.lit(self.embedder.dimensions).alias("dimensions"), "vector", F.substring("content", 1, PREVIEW_CHARS).alias("content_preview")
        )

    # single writers --------------------------------------------------------

    def add_edges(self, rows: DataFrame) -> int:
        """Append edges (repo_id, from_node_kind, from_node_id, to_node_kind, to_node_id, edge_type[, weight, metadata_json]); repeats stay."""
        made = rows.withColumns({"id": stable_id("from_node_kind", "from_node_id", "to_node_kind", "to_node_id", "edge_type", F.expr("uuid()")), "created_at": F.current_timestamp(), "weight": F.coalesce("weight", F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)})
        return self.commit(appended={"edges": cut(made)})

    def create_memories(self, rows: DataFrame) -> DataFrame:
        """Append memories (title, content, memory_type[, ...]) with their vectors; the rows with their ids.

        Missing fields take their defaults: active, manual, confidence 1, no repository.
        """
        have = lambda c, kind, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default).cast(kind)
        made = rows.withColumns({
            "repo_id": have("repo_id", "long", None), "summary": have("summary", "string", None), "status": have("status", "string", "active"), "source": have("source", "string", "manual"),
            "confidence": have("confidence", "double", 1.0), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "id": stable_id("title", F.expr("uuid()")),
        })
        made = cut(made)
        vectors = self.embedded(made.select(F.lit("memory").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "content").alias("content")))
        self.commit(appended={"memories": made, "node_embeddings": vectors})
        return made

    def link_memories(self, links: DataFrame) -> int:
        """Append edges from memories (from_memory_id, to_node_kind, to_node_id[, edge_type]); the repository is the memory's."""
        owner = catalog.once(self.table("memories")).select(F.col("id").alias("from_memory_id"), "repo_id")
        kind = F.coalesce("edge_type", F.lit("APPLIES_TO")) if "edge_type" in links.columns else F.lit("APPLIES_TO")
        made = links.withColumn("edge_type", kind).join(owner, "from_memory_id", "left")
        return self.add_edges(made.select("repo_id", F.lit("memory").alias("from_node_kind"), F.col("from_memory_id").alias("from_node_id"), "to_node_kind", "to_node_id", "edge_type"))

    def append_logs(self, retrieval) -> int:
        """Append one retrieval log per query of a ``Retrieval``: its 25 best nodes with ranks and scores, stage counts, and the packed context."""
        node = F.concat_ws(":", "kind", F.col("id").cast("string"))
        best = retrieval.ranking.where("rank <= 25").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", node.alias("node"), "score"))).alias("b"))
        counts = retrieval.stage_members.groupBy("query_id", "stage", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("stage", "kind", "n")))).alias("diagnostics_json"))
        context = retrieval.context.select("query_id", F.to_json(F.struct("files", "symbols", "memories")).alias("packed_context"))
        rows = retrieval.queries.select("query_id", "repo_id", F.col("text").alias("query_text"), "mode").join(best, "query_id", "left").join(counts, "query_id", "left").join(context, "query_id", "left")
        empty = F.coalesce("b", F.array().cast("array<struct<rank:int,node:string,score:double>>"))
        return self.commit(appended={"retrieval_logs": rows.select(
            stable_id("query_text", F.expr("uuid()")).alias("id"), "repo_id", "query_text", "mode", F.transform(empty, lambda x: F.struct(x["node"].alias("node"), x["rank"].cast("int").alias("rank"))).alias("retrieved_node_ids"),
            F.transform(empty, lambda x: F.struct(x["node"].alias("node"), x["score"].cast("double").alias("score"))).alias("scores"), "diagnostics_json", "packed_context", F.current_timestamp().alias("created_at"),
        )})

    def reconcile_embeddings(self, embedder: EmbeddingProvider | None = None) -> dict:
        """Replace all vectors by new ones of every file, symbol and memory; counts before and after."""
        self.embedder = embedder or self.embedder
        base = self.version()
        before = self.table("node_embeddings", version=base)
        f, s, m = (self.table(n, version=base) for n in ("files", "symbols", "memories"))
        nodes = (
            f.select(F.lit("file").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "path").alias("content"))
            .unionByName(s.select(F.lit("symbol").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "signature", "name").alias("content")))
            .unionByName(m.select(F.lit("memory").alias("node_kind"), F.col("id").alias("node_id"), "repo_id", F.coalesce("summary", "content").alias("content")))
        )
        rows = cut(self.embedded(nodes))
        parts = sorted(self._manifest(base).get("node_embeddings", {}))
        self.commit({"node_embeddings": (rows, [int(p) for p in parts])}, base=base)
        return {"cleared_embeddings": before.count(), "final_embedding_count": rows.count(), "memory_embeddings_rebuilt": rows.where("node_kind = 'memory'").count(), "target_dimensions": self.embedder.dimensions}
