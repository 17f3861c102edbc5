"""Hybrid retrieval over a set of queries, as one relational plan.

What a ranking loop would keep in mutable score maps is one long table of
signals (query, node, stage, seq, points, reason): scores are sums, the order of
first insertion is the least seq, and reasons are resolved by seq. Every query
names its repository, so each table meets the small, broadcast query set by an
equality on the repository.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..functions.vectors import dot, embed
from ..operators import catalog, graph
from ..session import cut, table
from . import settings as S

GLOBAL = -1  # stands for the repository of memories that belong to none
TABLES = ("files", "symbols", "memories", "edges", "node_embeddings", "source_files")
STAGE = 10**13
DIMS = 64
SIGNAL = ["query_id", "kind", "id", "stage", "seq", "points", "reason", "firm"]


def query_frame(spark: SparkSession, queries: list[tuple]) -> DataFrame:
    """Literal table of (query_id, repo_id, mode, text, lim) with everything that follows from a query alone."""
    rows = []
    for q, repo, mode, text, lim in queries:
        doc, config, test, history = (C.mentions(text, w) for w in (C.DOC_WORDS, C.CONFIG_WORDS, C.TEST_WORDS, C.HISTORY_WORDS))
        about_config = C.mentions(text, ("config",))
        rows.append((q, repo, mode, text, lim, *S.MODE_WEIGHTS.get(mode, S.MODE_WEIGHTS["understand"]), doc, config, test, history, about_config, *S.select_mix(mode, doc, config, test, S.quotas(mode, lim)[0]), *S.pack_mix(mode, doc, config, test), *S.quotas(mode, lim), *S.pack_limits(mode)))
    ints = "s_code s_test s_doc s_config p_code p_test p_doc p_config q_files q_symbols q_memories p_symbols p_memories".split()
    schema = "query_id long, repo_id long, mode string, text string, lim int, wl double, wg double, ws double, wm double, doc boolean, config boolean, test boolean, history boolean, about_config boolean, " + ", ".join(f"{c} int" for c in ints)
    return spark.createDataFrame(rows, schema)


def _when_mode(*cases, other) -> Column:
    c = None
    for modes, value in cases:
        c = (F if c is None else c).when(F.col("mode").isin(*modes), value)
    return c.otherwise(other)


class Retrieval:
    """The stages of one retrieval; each is a lazily built DataFrame property."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], queries: list[tuple]):
        # current rows are settled once, since most stages read them; edges and vectors are settled after the query set has filtered them
        self.files = cut(catalog.files(tables["files"]).drop("excerpt"))
        self.symbols = cut(catalog.symbols(tables["symbols"]).select("id", "repo_id", "file_id", "name", "qualified_name", "symbol_type", "line_start", "line_end", "docstring", "summary"))
        self.memories = catalog.memories(tables["memories"])
        self.sources = tables["source_files"].where("file_id is not null and content is not null").select("file_id", "content")
        self.edges, self.vectors = catalog.edge_rows(tables["edges"]), catalog.embedding_rows(tables["node_embeddings"])
        q = query_frame(spark, queries)
        self.queries = q.withColumns({"terms": T.query_terms("text"), "rterms": T.rerank_terms("text"), "aliases": T.query_aliases("text")})
        self._memo: dict[str, DataFrame] = {}

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, queries: list[tuple]) -> Retrieval:
        return cls(spark, {n: table(spark, sf_dir, n) for n in TABLES}, queries)

    def _once(self, name: str, build, small: bool = True) -> DataFrame:
        """Build a stage once. Small stages (a bounded number of rows per query) are written and their lineage is cut."""
        if name not in self._memo:
            df = build()
            self._memo[name] = cut(df) if small else df
        return self._memo[name]

    def _q(self, *columns: str) -> DataFrame:
        return F.broadcast(self.queries.select("query_id", "repo_id", *columns))

    # lexical ---------------------------------------------------------------

    def _top(self, scored: DataFrame, label: Column, limit: str = "lim") -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), label.desc(), F.desc("id"))
        return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col(limit))

    @property
    def lexical_files(self) -> DataFrame:
        def build():
            path, summary = F.lower("path"), F.lower(F.coalesce("summary", F.lit("")))
            base = F.substring_index(path, "/", -1)
            slashed = F.concat(F.lit("/"), path, F.lit("/"))
            each = lambda t: T.points((F.contains(path, t) & F.startswith(base, t), 6), (F.contains(path, t) & ~F.startswith(base, t), 4), (F.contains(summary, t), 3), (F.contains(slashed, F.concat(F.lit("/"), t, F.lit("/"))), 2))
            hit = self.files.join(self._q("terms", "lim"), "repo_id").withColumn("score", T.total("terms", each))
            return self._top(hit, F.col("path")).select("query_id", "rank", "id", "score", "path", "is_support")

        return self._once("lexical_files", build)

    @property
    def lexical_symbols(self) -> DataFrame:
        def build():
            name, qualified, summary, doc = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "qualified_name", "summary", "docstring"))
            each = lambda t: T.points((name == t, 10), (F.contains(name, t), 7), (F.contains(qualified, t), 5), (F.contains(summary, t), 3), (F.contains(doc, t), 2))
            hit = self.symbols.join(self._q("terms", "lim"), "repo_id").withColumn("score", T.total("terms", each))
            label = F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), "name")
            return self._top(hit, label).select("query_id", "rank", "id", "score", "file_id", "name")

        return self._once("lexical_symbols", build)

    def _visible_memories(self, *columns: str) -> DataFrame:
        seen = self.queries.select("query_id", F.explode(F.array("repo_id", F.lit(GLOBAL).cast("long"))).alias("owner"), *columns)
        return self.memories.withColumn("owner", F.coalesce("repo_id", F.lit(GLOBAL).cast("long"))).join(F.broadcast(seen), "owner")

    @property
    def lexical_memories(self) -> DataFrame:
        def build():
            title, summary, content = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "summary", "content"))
            each = lambda t: T.points((F.contains(title, t), 7), (F.contains(summary, t), 4), (F.contains(content, t), 2))
            hit = self._visible_memories("terms", "lim").withColumn("score", T.total("terms", each))
            return self._top(hit, F.coalesce("title", F.lit(""))).select("query_id", "rank", "id", "score", "title", "status")

        return self._once("lexical_memories", build)

    # signals ---------------------------------------------------------------

    def _signal(self, df: DataFrame, kind, id_, stage, seq: Column, points: Column, reason, firm: bool = False) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
        return df.select("query_id", lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), lit(stage).cast("string").alias("stage"), seq.cast("long").alias("seq"), points.cast("double").alias("points"), lit(reason).alias("reason"), F.lit(firm).alias("firm"))

    @property
    def lexical_signals(self) -> DataFrame:
        w = self.queries.select("query_id", "wl", "wg", "wm")
        at = lambda n: F.lit(n * STAGE) + F.col("rank").cast("long") * 10**9
        f, s = (x.join(F.broadcast(w), "query_id") for x in (self.lexical_files, self.lexical_symbols))
        m = self.lexical_memories.where("status = 'active'").join(F.broadcast(w), "query_id")
        parts = [
            self._signal(f, "file", "id", "lexical", at(1), 10 * F.col("wl"), "lexical match on path or summary", True),
            self._signal(s, "symbol", "id", "lexical", at(2), 14 * F.col("wl"), "lexical match on symbol metadata", True),
            self._signal(s.where("file_id is not null"), "file", "file_id", None, at(2) + 1, 7 * F.col("wg"), "file contains matched symbol"),
            self._signal(m, "memory", "id", "lexical", at(3), 8 * F.col("wm"), "memory text matched query", True),
        ]
        return reduce(DataFrame.unionByName, parts)

    @property
    def expansion(self) -> DataFrame:
        """Per query the candidate terms, primary files and their modules; bounded by the lexical limits."""

        def build():
            primary = self.lexical_files.select("query_id", "id").unionByName(self.lexical_symbols.select("query_id", F.col("file_id").alias("id"))).distinct()
            paths = self.files.join(F.broadcast(primary), "id").groupBy("query_id").agg(F.collect_set("id").alias("primary"), F.collect_set(T.module_key("path")).alias("modules"))
            piece = self.lexical_symbols.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(T.pieces("name", 3, r"[^\p{L}\p{N}]+"), F.lower)))).alias("pieces"))
            none = F.array().cast("array<string>")
            return (
                self.queries.join(paths, "query_id", "left").join(piece, "query_id", "left")
                .select("query_id", "repo_id", "mode", "wg", "wm", "doc", "config", "test", "history", F.coalesce("primary", F.array().cast("array<bigint>")).alias("primary"), F.coalesce("modules", none).alias("modules"), F.array_distinct(F.concat("rterms", F.coalesce("pieces", none))).alias("candidates"))
            )

        return self._once("expansion", build)

    @property
    def support_files(self) -> DataFrame:
        def build():
            text = F.lower(F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("summary", F.lit(""))))
            x = self.files.join(F.broadcast(self.expansion), "repo_id").where(~F.array_contains("primary", F.col("id")))
            x = x.withColumn("overlap", F.size(F.filter("candidates", lambda t: F.contains(text, t)))).withColumn("imports_primary", F.coalesce(F.arrays_overlap(F.array_compact("imports"), "modules"), F.lit(False)))
            boost = (
                F.when(F.col("is_test") & (F.col("imports_primary") | (F.col("overlap") > 0)) & F.col("mode").isin("understand", *S.CHANGE_MODES), F.when(F.col("test"), 14.0).otherwise(12.0))
                .when(F.col("is_doc") & (F.col("overlap") > 0), F.when(F.col("doc"), 6.0).when((F.col("overlap") >= 2) | F.col("config"), 4.0).otherwise(2.5))
                .when(F.col("is_config") & (F.col("overlap") > 0), F.when(F.col("config"), 6.0).otherwise(5.0))
            )
            known = F.col("is_test") & (F.col("imports_primary") | (F.col("overlap") > 0)) & F.col("mode").isin("understand", *S.CHANGE_MODES)
            what = F.when(known, "related test expansion").when(F.col("is_doc") & (F.col("overlap") > 0), "related documentation expansion").otherwise("related config expansion")
            return x.select("query_id", "id", (boost * F.col("wg")).alias("points"), what.alias("reason")).where("points is not null")

        return self._once("support_files", build, small=False)

    @property
    def support_memories(self) -> DataFrame:
        seen = self.expansion.select("query_id", F.explode(F.array("repo_id", F.lit(GLOBAL).cast("long"))).alias("owner"), "wm", "history", "candidates")
        text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "summary", "content"))))
        x = self.memories.where("status = 'active'").withColumn("owner", F.coalesce("repo_id", F.lit(GLOBAL).cast("long"))).join(F.broadcast(seen), "owner")
        return x.where(F.exists("candidates", lambda t: F.contains(text, t))).select("query_id", "id", (F.when(F.col("history"), 6.0).otherwise(4.0) * F.col("wm")).alias("points"))

    @property
    def support_signals(self) -> DataFrame:
        f = self._signal(self.support_files, "file", "id", "support", F.lit(4 * STAGE) + F.col("id"), F.col("points"), F.col("reason"))
        return f.unionByName(self._signal(self.support_memories, "memory", "id", "support", F.lit(5 * STAGE) + F.col("id"), F.col("points"), "memory expansion from related task context"))

    @property
    def seeds(self) -> DataFrame:
        """(sid, query_id, source, nth, nk, nid, types, lim, hops): start nodes of the graph expansion."""

        def build():
            q = F.broadcast(self.queries.select("query_id", "mode", "lim"))
            types = lambda names: F.array(*map(F.lit, names))
            active = self.lexical_memories.where("status = 'active'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
            parts = []
            for n, (kind, df, names, hops) in enumerate((
                ("symbol", self.lexical_symbols, S.SYMBOL_SEED_TYPES, F.when(F.col("mode") == "refactor", 2).otherwise(1)),
                ("file", self.lexical_files, S.FILE_SEED_TYPES, F.when(F.col("is_support"), 2).otherwise(1)),
                ("memory", active, S.MEMORY_SEED_TYPES, F.lit(2)),
            )):
                x = df.where(F.col("rank") <= S.SEEDS[kind]).join(q, "query_id")
                sid = F.col("query_id") * 100 + n * 10 + F.col("rank")
                parts.append(x.select(sid.cast("long").alias("sid"), "query_id", F.lit(kind).alias("source"), F.col("rank").alias("nth"), F.lit(kind).alias("nk"), F.col("id").alias("nid"), types(names).alias("types"), "lim", hops.alias("hops")))
            return reduce(DataFrame.unionByName, parts)

        return self._once("seeds", build)

    @property
    def graph_hits(self) -> DataFrame:
        """(query_id, source, nth, kind, id, hops, path, ord, points): discoveries from the seeds."""

        def build():
            found = graph.traverse(self.edges, self.seeds.select("sid", "nk", "nid", "types", "lim", "hops"))
            q = F.broadcast(self.queries.select("query_id", "mode", "doc", "about_config", "wg"))
            pts = graph.edge_points(F.element_at("path", -1), F.col("mode"), F.col("doc"), F.col("about_config"), F.col("hops")) * F.col("wg")
            return found.join(F.broadcast(self.seeds.select("sid", "query_id", "source", "nth")), "sid").join(q, "query_id").select("query_id", "source", "nth", "kind", "id", "hops", "path", "ord", pts.alias("points"), "mode", "wg")

        return self._once("graph_hits", build)

    def _owners(self, hits: DataFrame) -> DataFrame:
        """Symbol hits (query_id, id, ...) with the file of the symbol; hits are few and broadcast."""
        return self.symbols.select("id", "file_id").join(F.broadcast(hits), "id").where("file_id is not null")

    @property
    def promotions(self) -> DataFrame:
        """(query_id, source, nth, ord, file_id, points, reason): owner files of symbols found in the graph."""
        own = self._owners(self.graph_hits.where("kind = 'symbol'").select("query_id", "source", "nth", "ord", "id", "mode", "wg"))
        worth = (
            F.when(F.col("source") == "file", _when_mode((("docs",), 2.5), (("architecture",), 3.0), (("understand",), 4.0), other=6.0))
            .when(F.col("source") == "memory", _when_mode((("docs",), 2.5), (("architecture",), 3.5), other=5.0))
            .otherwise(_when_mode((("docs", "architecture"), 4.0), other=6.0))
        )
        reason = F.when(F.col("source") == "file", "owner file promoted from support artifact graph expansion").when(F.col("source") == "memory", "owner file promoted from memory link").otherwise("owner file promoted from graph symbol expansion")
        return own.select("query_id", "source", "nth", "ord", "file_id", (worth * F.col("wg")).alias("points"), reason.alias("reason"))

    @property
    def graph_signals(self) -> DataFrame:
        stage = F.when(F.col("source") == "symbol", 6).when(F.col("source") == "file", 7).otherwise(8)
        seq = stage.cast("long") * F.lit(STAGE) + F.col("nth").cast("long") * 10**9 + F.col("ord") * 2
        said = F.concat(F.when(F.col("source") == "memory", "memory graph expansion via ").otherwise("graph expansion via "), F.array_join("path", " > "))
        hits = self.graph_hits
        return (
            self._signal(hits.where("source = 'symbol'"), F.col("kind"), "id", "graph", seq, F.col("points"), said, True)
            .unionByName(self._signal(hits.where("source != 'symbol'"), F.col("kind"), "id", "graph", seq, F.col("points"), said))
            .unionByName(self._signal(self.promotions, "file", "file_id", "graph", seq + 1, F.col("points"), F.col("reason")))
        )

    @property
    def semantic_hits(self) -> DataFrame:
        """(query_id, nth, kind, id, sim): similarity of the query to the first lim * 8 vectors of its repository."""

        def build():
            w = Window.partitionBy("query_id").orderBy("id")
            some = self.vectors.join(self._q("lim"), "repo_id").dropDuplicates(["query_id", "id"]).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.col("lim") * 8)
            asked = embed(self.queries.select("query_id", "text"), "query_id", "text", DIMS).withColumnRenamed("vector", "asked")
            return some.join(F.broadcast(asked), "query_id").select("query_id", "nth", F.col("node_kind").alias("kind"), F.col("node_id").alias("id"), dot("asked", "vector").alias("sim")).where("sim > 0")

        return self._once("semantic_hits", build)

    @property
    def semantic_signals(self) -> DataFrame:
        x = self.semantic_hits.join(F.broadcast(self.queries.select("query_id", "ws")), "query_id")
        return self._signal(x, F.col("kind"), "id", "semantic", F.lit(9 * STAGE) + F.col("nth"), F.col("sim") * 10 * F.col("ws"), "semantic similarity to query")

    # ranking ---------------------------------------------------------------

    @staticmethod
    def scores(signals: DataFrame) -> DataFrame:
        """(query_id, kind, id, score, first_seq, reason): scores rounded to 6 places so that sums in any order tie alike."""
        firm = F.max_by(F.when(F.col("firm"), F.col("reason")), F.when(F.col("firm"), F.col("seq")))
        return signals.groupBy("query_id", "kind", "id").agg(F.round(F.sum("points"), 6).alias("score"), F.min("seq").alias("first_seq"), F.coalesce(firm, F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq")))).alias("reason"))

    @property
    def first_signals(self) -> DataFrame:
        return self._once("first_signals", lambda: reduce(DataFrame.unionByName, [self.lexical_signals, self.support_signals, self.graph_signals, self.semantic_signals]))

    @property
    def rerank_signals(self) -> DataFrame:
        def build():
            scored = self.scores(self.first_signals).where("kind = 'file'").select("query_id", "id")
            x = self.files.join(scored, "id").join(F.broadcast(self.queries.select("query_id", "mode", "rterms", "doc", "config", "test")), "query_id")
            path, summary = F.lower(F.coalesce("path", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
            x = x.withColumn("m", F.size(F.filter("rterms", lambda t: F.contains(path, t) | F.contains(summary, t))))
            explains = F.col("mode").isin("docs", "architecture")
            m = F.col("m")
            bonus = (
                F.least(m, F.lit(3)) * F.when(F.col("is_support"), 1.0).otherwise(0.4)
                + F.when(F.col("is_doc"), F.when(F.col("doc") | explains, 4.0 + F.least(m, F.lit(2))).when(m > 0, 2.0).otherwise(0.0)).otherwise(0.0)
                + F.when(F.col("is_doc") & F.contains(path, F.lit("readme")) & F.col("mode").isin("understand", "docs", "architecture"), 1.5).otherwise(0.0)
                + F.when(F.col("is_config"), F.when(F.col("config"), 4.5 + F.least(m, F.lit(2))).when(explains, 2.0).when(m >= 2, 1.5).otherwise(0.0)).otherwise(0.0)
                + F.when(F.col("is_test"), F.when(F.col("test"), 2.5).when(F.col("mode").isin(*S.CHANGE_MODES), 2.0).otherwise(0.0)).otherwise(0.0)
            )
            y = x.select("query_id", "id", bonus.alias("bonus")).where("bonus > 0")
            return self._signal(y, "file", "id", None, F.lit(10 * STAGE) + F.col("id"), F.col("bonus"), "final support-file reranking")

        return self._once("rerank_signals", build)

    @property
    def ranked_files(self) -> DataFrame:
        """(query_id, id, nth): the ten best files before symbols are drawn from them."""

        def build():
            s = self.scores(self.first_signals.unionByName(self.rerank_signals)).where("kind = 'file'")
            return s.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seq", "id"))).where("nth <= 10").select("query_id", "id", "nth")

        return self._once("ranked_files", build)

    @property
    def drawn_symbols(self) -> DataFrame:
        """(query_id, id, file_id, nth, alias, compact): symbols of the ranked files that a query alias names, or that stand in a compact file."""

        def build():
            top = self.ranked_files.join(F.broadcast(self.queries.select("query_id", "aliases", "mode")), "query_id").withColumnRenamed("id", "file_id")
            x = self.symbols.select("id", "file_id", "name", "qualified_name").join(F.broadcast(top), "file_id")
            name, qualified = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("qualified_name", F.lit("")))
            many = F.count(F.lit(1)).over(Window.partitionBy("query_id", "file_id"))
            return x.select("query_id", "id", "file_id", "nth", "mode", F.exists("aliases", lambda a: F.contains(name, a) | F.contains(qualified, a)).alias("alias"), ((F.col("nth") <= 5) & (many <= 2)).alias("compact"))

        return self._once("drawn_symbols", build)

    @property
    def symbol_signals(self) -> DataFrame:
        def build():
            seq = lambda n: F.lit(n * STAGE) + F.col("id") * 2
            owner = _when_mode((("docs", "architecture"), 4.0), other=6.0)
            by_alias = self.drawn_symbols.where("alias")
            bonus = _when_mode((("docs", "architecture"), 4.0), (S.CHANGE_MODES, 6.0), other=5.0)
            scored = self.first_signals.where("kind = 'symbol'").select("query_id", "id").distinct()
            compact = self.drawn_symbols.where("compact and not alias").join(scored, ["query_id", "id"], "left_anti")
            small = _when_mode((("docs", "architecture"), 2.5), (S.CHANGE_MODES, 4.0), other=3.0)
            return (
                self._signal(by_alias, "symbol", "id", "graph", seq(11), bonus, "symbol promoted from ranked file and query alias match")
                .unionByName(self._signal(by_alias, "file", "file_id", "graph", seq(11) + 1, owner, "owner file promoted from ranked file symbol match"))
                .unionByName(self._signal(compact, "symbol", "id", "graph", seq(12), small, "symbol promoted from compact ranked file"))
                .unionByName(self._signal(compact, "file", "file_id", "graph", seq(12) + 1, owner * 0.8, "owner file reinforced from compact ranked file symbol"))
            )

        return self._once("symbol_signals", build)

    @property
    def signals(self) -> DataFrame:
        return self.first_signals.unionByName(self.rerank_signals).unionByName(self.symbol_signals)

    @property
    def ranking(self) -> DataFrame:
        """(query_id, rank, kind, id, score, reason): the best lim * 4 nodes of each query."""

        def build():
            s = self.scores(self.signals).join(F.broadcast(self.queries.select("query_id", "lim")), "query_id")
            w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seq", "kind", "id")
            return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("lim") * 4).select("query_id", "rank", "kind", "id", "score", "reason")

        return self._once("ranking", build)

    @property
    def selection(self) -> DataFrame:
        """(query_id, kind, id, place, score, reason): files by mix, then by rank; symbols and memories by quota; existing nodes only."""

        def build():
            q = F.broadcast(self.queries.select("query_id", "s_code", "s_test", "s_doc", "s_config", "q_files", "q_symbols", "q_memories"))
            r = F.broadcast(self.ranking)
            kinds = self.files.select("id", F.when(F.col("is_test"), 1).when(F.col("is_doc"), 2).when(F.col("is_config"), 3).otherwise(0).alias("bucket"))
            f = self.ranking.where("kind = 'file'").join(kinds.join(r.where("kind = 'file'").select("id").distinct(), "id", "left_semi"), "id", "left").join(q, "query_id")
            share = F.when(F.col("bucket") == 0, F.col("s_code")).when(F.col("bucket") == 1, F.col("s_test")).when(F.col("bucket") == 2, F.col("s_doc")).otherwise(F.col("s_config"))
            f = f.withColumn("in_bucket", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank")))
            f = f.withColumn("group", F.when(F.col("bucket").isNotNull() & (F.col("in_bucket") <= share), F.col("bucket")).otherwise(4))
            f = f.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("group", "rank"))).where((F.col("place") <= F.col("q_files")) & F.col("bucket").isNotNull())
            o = self.ranking.where("kind in ('symbol', 'memory')").join(q, "query_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank")))
            o = o.where(F.col("place") <= F.when(F.col("kind") == "symbol", F.col("q_symbols")).otherwise(F.col("q_memories")))
            there = self.symbols.select("id", F.lit("symbol").alias("kind")).unionByName(self.memories.select("id", F.lit("memory").alias("kind")))
            cols = ["query_id", "kind", "id", "place", "score", "reason"]
            return f.select(*cols).unionByName(there.join(F.broadcast(o), ["id", "kind"]).select(*cols))

        return self._once("selection", build)

    @property
    def packed(self) -> DataFrame:
        """(query_id, kind, id, place): the packed context; the packer sees the first lim of each kind."""

        def build():
            q = F.broadcast(self.queries.select("query_id", "lim", "p_code", "p_test", "p_doc", "p_config", "p_symbols", "p_memories"))
            s = self.selection.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("place"))).join(q, "query_id").where("n <= lim")
            f = self.files.select("id", "is_test", "is_doc", "is_config", "is_support").join(F.broadcast(s.where("kind = 'file'")), "id")
            member = F.filter(F.array(F.when(~F.col("is_support"), 0), F.when(F.col("is_test"), 1), F.when(F.col("is_doc"), 2), F.when(F.col("is_config"), 3), F.lit(4)), lambda b: b.isNotNull())
            f = f.withColumn("bucket", F.explode(member)).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("n")))
            share = F.when(F.col("bucket") == 0, F.col("p_code")).when(F.col("bucket") == 1, F.col("p_test")).when(F.col("bucket") == 2, F.col("p_doc")).when(F.col("bucket") == 3, F.col("p_config")).otherwise(F.col("lim"))
            best = f.where(F.col("nth") <= share).groupBy("query_id", "id").agg(F.min(F.col("bucket") * 1000 + F.col("nth")).alias("key"))
            best = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("key"))).where(F.col("place") <= S.PACKED_FILES)
            o = s.where("kind != 'file'").where(F.col("n") <= F.when(F.col("kind") == "symbol", F.col("p_symbols")).otherwise(F.col("p_memories")))
            return best.select("query_id", F.lit("file").alias("kind"), "id", "place").unionByName(o.select("query_id", "kind", "id", F.col("n").alias("place")))

        return self._once("packed", build)

    @property
    def snippets(self) -> DataFrame:
        """(query_id, place, file, symbol, low, high, code): the code of the first packed symbols whose file is packed too.

        Code is blank where the text is not held or a line is null.
        """

        def build():
            p = self.packed
            s = self.symbols.join(F.broadcast(p.where((F.col("kind") == "symbol") & (F.col("place") <= S.SNIPPETS)).select("query_id", "id", "place")), "id")
            f = self.files.select(F.col("id").alias("file_id"), F.col("path").alias("file")).join(F.broadcast(p.where("kind = 'file'").select("query_id", F.col("id").alias("file_id"))), "file_id")
            s = s.select("query_id", "place", "file_id", F.col("qualified_name").alias("symbol"), F.col("line_start").alias("low"), F.col("line_end").alias("high")).join(f, ["query_id", "file_id"])
            s = cut(s)
            text = self.sources.join(F.broadcast(s.select("file_id").distinct()), "file_id", "left_semi").groupBy("file_id").agg(F.max("content").alias("content"))  # at most six files a query
            lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
            code = F.when((F.col("low") >= 1) & (F.col("high") >= F.col("low")), F.array_join(F.slice(lines, F.col("low"), F.col("high") - F.col("low") + 1), "\n"))
            return s.join(text, "file_id", "left").select("query_id", "place", "file", "symbol", "low", "high", F.coalesce(code, F.lit("")).alias("code"))

        return self._once("snippets", build)

    @property
    def stage_members(self) -> DataFrame:
        """(query_id, stage, kind, id): distinct nodes that each stage reached."""
        reached = self.signals.where("stage is not null").select("query_id", "stage", "kind", "id")
        later = self.selection.select("query_id", F.lit("selected").alias("stage"), "kind", "id").unionByName(self.packed.select("query_id", F.lit("packed").alias("stage"), "kind", "id"))
        return reached.unionByName(later).where("kind in ('file', 'symbol', 'memory')").distinct()

    @property
    def context(self) -> DataFrame:
        """(query_id, mode, files, symbols, memories): the packed context, one nested row per query."""
        p = F.broadcast(self.packed.join(self.selection.select("query_id", "kind", "id", "reason"), ["query_id", "kind", "id"]))
        why = F.coalesce("reason", F.lit("selected by hybrid score")).alias("why")
        f = self.files.join(p.where("kind = 'file'"), "id").select("query_id", F.lit("files").alias("k"), F.struct("place", "id", F.col("path").alias("label"), F.col("language").alias("type"), "summary", why).alias("x"))
        s = self.symbols.join(p.where("kind = 'symbol'"), "id").select("query_id", F.lit("symbols").alias("k"), F.struct("place", "id", F.coalesce("qualified_name", "name").alias("label"), F.col("symbol_type").alias("type"), "summary", why).alias("x"))
        m = self.memories.join(p.where("kind = 'memory'"), "id").select("query_id", F.lit("memories").alias("k"), F.struct("place", "id", F.col("title").alias("label"), F.col("memory_type").alias("type"), "summary", why).alias("x"))
        rows = f.unionByName(s).unionByName(m).groupBy("query_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("x")))).alias(k) for k in ("files", "symbols", "memories")))  # at most 17 items a query
        return self.queries.select("query_id", "mode").join(rows, "query_id", "left")
