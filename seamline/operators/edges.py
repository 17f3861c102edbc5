"""Builders of derived edges over the current index tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import broadcast_if_small, cut

# Words of settings that say nothing about code.
CONFIG_STOPWORDS = ("config", "configs", "document", "settings", "default", "value", "values", "enabled", "workspace")
#: Settings and code files that are compared at once, and meetings of their terms.
BLOCK = 1024
MEETINGS = 1 << 21


def contains_symbol(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("file_id").isNotNull()).select("repo_id", F.col("file_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("FILE_CONTAINS_SYMBOL").alias("edge_type"))


def module_files(files: DataFrame) -> DataFrame:
    """(repo_id, module, file_id): one file per module name, the greatest id."""
    return files.groupBy("repo_id", T.module_key("path").alias("module")).agg(F.max("id").alias("file_id"))


def imports_file(files: DataFrame) -> DataFrame:
    """FILE_IMPORTS_FILE: each import that names a module of the same repository."""
    return imports_of(files, files).withColumn("edge_type", F.lit("FILE_IMPORTS_FILE"))


def test_covers_symbol(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """TEST_COVERS_SYMBOL: test files and every symbol of the files they import, once each."""
    covered = imports_of(files.where("is_test"), files)
    return covered.distinct().join(symbols.where(F.col("file_id").isNotNull()).select(F.col("id").alias("symbol_id"), F.col("file_id").alias("to_id")), "to_id").select("repo_id", "from_id", F.col("symbol_id").alias("to_id"), F.lit("TEST_COVERS_SYMBOL").alias("edge_type"))


def imports_of(some: DataFrame, files: DataFrame) -> DataFrame:
    wanted = some.select("repo_id", F.col("id").alias("from_id"), F.explode("imports").alias("module"))
    return wanted.join(module_files(files), ["repo_id", "module"]).select("repo_id", "from_id", F.col("file_id").alias("to_id"))


def describes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, doc_id, file_id, symbol_id): documents that share a word with a symbol or its file's path.

    Words have four characters or more; those of documents are lower case, those
    of symbols and paths as written. Set overlap becomes an equality on
    (repository, word): every word is matched once and pairs are made distinct.
    """
    text = F.lower(F.concat_ws(" ", "path", F.coalesce("summary", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    docs = files.where("is_doc").select("repo_id", F.col("id").alias("doc_id"), F.explode(F.array_distinct(T.pieces(text, 4))).alias("word"))
    plain = r"[^\p{L}\p{N}]+"
    paths = files.select("repo_id", F.col("id").alias("file_id"), F.array_distinct(T.pieces("path", 4, plain)).alias("path_words"))
    own = symbols.select(F.col("id").alias("symbol_id"), "file_id", T.pieces(F.concat_ws(" ", "name", F.coalesce("qualified_name", F.lit(""))), 4, plain).alias("words"))
    named = own.join(paths, "file_id").select("repo_id", "file_id", "symbol_id", F.explode(F.array_distinct(F.concat("words", "path_words"))).alias("word"))
    return docs.join(named, ["repo_id", "word"]).select("repo_id", "doc_id", "file_id", "symbol_id").distinct()


def doc_edges(pairs: DataFrame) -> DataFrame:
    """DOC_DESCRIBES_SYMBOL per pair, and DOC_DESCRIBES_FILE once per document and file with the number of symbols behind it."""
    to_symbol = pairs.select("repo_id", F.col("doc_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("DOC_DESCRIBES_SYMBOL").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit(1).cast("long").alias("n"))
    to_file = pairs.groupBy("repo_id", F.col("doc_id").alias("from_id"), F.col("file_id").alias("to_id")).agg(F.count(F.lit(1)).alias("n")).select("repo_id", "from_id", "to_id", F.lit("DOC_DESCRIBES_FILE").alias("edge_type"), F.lit(0.9).alias("weight"), "n")
    return to_symbol.unionByName(to_file)


def config_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """CONFIG_AFFECTS_FILE: (repo_id, from_id, to_id, n_terms, hinted, weight, terms).

    A setting affects a code file of its repository if two of its terms occur in
    the file's text (path, summary, imports, symbol names and summaries), or if
    the file's module name occurs in the setting. A term lies within one word of
    the text, so terms are looked for in every word of a repository once, not in
    every file; settings and files meet in blocks that count their shared terms.
    """
    files = cut(files.where("(is_config or is_code) and repo_id is not null and path is not null").select("id", "repo_id", "path", "summary", "imports", "excerpt", "is_config", "is_code"))
    text = F.lower(F.concat_ws(" ", "path", F.coalesce("summary", F.lit("")), F.coalesce("excerpt", F.lit(""))))
    terms = F.array_sort(F.array_distinct(F.filter(T.pieces(text, 4), lambda t: ~t.isin(*CONFIG_STOPWORDS))))
    configs = files.where("is_config").select("repo_id", F.col("id").alias("from_id"), text.alias("text"), terms.alias("terms")).where(F.size("terms") > 0)
    code = files.where("is_code").withColumnRenamed("id", "to_id")

    # words of the code files, with the files that have them and the terms that they hold
    words = lambda *columns: F.explode(F.array_distinct(T.pieces(F.lower(F.concat_ws(" ", *columns)), 4))).alias("word")
    named = symbols.select(F.col("file_id").alias("to_id"), words("name", "summary")).join(code.select("repo_id", "to_id"), "to_id")
    used = code.select("repo_id", "to_id", words("path", "summary", F.array_join("imports", " "))).unionByName(named).distinct()
    used = cut(used.groupBy("repo_id", "word").agg(F.collect_list("to_id").alias("ids")))
    wanted = configs.select("repo_id", F.explode("terms").alias("part")).distinct()
    held = may_hold(used.select("repo_id", F.col("word").alias("key"), F.col("word").alias("text")), wanted, F.lit(1)).where(F.contains("key", F.col("part")))
    held = held.groupBy("repo_id", F.col("key").alias("word")).agg(F.collect_list("part").alias("hits"))
    hits = used.join(held, ["repo_id", "word"]).select("repo_id", F.explode("ids").alias("to_id"), "hits")

    # module names in settings; that without its suffix is the start of the others
    dotted = F.lower(F.regexp_replace("path", "/", "."))
    bare = F.when(F.col("path").rlike(r"\.(py|ts|js)\z"), F.substring(dotted, F.lit(1), F.length(dotted) - 3)).otherwise(dotted)
    hints = code.select("repo_id", "to_id", F.when(bare != "", bare).otherwise(dotted).alias("part")).where("part != ''")
    last_dot = F.length("part") - F.locate(".", F.reverse("part")) + 1
    hinted = may_hold(configs.select("repo_id", F.col("from_id").alias("key"), "text"), hints, last_dot - 8).withColumnRenamed("key", "from_id")
    hinted = hinted.join(configs.select("repo_id", "from_id", "text"), ["repo_id", "from_id"]).where(F.contains("text", F.col("part"))).select("repo_id", "to_id", "from_id")

    found = hits.unionByName(hinted, allowMissingColumns=True).groupBy("repo_id", "to_id").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.collect_set("from_id").alias("hinted_by"))
    blocks = lambda df, name: df.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = blocks(configs, "n_settings").join(blocks(code, "n_code"), "repo_id")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = configs.join(blocks, "repo_id").select(F.col("repo_id").alias("repo"), block("from_id", "n_settings").alias("a"), every("n_code").alias("b"), "from_id", "terms")
    right = found.join(blocks, "repo_id").select(F.col("repo_id").alias("repo"), every("n_settings").alias("a"), block("to_id", "n_code").alias("b"), "to_id", "hits", "hinted_by")
    kinds = dict(configs.dtypes) | dict(code.dtypes)
    out = f"repo_id {kinds['repo_id']}, from_id {kinds['from_id']}, to_id {kinds['to_id']}, n_terms int, hinted int, weight double, terms string"
    return left.groupBy("repo", "a", "b").cogroup(right.groupBy("repo", "a", "b")).applyInArrow(_shared_terms, out)


def may_hold(texts: DataFrame, parts: DataFrame, at: Column) -> DataFrame:
    """Rows of ``texts`` (repo_id, key, text) and ``parts`` (repo_id, part, ...) of a repository where the text may hold the part, without the text.

    Both meet by equality on a piece of the part: its 16, 8, 4, 2 or 1 characters,
    the most that it has, from position ``at`` on or as near to it as fits.
    """
    n = F.length("part")
    size = F.when(n >= 16, 16).when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    parts = broadcast_if_small(parts.withColumn("size", size).withColumn("piece", F.substring("part", F.greatest(F.lit(1), F.least(at, n - F.col("size") + 1)), F.col("size"))))
    sizes = [r["size"] for r in parts.select("size").distinct().collect()]

    def runs(k: int) -> Column:
        whole = F.length("text") - (k - 1)
        return F.when(whole > 0, F.transform(F.sequence(F.lit(1), whole), lambda i: F.substring("text", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    pieces = texts.select("repo_id", "key", F.explode(F.array_distinct(F.concat(*(runs(k) for k in sizes or [1])))).alias("piece"))
    return pieces.join(parts, ["repo_id", "piece"]).drop("piece", "size")


def _shared_terms(key: tuple, settings: pa.Table, code: pa.Table) -> pa.Table:
    """Pairs of a block of settings (from_id, terms) and one of code files (to_id, hits, hinted_by) that share two terms or a module name."""

    def flat(table: pa.Table, column: str):
        lists = pa.concat_arrays(table[column].chunks)
        return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()

    names = ("repo_id", "from_id", "to_id", "n_terms", "hinted", "weight", "terms")
    if not settings.num_rows or not code.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(names, (key[0].type, settings.schema.field("from_id").type, code.schema.field("to_id").type, pa.int32(), pa.int32(), pa.float64(), pa.string()))})
    width = code.num_rows
    row, terms = flat(settings, "terms")
    hit_row, hits = flat(code, "hits")
    ids = pa.concat_arrays([terms, hits]).dictionary_encode().indices.to_numpy()
    mine, theirs = ids[: len(terms)], ids[len(terms) :]
    order = np.argsort(theirs, kind="stable")
    theirs, hit_row = theirs[order], hit_row[order]
    first = np.searchsorted(theirs, mine, "left")
    n = np.searchsorted(theirs, mine, "right") - first
    by_row, by = flat(code, "hinted_by")
    named = pc.index_in(by, value_set=pa.concat_arrays(settings["from_id"].chunks))
    here = named.is_valid().to_numpy(zero_copy_only=False)
    hinted = np.zeros(settings.num_rows * width, bool)
    hinted[named.filter(named.is_valid()).to_numpy().astype(np.int64) * width + by_row[here]] = True
    # settings by so many at once that the meetings of their terms stay few
    begins = np.searchsorted(row, np.arange(settings.num_rows + 1))
    met = np.concatenate(([0], np.cumsum(n)))[begins]
    low, out = 0, []
    while low < settings.num_rows:
        high = max(low + 1, int(np.searchsorted(met, met[low] + MEETINGS, "right")) - 1)
        some = slice(begins[low], begins[high])
        at = np.repeat(np.arange(some.start, some.stop), n[some])
        pair = (row[at] - low) * width + hit_row[np.arange(len(at)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + first[at]]
        count = np.bincount(pair, minlength=(high - low) * width)
        is_hinted = hinted[low * width : high * width]
        good = (count >= 2) | is_hinted
        pairs = np.flatnonzero(good)
        at, pair = at[good[pair]], pair[good[pair]]
        order = np.argsort(pair, kind="stable")  # terms of a setting are in order, so those of a pair are
        at = at[order]
        ends = np.cumsum(count[pairs])
        nth = np.arange(len(at)) - np.repeat(ends - count[pairs], count[pairs])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.minimum(count[pairs], 6)))), pa.int32()), terms.take(pa.array(at[nth < 6])))
        weight = np.round(1.0 + np.minimum(count[pairs], 4) * 0.1 + is_hinted[pairs] * 0.2, 6)
        columns = (pa.repeat(key[0], len(pairs)), settings["from_id"].take(pa.array(pairs // width + low)), code["to_id"].take(pa.array(pairs % width)), count[pairs].astype(np.int32), is_hinted[pairs].astype(np.int32), weight, pc.binary_join(lists, " "))
        out.append(pa.table(dict(zip(names, columns))))
        low = high
    return pa.concat_tables(out)


def memory_links(memories: DataFrame, files: DataFrame, symbols: DataFrame, stop: tuple[str, ...] = T.STOPWORDS, best: int = 4) -> DataFrame:
    """(memory_id, node_kind, node_id, score, nth): for each memory the files and symbols of its repository that hold most of its words.

    The score is the number of shared words, one more for a symbol; ties go to
    symbols, then to the greater id.
    """
    words = memories.where(F.col("repo_id").isNotNull()).select("repo_id", F.col("id").alias("memory_id"), F.array_distinct(F.filter(T.pieces(F.lower(F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), "content")), 4), lambda t: ~t.isin(*stop))).alias("terms"))

    def nodes(df, kind, *columns):
        hay = F.lower(F.concat_ws(" ", *columns))
        return df.select("repo_id", F.lit(kind).alias("node_kind"), F.col("id").alias("node_id"), F.explode(F.array_distinct(T.pieces(hay, 4, r"[^\p{L}\p{N}]+"))).alias("word"))

    pieces = nodes(files, "file", "path", "summary").unionByName(nodes(symbols, "symbol", "name", "qualified_name", "summary"))
    hits = words.select("repo_id", "memory_id", F.explode("terms").alias("word")).join(pieces, ["repo_id", "word"]).groupBy("memory_id", "node_kind", "node_id").agg((F.count(F.lit(1)) + (F.col("node_kind") == "symbol").cast("long")).alias("score"))
    w = Window.partitionBy("memory_id").orderBy(F.desc("score"), F.desc("node_kind"), F.desc("node_id"))
    return hits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= best)


def resolved_parents(symbols: DataFrame) -> DataFrame:
    """(id, parent_id): the symbol of the same file that the qualifier of the name names; of several the greatest id."""
    named = symbols.groupBy("file_id", F.col("name").alias("qualifier")).agg(F.max("id").alias("parent_id"))
    q = symbols.where(F.contains("qualified_name", F.lit("."))).select("id", "file_id", F.substring_index("qualified_name", ".", 1).alias("qualifier"))
    return q.join(named, ["file_id", "qualifier"]).where("parent_id != id").select("id", "parent_id")
