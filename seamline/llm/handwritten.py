"""Generated, minified, bundled and vendored source files, and data saved as code.

Path and tags speak for themselves where they say something. Where they do not,
the file's excerpt is taken apart into units, the lines of its leading comment
and its code, and compared with all other files. Names, numbers and strings are
masked; shingles of five masked tokens are banded by MinHash, classes that meet
in a band are verified, and similar ones are joined to clusters. Clusters then
speak in two ways:

- by what they consist of: clusters of literals only are data, clusters of code
  whose names have one or two letters are minified;
- by who belongs to them: a cluster in which files that path or tags mark are far
  more frequent than among all units of its sort is a mark of such files, and its
  other members bear it too. It is labelled as most of the marked members are; if
  these disagree, its spread decides: wordings that stay within one repository
  each were generated there, wordings that recur across repositories vendored.

Ordinary code clusters as well, within and across repositories, so spread alone
would condemn it; its clusters hold no more marked files than chance gives.
No wording of a comment is known to this module in advance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

SHINGLE, SIMILAR = 5, 0.8
HASHES, BANDS = 64, 16
#: Parts of a band whose pairs are made apart.
SALTS = 8
#: A word of a comment is a name, and masked, unless this share of the commented files and three of them use it.
#: Hence at most 1 / RARE times the mean number of words of a comment are kept.
RARE = 0.01
#: A cluster is marked if at least LEAST of its members are, of comment lines or of code, and chance would give so many with a
#: probability below CHANCE (Chernoff's bound). If PURE of those members bear one label, it is that.
LEAST, CHANCE, PURE = {"note": 0.2, "code": 0.5}, 1e-2, 0.6
#: Characters of a string literal that count as one token.
LITERAL = 16
#: Share of literals in a unit of data, of short names in minified code, and the least tokens of either.
LITERALS, SHORT, TOKENS = 0.85, 0.7, 12

# Names of folders and tags as tools write them (lower case, - and _ alike).
GENERATED_TAGS = ("generated", "autogen", "autogenerated", "auto-generated", "machine-generated", "machine-written", "codegen-output", "generated-code", "do-not-edit")
VENDOR_TAGS = ("vendor", "vendored", "third-party", "thirdparty", "3rd-party", "external-code", "external-library", "bundled-dependency", "upstream-copy")
MINIFIED_TAGS = ("minified", "bundle:minified", "bundled", "minified-bundle", "uglified", "compressed", "obfuscated")
BLOB_TAGS = ("data-blob", "datablob", "blob", "embedded-data", "data-as-code", "binary-data", "base64", "fixture-data")
GENERATED_DIRS = ("generated", "--generated--", "gen", "autogen", "auto-generated", "autogenerated", "codegen-out", "generated-sources", "generated-src", "genfiles", "-generated")
VENDOR_DIRS = ("node-modules", "vendor", "vendors", "vendored", "-vendor", "-vendored", "third-party", "thirdparty", "3rdparty", "3rd-party", "bower-components", "jspm-packages", "site-packages", "dist-packages", "extern", "external", "externals", "deps", "pods", "carthage", "godeps", "venv", ".venv", "virtualenv", ".virtualenv", "web-modules", ".yarn", "contrib-libs", "-deps")
BUILD_DIRS = ("dist", "build", "out", "bundles", ".next", ".nuxt")

_GENERATED_NAME = r"(?i)(\.(gen|generated|g|pb|pb2|auto|autogen|designer|codegen)\.[a-z]+$|_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h|ts|js)$|[._-]generated\.[a-z]+$|^generated[._-]|[._-]autogen\.[a-z]+$|_gen\.(go|py|ts|js|rs)$|^(parsetab|lextab)\.py$|^package-lock\.json$|^yarn\.lock$|^pnpm-lock\.yaml$)"
_MINIFIED_NAME = r"(?i)([.-]min\.(js|css|mjs|cjs|html)$|\.bundle\.(js|css|mjs)$|\.(packed|pack|prod|production)\.(js|css)$|[.-][0-9a-f]{8,20}\.(js|css|mjs)$|^chunk[.-][0-9a-z]{6,}\b.*\.(js|css|mjs)$|\.chunk\.(js|css)$|\.(js|css)\.map$)"
_CODE_SUFFIX = r"(?i)\.(js|mjs|cjs|jsx|ts|tsx|css|py)$"

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?|[^\s\w]|\w+")
#: Words of a comment; what holds a dot, slash or underscore between letters is one name.
_NOTE_TOKEN = re.compile(r"`[^`]*`?|\"[^\"\n]*\"|[^\W_]+(?:[./_\\:@][^\W_]+)+|[^\W_]*\d[^\W_]*|[^\W\d_]+|[^\s\w]|_")
#: A line of words rather than code: no assignment, block or call, semicolons only between words.
_BARE = re.compile(r"[!\w@<](?:[^{}=;(]|;(?= )|(?<=\s)\()*")
_COMMENT = re.compile(r"(#(?!!)|//|/\*|\*|<!--|;|--)")
# Words that the languages themselves reserve.
_KEYWORDS = frozenset("import from export default class def function return if else for while const let var async await try except catch new this self in is not and or with as raise throw yield lambda None True False null true false".split())


def notes_and_code(excerpt: str) -> tuple[list[str], str]:
    """Lines of the leading comment without their markers, and all text after it.

    A first line of bare words, as of a file whose comment marker was lost, is a
    comment line as well.
    """
    lines = excerpt.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿ \n\t").split("\n")
    notes, k, block = [], 0, False
    while k < len(lines):
        s = lines[k].strip()
        if not s or s.startswith("#!"):
            k += 1
            continue
        if not block and not _COMMENT.match(s):
            if notes or not _BARE.fullmatch(s) or len(s.split()) < 4 or s.split()[0] in _KEYWORDS:
                break
            notes.append(s)
            k += 1
            break
        # an opened block comment goes on only as long as its lines bear the star of one
        block = (block or s.startswith("/*")) and "*/" not in s and k + 1 < len(lines) and lines[k + 1].strip().startswith("*")
        body = re.sub(r"^(#+|//+|/\*+!?|\*+/?|<!--|;+|--)\s*|\s*(\*+/|-->)\s*$", "", s).strip()
        if body:
            notes.append(body)
        k += 1
    return notes, "\n".join(lines[k:]).strip()


def note_words(line: str) -> list[str]:
    """Lower-case words of a comment line that may be more than names."""
    return [t.lower() for t in _NOTE_TOKEN.findall(line) if t.isalpha()]


def masked_note(line: str, common: frozenset[str]) -> str:
    """Tokens of a comment line; uncommon words and names are I, numbers 0, quoted text S."""
    out = []
    for t in _NOTE_TOKEN.findall(line):
        if t.isalpha():
            out.append(t.lower() if t.lower() in common else "I")
        elif t[0] in "`\"" and len(t) > 1:
            out.append("S")
        elif t[0].isalnum():
            out.append("0" if t[0].isdigit() and not any(c.isalpha() for c in t) else "I")
        else:
            out.append(t)
    return " ".join(out)


def masked_code(text: str) -> str:
    """Tokens of code; names are I, those of one or two letters i, numbers 0, strings S for
    every LITERAL characters, strings of several words T."""
    out = []
    for t in _TOKEN.findall(text):
        if t in _KEYWORDS:
            out.append(t)
        elif t[0].isdigit():
            out.append("0")
        elif t[0] in "\"'`" and len(t) > 1:
            out += ["T"] if " " in t.strip("\"'` ") else ["S"] * max(1, len(t) // LITERAL)
        elif t[0].isalpha() or t[0] in "_$":
            out.append("i" if len(t) <= 2 else "I")
        else:
            out.append(t)
    return " ".join(out)


def composition(masked: str) -> str:
    """'blob' for masked code of literals only, 'minified' for such of short names and many marks, else ''."""
    tokens = masked.split(" ")
    n = Counter(tokens)
    words = sum(v for k, v in n.items() if k[0].isalnum())
    if words >= TOKENS and n["0"] + n["S"] >= LITERALS * words:
        return "blob"
    names = n["i"] + n["I"]
    if names >= TOKENS and n["i"] >= SHORT * names and len(tokens) - words >= len(tokens) // 2:
        return "minified"
    return ""


def shingles(masked: str) -> set[str]:
    """Shingles of five tokens; a shorter text is one shingle."""
    w = masked.split(" ")
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def spoken(files: DataFrame) -> Column:
    """'generated', 'vendored', 'minified' or 'blob' where path or tags say so, else null."""
    alike = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[_ ]", "-")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), alike)
    has = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    parts = F.transform(F.split(F.coalesce("path", F.lit("")), r"[/\\]"), alike)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    under = lambda names: F.arrays_overlap(dirs, F.array(*map(F.lit, names)))
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), r"[/\\]"), -1)
    return (
        F.when(has(MINIFIED_TAGS), "minified").when(has(BLOB_TAGS), "blob").when(has(GENERATED_TAGS), "generated").when(has(VENDOR_TAGS), "vendored")
        .when(under(VENDOR_DIRS), "vendored").when(under(GENERATED_DIRS), "generated")
        .when(name.rlike(_GENERATED_NAME), "generated").when(name.rlike(_MINIFIED_NAME), "minified")
        .when(under(BUILD_DIRS) & name.rlike(r"(?i)\.(js|mjs|cjs|css|map)$"), "minified")
    )


def current_files(files: DataFrame) -> DataFrame:
    """(file_id, repo_id, path, said, excerpt) of each file's latest row; ties by the greater values."""
    row = F.struct("indexed_at", "path", F.coalesce(F.array_join("tags", "\x1f"), F.lit("")).alias("t"), F.element_at("metadata_json", "content_excerpt").alias("excerpt"), "repo_id", spoken(files).alias("said"))
    return files.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("file_id")).agg(F.max(row).alias("r")).select("file_id", "r.repo_id", "r.path", "r.said", "r.excerpt")


def common_words(current: DataFrame) -> frozenset[str]:
    """Words that RARE or more of the files with a leading comment, and three of them, use in it.

    Their number is bounded by 1 / RARE times the mean words of a comment,
    whatever the number of files; counts are summed before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for e in b["excerpt"]:
                notes, _ = notes_and_code(e)
                n.update({w for line in notes for w in note_words(line)})
                n[""] += bool(notes)
            yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    counted = cut(current.where(F.col("excerpt").rlike(r"\S")).select("excerpt").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return frozenset(r["word"] for r in counted.where((F.col("word") != "") & (F.col("n") >= max(3, RARE * total))).select("word").collect())


def units(current: DataFrame, common: frozenset[str]) -> DataFrame:
    """(file_id, repo_id, said, sort, text, wording): the masked units of every excerpt, each once a file.

    sort is ``note`` for a line of the leading comment and ``code`` for the rest;
    wording is a hash of the unit as it stands, without numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for f, r, said, e in zip(b["file_id"], b["repo_id"], b["said"], b["excerpt"]):
                notes, code = notes_and_code(e)
                mine = {("note", masked_note(x, common)): x for x in notes}
                if code:
                    mine["code", masked_code(code)] = code
                out += [(f, r, said, sort, text, xxhash.xxh64_intdigest(re.sub(r"\d+", "0", x)) >> 1) for (sort, text), x in mine.items() if text]
            yield pd.DataFrame(out, columns=["file_id", "repo_id", "said", "sort", "text", "wording"])

    return current.where(F.col("excerpt").rlike(r"\S")).select("file_id", "repo_id", "said", "excerpt").mapInPandas(run, "file_id long, repo_id long, said string, sort string, text string, wording long")


def banded(texts: DataFrame) -> DataFrame:
    """(cls, sort, text) -> (cls, sort, text, made, bands): composition and MinHash bands of each class."""
    rng = np.random.default_rng(11)
    seeds = rng.integers(1, 2**63, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)
    rows = HASHES // BANDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            made, bands = [], []
            for sort, text in zip(b["sort"], b["text"]):
                x = np.fromiter({xxhash.xxh64_intdigest(s) for s in shingles(text)}, dtype=np.uint64)
                sig = ((x[:, None] * seeds[0] + seeds[1]) >> np.uint64(32)).min(axis=0)
                made.append(composition(text) if sort == "code" else "")
                bands.append([xxhash.xxh64_intdigest(sort.encode() + sig[k * rows : (k + 1) * rows].tobytes(), seed=k) >> 1 for k in range(BANDS)])
            yield b.assign(made=made, bands=bands)

    return texts.mapInPandas(run, "cls long, sort string, text string, made string, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """(cls, cluster) of every class in a link (cls, other): the least class it is linked to, directly or through others.

    Every round takes the least label among a class and its neighbours and then
    the label of that label, so that the number of rounds grows with the
    logarithm of the longest chain. It ends when a fingerprint of all labels
    stays the same.
    """
    back = links.select(F.col("other").alias("cls"), F.col("cls").alias("other"))
    both = links.unionByName(back)
    edges = cut(both.unionByName(both.select("cls", F.col("cls").alias("other"))).distinct())
    label, seen = edges.groupBy("cls").agg(F.min("other").alias("cluster")), None
    while True:
        near = label.select(F.col("cls").alias("other"), "cluster")
        stepped = edges.join(near, "other").groupBy("cls").agg(F.min("cluster").alias("cluster"))
        label = cut(stepped.join(stepped.select(F.col("cls").alias("cluster"), F.col("cluster").alias("onward")), "cluster").select("cls", F.col("onward").alias("cluster")))
        now = label.agg(F.bit_xor(F.xxhash64("cls", "cluster")).alias("x")).first()["x"]
        if now == seen:
            return label
        seen = now


def clusters(classes: DataFrame) -> DataFrame:
    """(cls, cluster) of the classes (cls, text, bands); every link of SIMILAR or more within a band counts.

    Each class is verified with the least class of its bands first; then all
    pairs of a band that are not joined yet are verified, in salted blocks, so
    that no link is lost however large a band is.
    """
    # sets of which one is smaller than SIMILAR times the other cannot be similar
    w = F.split("text", " ")
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - SHINGLE + 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    classes = cut(classes.select("cls", "text", "bands", F.size(F.array_distinct(own)).alias("size")))
    band = classes.select("cls", "size", F.explode(F.array_distinct("bands")).alias("band"))
    least = band.groupBy("band").agg(F.min(F.struct(F.col("cls").alias("other"), F.col("size").alias("of_size"))).alias("o")).select("band", "o.*")
    fits = (F.col("size") >= SIMILAR * F.col("of_size")) & (F.col("of_size") >= SIMILAR * F.col("size"))
    a = classes.select("cls", F.col("text").alias("a"))
    b = classes.select(F.col("cls").alias("other"), F.col("text").alias("b"))

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        made: dict[str, set[str]] = {}

        def of(t):
            if t not in made:
                if len(made) > 5_000:
                    made.clear()
                made[t] = shingles(t)
            return made[t]

        return pd.Series([len(p & q) >= SIMILAR * len(p | q) for p, q in ((of(s), of(t)) for s, t in zip(x, y))], dtype="bool")

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(pairs.distinct().join(a, "cls").join(b, "other").where(similar("a", "b")).select("cls", "other"))

    def labelled(label: DataFrame) -> DataFrame:
        return cut(classes.select("cls").join(label, "cls", "left").select("cls", F.coalesce("cluster", "cls").alias("cluster")))

    label = labelled(components(verified(band.join(least, "band").where(fits & (F.col("cls") > F.col("other"))).select("cls", "other"))))
    held = band.join(label, "cls").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    mixed = held.groupBy("band").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("band")
    held = cut(held.join(mixed, "band", "left_semi"))
    every = held.select(F.col("cls").alias("other"), F.col("cluster").alias("of_other"), F.col("size").alias("of_size"), "band", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    more = verified(held.join(every, ["band", "salt"]).where(fits & F.expr("cls > other and cluster != of_other")).select("cls", "other"))
    if more.isEmpty():
        return label
    # the clusters themselves are the classes of the second pass
    ends = more.join(label, "cls").withColumnRenamed("cluster", "x").join(label.select(F.col("cls").alias("other"), F.col("cluster").alias("y")), "other")
    merged = components(ends.select(F.greatest("x", "y").alias("cls"), F.least("x", "y").alias("other")).distinct())
    onward = merged.select(F.col("cls").alias("cluster"), F.col("cluster").alias("onward"))
    return cut(label.join(onward, "cluster", "left").select("cls", F.coalesce("onward", "cluster").alias("cluster")))


def cluster_labels(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, of_cluster, how): what each cluster that speaks says.

    members: (cls, cluster, file_id, repo_id, said, sort, wording). Composition
    speaks first; else marked members must be enriched; where these disagree the
    spread of the wordings decides between generated and vendored.
    """
    made = classes.join(members.select("cls", "cluster").distinct(), "cls").groupBy("cluster").agg(F.mode("made").alias("made"))
    base = members.groupBy("sort").agg((F.count("said") / F.count(F.lit(1))).alias("p"))  # two rows
    by_label = members.groupBy("cluster", "sort", "said").agg(F.count(F.lit(1)).alias("n"))
    told = by_label.groupBy("cluster", "sort").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("said").isNotNull(), F.col("n"))), F.lit(0)).alias("k"),
        F.max_by("said", F.struct(F.when(F.col("said").isNotNull(), F.col("n")), "said")).alias("said"), F.coalesce(F.max(F.when(F.col("said").isNotNull(), F.col("n"))), F.lit(0)).alias("most"),
    )
    # a wording that recurs in files of several repositories was carried there; one that stays at home was made there
    spread = members.groupBy("cluster", "wording", "repo_id").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster", "wording").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    spread = spread.groupBy("cluster").agg((F.sum(F.when(F.col("repos") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("shared"))
    q, p = F.col("k") / F.col("n"), F.col("p")
    surprise = F.col("n") * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    marked = (F.col("k") > 0) & (q >= F.when(F.col("sort") == "note", LEAST["note"]).otherwise(LEAST["code"])) & (q > p) & (surprise >= -np.log(CHANCE))
    family = F.when(F.col("most") >= PURE * F.col("k"), F.col("said")).when(F.col("shared") > 0.5, "vendored").otherwise("generated")
    return (
        told.join(F.broadcast(base), "sort").join(made, "cluster").join(spread, "cluster")
        .select("cluster", F.when(F.col("made") != "", F.col("made")).when(marked, family).alias("of_cluster"), F.when(F.col("made") != "", "composition").otherwise("family").alias("how"))
        .where(F.col("of_cluster").isNotNull())
    )


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, label, evidence) of files that nobody wrote by hand.

    evidence is ``path or tags``, ``composition`` or ``family``. Files without
    excerpt are judged by path and tags alone, so empty package files are
    hand-written; of several versions the latest counts; null paths and tags say
    nothing; data is only a case in a file that claims to be code. A family needs
    enough members to rule out chance, so a corpus of a few hundred files shows
    only the larger ones.
    """
    current = cut(current_files(files))
    unit = cut(units(current, common_words(current)).withColumn("cls", F.xxhash64("sort", "text")))
    classes = cut(banded(unit.groupBy("cls").agg(F.first("sort").alias("sort"), F.first("text").alias("text"))))
    label = broadcast_if_small(clusters(classes), settled=True)
    members = unit.drop("text").join(label, "cls")
    says = cluster_labels(members, classes)
    code = F.col("path").rlike(_CODE_SUFFIX)
    rank = F.struct((F.col("how") == "family").cast("int"), "of_cluster")
    heard = (
        members.select("file_id", "cluster").distinct().join(broadcast_if_small(says), "cluster")
        .groupBy("file_id").agg(F.min(F.when(F.col("of_cluster") != "blob", F.struct(rank.alias("r"), "of_cluster", "how"))).alias("other"), F.max(F.when(F.col("of_cluster") == "blob", F.col("how"))).alias("blob"))
    )
    found = current.select("file_id", "said", code.alias("code")).join(heard, "file_id", "left")
    blob = F.col("blob").isNotNull() & F.coalesce("code", F.lit(False))
    label = F.coalesce("said", F.when(blob, "blob"), F.col("other.of_cluster"))
    evidence = F.when(F.col("said").isNotNull(), "path or tags").when(blob, F.col("blob")).otherwise(F.col("other.how"))
    return found.where(label.isNotNull()).select("file_id", label.alias("label"), evidence.alias("evidence"))
