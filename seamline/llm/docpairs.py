"""Functions paired with their documentation.

Comment spans are extracted from source text and function spans come from the
symbols table, independently of each other. An as-of join gives each function
the nearest comment that ends before it; the pair is rejected if a statement or
more blank lines than allowed lie between. What remains of the documentation
after everything that explains nothing is removed is the description.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import plain

LINE_BLOCK = 2048
MIN_WORDS, MIN_NEW = 4, 2

# a slash begins a regular expression where no value can end
_JS_TOKEN = re.compile(r"(?:(?<=[(,=:\[!&|?{};+*%<>~^-])|(?<=return)|(?<=typeof)|^)[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S | re.M)
_PY_TOKEN = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S)


def comment_spans(content: str, language: str | None) -> list[tuple[int, int, int, str]]:
    """(first line, last line, next statement's line, text) of comments on lines of their own.

    Lines count from 1. Comments on adjoining lines are one span. A comment that
    shares a line with code is no span; the line is a statement.
    """
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    python = plain_language(language) == "python"
    lines = content.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    only = [False] * (len(lines) + 2)  # lines that hold nothing but comment
    code = [bool(x.strip()) for x in lines]
    at = 0
    for m in (_PY_TOKEN if python else _JS_TOKEN).finditer(content):
        is_comment = m[0][0] == "#" if python else m[0][:2] in ("//", "/*")
        if not is_comment:
            continue
        while starts[at + 1] <= m.start():
            at += 1
        first = at
        last = first + m[0].count("\n")
        before = content[starts[first] : m.start()].strip()
        after = content[m.end() : starts[last + 1] - 1].strip()
        if after and not (after.startswith("//") or after.startswith("/*")):
            continue
        if before and not only[first]:
            continue
        for k in range(first, last + 1):
            only[k] = True
            code[k] = False
    spans, k, n = [], 0, len(lines)
    following = [n + 1] * (n + 1)
    for k in range(n - 1, -1, -1):
        following[k] = k + 1 if code[k] else following[k + 1]
    k = 0
    while k < n:
        if not only[k]:
            k += 1
            continue
        j = k
        while j + 1 < n and only[j + 1]:
            j += 1
        spans.append((k + 1, j + 1, following[j + 1] if j + 1 < n else n + 1, "\n".join(lines[k : j + 1])))
        k = j + 1
    return spans


def plain_language(language: str | None) -> str:
    return (language or "").strip().lower()


def extract_comments(sources: DataFrame) -> DataFrame:
    """(file_id, content) -> (file_id, python, first_line, last_line, next_code, text).

    The table of texts does not say which language they are in, so each is read
    once as Python and once as a script where it is: only spans travel, no text
    is moved to learn its language.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, g == "python", *s) for f, c in zip(b["file_id"], b["content"]) for g in ("python", "script") for s in comment_spans(c, g)]
            yield pd.DataFrame(rows, columns=["file_id", "python", "first_line", "last_line", "next_code", "text"])

    return sources.where(F.col("content") != "").select("file_id", "content").mapInPandas(run, "file_id long, python boolean, first_line long, last_line long, next_code long, text string")


def nearest_comment(functions: DataFrame, comments: DataFrame, max_blank: int = 0) -> DataFrame:
    """As-of join: functions (file_id, symbol_id, first_line, ...) gain ``comment``.

    The comment is the nearest span that ends before the first line, if no
    statement and at most ``max_blank`` blank lines lie between; functions
    without one are dropped. Sorting is per file and block of lines, so that one
    long file does not become one task; spans are repeated into the next block
    when a function within reach may start there.
    """
    reach = F.col("last_line") + 1 + max_blank
    block = lambda c: F.floor(c / LINE_BLOCK)
    spans = comments.select(
        "file_id",
        F.explode(F.array_distinct(F.array(block(F.col("last_line") + 1), block(reach)))).alias("block"),
        (F.col("last_line") + 1).alias("at"),
        F.struct("last_line", "next_code", "text").alias("span"),
    )
    extra = [c for c in functions.columns if c not in ("file_id", "first_line")]
    wanted = functions.select("file_id", block(F.col("first_line")).alias("block"), F.col("first_line").cast("long").alias("at"), F.struct(*extra).alias("fn"))
    w = Window.partitionBy("file_id", "block").orderBy("at", F.col("fn").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spans.unionByName(wanted, allowMissingColumns=True)
        .withColumn("near", F.last("span", ignorenulls=True).over(w))
        .where(F.col("fn").isNotNull() & F.col("near").isNotNull())
        .where((F.col("at") <= F.col("near.last_line") + 1 + max_blank) & (F.col("near.next_code") >= F.col("at")))
        .select("file_id", "fn.*", F.col("near.text").alias("comment"))
    )


# Marks of text that documents nothing.
_LICENCE = re.compile(r"^\W*(copyright\b|\(c\)\s*\d{4}|©|spdx-|licen[sc]ed (under|to)\b|all rights reserved|permission is hereby granted|redistribution and use|this (file|program|software|code) is (part of|free software|licen[sc]ed|distributed|subject)|this (source code|work) is (licen[sc]ed|subject)|the software is provided|distributed under|use of this source code|(mit|bsd|apache|gpl|mpl)\b[\w .-]* licen[sc]e)", re.I)
_PENDING = re.compile(r"^\W*(todo|fixme|xxx|hack|tbd|tbc|wip)\b\s*(\(|:|-|–|—|\.|!|$|\W*(write|document|add|docs?|describe|explain|fill|later|this|me|missing|needs?|somebody|someone|please)\b)", re.I)
_PLACEHOLDER = re.compile(
    r"^\W*(to be (documented|written|done|described|added|defined|filled|completed|announced)|(a )?(description|summary|documentation|docs?|docstring|comment|explanation|text) (goes|go|comes|will (go|come|follow)|to (come|follow|be)|follows? (later|soon)|pending|missing|here|needed|required|is (missing|pending|to be|needed|still))|(insert|enter|add|put|write|provide|place|type) (a |an |the |your |some |proper |short |brief )*(description|summary|documentation|docs?|docstring|comment|text|explanation)|no (description|documentation|docs?|docstring|comment|summary)|not (yet )?(documented|described|written)|undocumented|missing (description|documentation|docs?|docstring|comment)|auto-?\s?generated (method|function|constructor|class|catch|property)?\s*(stub|comment|docstring|documentation|block)|generated (method|function) stub|this (text|comment|docstring|description|block|stub) (was|is|has been) (inserted|generated|added|created|a placeholder|left)|please (replace|fill|add|write|document|describe)\b.*\b(description|documentation|docs?|docstring|text|comment)|_summary_|_description_|_type_|\[(summary|description|type)\]|<(summary|description)>\s*(</|$)|lorem ipsum|placeholder\W*$|n/?a\W*$|none\W*$|foo ?bar\W*$|will be (documented|described|written|added)|(nobody|somebody|someone) (who |has |should |must |needs? |will |ever )*.*\b(explain|document|describe|write)\b|(documentation|docs?|description) (for|of) this .*(later|soon|pending|follow))",
    re.I,
)
_DIRECTIVE = re.compile(r"^\W*(noqa\s*(:|$)|type:\s*ignore|pragma\s*:|pylint\s*:|eslint(-|\s*$)|eslint\s+[\w-]+\s*:|@ts-|ts-(ignore|expect|nocheck)|@flow\b|prettier-ignore|istanbul ignore|c8 ignore|v8 ignore|flake8\s*:|mypy\s*:|pyright\s*:|ruff\s*:|fmt\s*:\s*(on|off|skip)|isort\s*:|nosec\b(\s*:|\s*$|\s+b\d)|nolint|biome-ignore|tslint\s*:|jshint\s|jslint\s|jscs\s*:|sourcemappingurl|webpack\w+\s*:|#?(end)?region\b|yapf\s*:|black\s*:|coverage\s*:|stylelint-|vim\s*:|-\*-|@jsx\b|@vite-|@preserve\b|@license\b|@internal\s*$|@private\s*$|@public\s*$|@deprecated\s*$|@override\s*$|@async\s*$|codespell\s*:|cspell\s*:|spell-?checker\s*:|sonar|NOSONAR)", re.I)
_POINTER = re.compile(r"^\W*(@?see(\s+also)?\b|refer to\b|cf\.|@?inherit(s|ed|doc)?\b|@?overrid(es?|den|ing)\b|\{@(inherit\w*|link\w*|see)\b[^}]*\}|same as\b|identical to\b|documented (in|at|by|on)\b|described (in|at|by)\b|(for )?(docs|documentation|details|description|more information|more details|further details|the documentation|the description)\W+(see|in|at|are in|is in|can be found|live|lives)\b|(is )?(an )?alias (for|of|to)\b|delegates to\b|copied from\b|@?implements?\s+\S+\W*$|(the )?doc(umentation|s|string)? (is|are|lives?|can be found) (in|at|on|with|under)\b|look (at|in|into|up)\b.*\b(docs?|documentation|parent|base|instead)\b|deprecated\W+use\s+\S+(\s+instead)?\W*$)", re.I)
_CLAUSE = re.compile(r"[;—]|\s–\s|,\s*(but|except|which|because|since|so|unless|yet|and then)\b|\bexcept\b|\bbut\b", re.I)
_SECTION = re.compile(r"^\s*(args?|arguments?|param(eter)?s?|keyword args|keyword arguments|other parameters|returns?|return value|yields?|raises?|throws|exceptions?|attributes?|inputs?|outputs?|notes?|examples?|usage|summary|description|type|types|rtype|see also)\s*:?\s*$", re.I)
_TAG = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|prop|property|returns?|return|throws|exception|raises|type|typedef|template|yields?|rtype)\b|:(?:param|type|arg|keyword|key|return|returns|rtype|raises|raise|yields?)\b[^:]*:?)\s*(?:\{[^}]*\})?\s*(.*)$", re.I | re.S)
_TAG_NAME = re.compile(r"^\s*[@\\](?:param|arg|argument|prop|property)\b", re.I)
_ENTRY = re.compile(r"^\s*[-*]?\s*[`*]{0,2}[\w.$*]+[`*]{0,2}\s*(?:\([^)]*\)|\[[^\]]*\])?\s*:\s*(.*)$", re.S)
_CODE_LINE = re.compile(r"^\s*(async\s+)?(def\s+\w+\s*\(.*|function\b\s*\*?\s*\w*\s*\(.*|[\w.$]+\s*\([^()]*\)\s*[:{;]?|->.*|class\s+\w+\W*)$")
_FILLER = frozenset(
    "a an the this that these those it its is are be was of to for with from in on by as at and or will do does did can may function method class helper util utility routine procedure callable wrapper implementation implements private public protected internal api simple basic generic default main here there self cls args arg param params parameter parameters return returns returning value values object instance none null void str int bool float list dict any type types string number boolean def async const let var export static get set".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if len(w) - len(end) >= 3 and w.endswith(end):
            return w[: -len(end)]
    return w


def subwords(identifier: str) -> list[str]:
    return [m for m in _SUBWORD.findall(identifier)]


def strip_markers(doc: str) -> list[str]:
    """Lines of a comment or docstring without comment markers."""
    doc = doc.replace("\r\n", "\n").replace("\r", "\n")
    out = []
    for line in doc.split("\n"):
        line = re.sub(r"^\s*(/\*+!?|\*+/|//+[!/]?|#+!?(?=\s|$)|\*+(?=\s|$|[^*\s]))\s?", "", line)
        line = re.sub(r"\s*\*+/\s*$", "", line)
        line = re.sub(r"^\s*[rRuUbB]?(\"\"\"|''')|(\"\"\"|''')\s*$", "", line)
        out.append(re.sub(r"</?[a-zA-Z][^<>]*>", " ", line).rstrip())
    return out


def _keep(sentence: str) -> str:
    """The part of a sentence that may be prose."""
    s = sentence.strip()
    if not s or _DIRECTIVE.match(s) or _PLACEHOLDER.match(s) or _CODE_LINE.match(s):
        return ""
    if _POINTER.match(s):
        m = _CLAUSE.search(s)
        return s[m.end() :].strip() if m else ""
    return s


def describe(doc: str | None, signature: str | None, name: str | None = None) -> str:
    """Description within a documentation text, or '' if it says nothing.

    Removed at any length: licence notices, notes that documentation is still to
    be written, template filler, directives to tools, bare pointers elsewhere,
    and lists of parameters or types without explanation. What is left must have
    MIN_WORDS words, MIN_NEW of them neither words of the signature nor filler.
    """
    if not doc or not doc.strip():
        return ""
    paragraphs, now = [], []
    for line in strip_markers(doc):
        if line.strip():
            now.append(line)
        elif now:
            paragraphs.append(now)
            now = []
    if now:
        paragraphs.append(now)
    kept: list[str] = []
    in_list = False
    for p in paragraphs:
        if _LICENCE.match(p[0]):
            continue
        text: list[str] = []
        for line in p:
            s = line.strip()
            if not re.search(r"[^\W\d_]", s):
                continue
            if _SECTION.match(s):
                in_list = bool(re.match(r"\s*(args?|arguments?|param|keyword|other|returns?|return value|yields?|raises?|throws|exceptions?|attributes?|types?|inputs?|outputs?)", s, re.I))
                text.append("\0")
                continue
            if _LICENCE.match(s):
                text.append("\0")
                break
            if _PENDING.match(s):
                text.append("\0")
                break
            if m := _TAG.match(s):
                rest = m[1]
                if _TAG_NAME.match(s):
                    rest = re.sub(r"^\[?[\w.$*]+(=[^\]]*)?\]?\s*[-–:]?\s*", "", rest)
                text += ["\0", _explained(rest), "\0"]
                continue
            if in_list and line[:1].isspace() or in_list and _ENTRY.match(line):
                m = _ENTRY.match(line)
                text += ["\0", _explained(m[1]) if m else s, "\0"] if m else [s]
                continue
            in_list = False
            text.append(s)
        for chunk in " ".join(text).split("\0"):
            for sentence in re.split(r"(?<=[.!?])\s+", chunk):
                s = sentence.strip()
                if _PENDING.match(s):
                    break
                if _LICENCE.match(s):
                    break
                if s := _keep(s):
                    kept.append(s)
    own = {_stem(w) for w in subwords(signature or "")} | {_stem(w) for w in subwords(name or "")}
    whole = {w.lower() for w in re.findall(r"\w+", f"{signature or ''} {name or ''}")}
    words, new = 0, 0
    for w in re.findall(r"\w+(?:['’]\w+)?", " ".join(kept)):
        parts = subwords(w)
        if not parts:
            continue
        words += 1
        if w.lower() in whole or all(_stem(x) in own or x.lower() in _FILLER for x in parts):
            continue
        new += 1
    return " ".join(kept) if words >= MIN_WORDS and new >= MIN_NEW else ""


def _explained(text: str) -> str:
    """Explanation of a parameter, or '' for a bare type or placeholder."""
    t = text.strip()
    return t if len(_WORD.findall(t)) >= 3 and not _PLACEHOLDER.match(t) else ""


def documented_functions(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, signature, description) of functions and methods that are explained.

    Symbols of other types, blank signatures and documentation that says nothing
    give no row; repeated rows give one; a null docstring falls back to the
    comment directly above the first line (the smaller of line_start and
    line_end; none if both are null); empty tables give no rows.
    """
    fns = symbols.where(plain("symbol_type").isin("function", "method") & (F.trim("signature") != "")).select(
        F.col("id").alias("symbol_id"), "file_id", "name", "language", "signature", "docstring", F.least("line_start", "line_end").alias("first_line")
    )
    direct = fns.where(F.col("docstring").isNotNull()).select("symbol_id", "name", "signature", "docstring")
    bare = fns.where(F.col("docstring").isNull() & F.col("first_line").isNotNull()).distinct()
    python = bare.groupBy("file_id").agg((F.max(plain("language")) == "python").alias("python"))
    spans = extract_comments(sources).join(python.select("file_id", F.coalesce("python", F.lit(False)).alias("python")), ["file_id", "python"]).drop("python").distinct()
    above = nearest_comment(bare.select("file_id", "first_line", "symbol_id", "name", "signature"), spans)
    both = direct.unionByName(above.select("symbol_id", "name", "signature", F.col("comment").alias("docstring")))

    @F.pandas_udf("string")
    def said(doc: pd.Series, signature: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([describe(d, s, n) for d, s, n in zip(doc, signature, name)])

    return (
        both.distinct()
        .withColumn("description", said("docstring", "signature", "name"))
        .where(F.col("description") != "")
        .select("symbol_id", "signature", "description")
        .distinct()
    )
