"""Texts that were cut off by a field limit or in mid-transfer.

A stack automaton reads each text once: fences, brackets, quotes, inline code,
emphasis and markup open and close, and what remains open at the end, broken
escapes and damaged characters mean a cut. A text without such a sign is judged
by how its last line ends. Where a missing full stop proves nothing (list
entries, subject lines, signatures) the lines of its own source are the baseline:
a line of that kind is whole if its last word also ends a fair share of such
lines where more text follows. Per source, lengths at which far more texts end
than at their neighbours are its field limits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut

#: A length is a field limit of its source if at least LIMIT_TEXTS texts have it,
#: LIMIT_TIMES as many as the LIMIT_SPAN lengths on either side have on average.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_SPAN, LIMIT_LEAST = 5, 8, 15, 60
SALTS = 8
#: A word ends lines of a kind if at least KNOWN of them end with it: those of the source, and as
#: many as WEIGHT lines of the whole corpus beside them. A kind with fewer than FEW lines in the corpus
#: proves nothing.
KNOWN, WEIGHT, FEW = 0.0005, 500, 20

# How editors and mail programs say that they left something out.
_LEFT_OUT = r"(?:truncated|cut(?: off)?|snip(?:ped)?|omitted|clipped|abridged|shortened|continued|more|gekürzt|abgeschnitten|tronqué|truncado|cortado)"
_OBJECT = r"(?:message |text |content |output |rest |comment |remainder )?(?:was |is |has been )?"
_IN_BRACKETS = re.compile(rf"\s*(?:(?:…|\.{{3}})|{_OBJECT}{_LEFT_OUT}[^\])>}}\n]{{0,30}})", re.I)
_IN_DASHES = re.compile(r"\s*(?:truncated|snip|cut)[^\n]{0,20}", re.I)
#: Broken escapes; none is longer than eight characters.
_ESCAPE = re.compile(r"(?:\\u?[0-9a-fA-F]{0,3}|&#?\w{0,6}|%[0-9A-Fa-f]?)$")
_MORE = re.compile(r"(?:read|show|see) more$", re.I)
_WORDED_MARK = re.compile(r"truncated|cut|snip|omitted|clipped|abridged|shortened|continued|more|gekürzt|abgeschnitten|tronqué|truncado|cortado", re.I)
_FENCE = re.compile(r"^\s{0,3}(?:>\s*)*(`{3,}|~{3,})(.*)$")
_BULLET = re.compile(r"^\s*(?:>\s*)*(?:[-*+•]|\d+[.)])\s+(?:\[[ xX]\]\s+)?\S")
_BARE_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s*$")
_URL_END = re.compile(r"(?:https?|ftp)://\S*$")
_URL_WHOLE = re.compile(r"(?:https?|ftp)://[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?::\d+)?(?:/[^\s]*[\w/=)#&~-])?/?[>)\]]?$", re.I)
_REF = re.compile(r"^\s*(?:[A-Z][\w-]*(?: [a-z][\w-]*)?:\s*)?(?:\(?#?[A-Z][A-Z0-9]*-\d+\)?|#\d+|![0-9]+|[0-9a-f]{7,40})(?:[,\s]+(?:[A-Z][A-Z0-9]*-\d+|#\d+))*$")
_TRAILER = re.compile(r"^[A-Z][a-z]+(?:-[A-Za-z]+)*(?: [a-z]+)?:\s?\S*$")
_SALUTE = re.compile(r"^\s*(?:--|—|(?:best|kind|warm)?\s*(?:regards|wishes)|best|thanks|thank you|cheers|sincerely|yours|gru(?:ß|ss)|(?:mit )?(?:freundlichen|besten|viele)n? gr(?:ü|ue)(?:ß|ss)en?|cordialement|bien à vous|saludos|atentamente|un saludo)\s*,?\s*$", re.I)
_SIGN = re.compile(r"^\s*(?:~|—|--|–)\s*\S")
_SETTING = re.compile(r"""^\s*(?:export\s+)?["']?[\w.\-/]+["']?\s*[=:]\s*(?:-?\d[\w.:+-]*|true|false|null|none|yes|no|on|off|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[\[{].*[\]}])\s*(?:,|;|[#;].*)?$""", re.I)
_SECTION = re.compile(r"^\s*\[{1,2}[\w.\- \"']+\]{1,2}\s*$")
_CODE_LINE = re.compile(r"^\s*(?:def |class |return\b|import |from \w+(?:\.\w+)* import |function\b|const |let |var |if .*:$|for .*:$|while .*:$|else:|try:|except|with .*:$|async |export |@\w+|[\w.\[\]]+\s*=\s*[\w.]+\(|[\w.]+\.\w+\(|[\w.]+\(.*\)\s*[;{]?$|[})\]]+[;,]?$)")
# Words that nothing complete ends with.
_DANGLING = frozenset("the a an and or of to for with from that which who whose because although while whether if than its their our your my is are was were been being der die das ein eine und oder von zu mit dass weil le la les un une des et ou de du que el los las una y o con por para".split())
_ENDS = ".!?。！？؟।"
_CLOSERS = "\"'”’»›)]}*_`›」』）"
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _open_code(text: str) -> str:
    """What code leaves open: innermost bracket or quote, or ''."""
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            triple = text[i : i + 3]
            if c != "`" and triple == c * 3:
                j = text.find(triple, i + 3)
                if j < 0:
                    return triple
                i = j + 3
                continue
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                return c
            if text[j] == "\n":
                i += 1  # an apostrophe
                continue
            i = j + 1
            continue
        if c == "#" or text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
        i += 1
    return stack[-1] if stack else ""


def _open_json(text: str) -> bool:
    depth, i, n = 0, 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            i += 1
            while i < n and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
            if i >= n:
                return True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        i += 1
    return depth > 0


def _mark_start(t: str) -> int:
    """Where the mark of omission at the end of ``t`` begins, or len(t); looks backwards from the end, however far it lies."""
    n, last = len(t), t[-1]
    if last == "…":
        return n - 1
    if t.endswith("..."):
        return len(t.rstrip("."))
    if last in "])>}":
        stop = len(t.rstrip("])>}"))
        p, line = stop, t.rfind("\n", 0, len(t[:stop].rstrip()))
        while True:
            p = max(t.rfind(c, 0, p) for c in "[(<{")
            if p < 0:
                break
            if _IN_BRACKETS.fullmatch(t, p + 1, stop):
                while p > 0 and t[p - 1] in "[(<{":
                    p -= 1
                return p
            if p < line:
                break
        # no mark
    elif last == "-" and t.endswith("--"):
        stop = len(t.rstrip("-"))
        p = t.rfind("--", 0, stop)
        if p >= 0 and _IN_DASHES.fullmatch(t, p + 2, stop):
            return len(t[:p].rstrip("-"))
    stop = n
    while stop and not (t[stop - 1].isalnum() or t[stop - 1] == "_"):
        stop -= 1
    m = _MORE.search(t, max(0, stop - 9), stop)
    if m:
        return m.start()
    m = _ESCAPE.search(t, max(0, n - 8))
    return m.start() if m else n


def _strip_tail(text: str) -> tuple[str, str]:
    """(text without line ends, invisible characters and marks of omission; the marks)."""
    marks = ""
    while True:
        t = text.rstrip()
        while t and (unicodedata.category(t[-1]) in ("Cf", "Cc", "Co", "Cs") or t[-1] == "�"):
            if t[-1] == "�":
                marks += t[-1]
            t = t[:-1].rstrip()
        if t:
            at = _mark_start(t)
            marks += t[at:]
            t = t[:at].rstrip()
        if t == text:
            return t, marks
        text = t


def _last_word(line: str) -> str:
    w = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", line)
    return w[-1].lower() if w else ""


def _kind(line: str) -> str:
    if _BULLET.match(line):
        return "list"
    if re.match(r"^\s*#{1,6}\s", line):
        return "heading"
    return "line"


def _looks_like_code(lines: list[str]) -> bool:
    body = [x for x in lines if x.strip()]
    hits = sum(bool(_CODE_LINE.match(x)) or x.startswith(("    ", "\t")) for x in body)
    return bool(body) and hits * 2 > len(body) and any(_CODE_LINE.match(x) for x in body)


def _looks_like_settings(lines: list[str]) -> bool:
    body = [x for x in lines if x.strip() and not x.lstrip().startswith(("#", ";", "//"))]
    hits = sum(bool(_SETTING.match(x) or _SECTION.match(x)) for x in body)
    return len(body) >= 2 and hits * 3 >= (len(body) - 1) * 2 and hits >= 2


def judge(text: str) -> tuple[str, str, str]:
    """(verdict, kind, word): ``cut``, ``whole``, or ``ask`` the baseline whether ``word`` ends lines of ``kind``.

    For kind ``line`` the word is the first and the last of the line. Blank text is whole.
    """
    core, marks = _strip_tail(text.replace("\r\n", "\n").replace("\r", "\n"))
    if not core:
        return ("whole", "stop", "")
    if "\ufffd" in marks or (marks and _WORDED_MARK.search(marks)):
        return ("cut", "mark", "")
    lines = core.split("\n")
    fence, since = "", 0
    for k, line in enumerate(lines):
        m = _FENCE.match(line)
        if m and not fence:
            fence, since = m[1], k
        elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
            fence, since = "", k + 1
    if fence:
        return ("cut", "fence", "")
    head = core.lstrip()
    if head[0] == "{" or head[0] == "[" and not _SECTION.match(lines[0]) and re.match(r"\[\s*(?:[\[{\"\d\]-]|true|false|null)", head):
        return ("cut", "json", "") if _open_json(head) else ("whole", "stop", "") if head[-1] in "}]" else _judge_line(core, lines, marks)
    prose = not since or since < len(lines)
    if not prose or (since == len(lines)):
        return ("cut", "mark", "") if marks else ("whole", "stop", "")
    tail = lines[since:]
    if _looks_like_settings(tail):
        return _judge_setting(tail, marks)
    if not since and _looks_like_code(tail):
        return _judge_code(core, tail, marks)
    return _judge_line(core, lines, marks)


def _judge_setting(lines: list[str], marks: str) -> tuple[str, str, str]:
    last = lines[-1]
    if marks:
        return ("cut", "mark", "")
    if last.lstrip().startswith(("#", ";")):
        s = last.rstrip()
        return ("whole", "setting", "") if s[-1] in _ENDS else ("cut", "setting", "")
    return ("whole", "setting", "") if _SETTING.match(last) or _SECTION.match(last) else ("cut", "setting", "")


def _judge_code(core: str, lines: list[str], marks: str) -> tuple[str, str, str]:
    if marks or _open_code(core):
        return ("cut", "code", "")
    last = lines[-1].strip()
    if last.startswith(("#", "//")):
        return ("whole", "code", "") if last[-1] in _ENDS else ("cut", "code", "")
    if m := re.match(r"^(?:return|raise|yield|await|throw|del|goto|break|continue)\s+(?:[\w.]+\.)?(\w+);?$", last):
        seen = len(re.findall(rf"\b{re.escape(m[1])}\b", core))
        return ("whole", "stop", "") if seen > 1 or m[1] in ("None", "True", "False", "null", "true", "false", "undefined") or m[1].isdigit() else ("cut", "code", "")
    if last in ("return", "pass", "break", "continue", "return;", "else", "end", "raise"):
        return ("whole", "stop", "")
    if last[-1] in "})];,\"'" or last.endswith("*/"):
        return ("whole", "code", "") if last[-1] != "," else ("cut", "code", "")
    if re.match(r"^(?:import\s+[\w.]+|from\s+[\w.]+\s+import\s+[\w., ]+|@[\w.]+)$", last):
        return ("whole", "code", "")
    m = re.match(r"^[\w.\[\]]+\s*[-+*/|&]?=\s*(.+)$", last)
    if m and (re.match(r"^-?\d[\w.]*$", m[1]) or re.search(r"\b(\w+)$", m[1]) and len(re.findall(rf"\b{re.escape(re.search(r'(\w+)$', m[1])[1])}\b", core)) > 1):
        return ("whole", "code", "")
    return ("cut", "code", "")


def _judge_line(core: str, lines: list[str], marks: str) -> tuple[str, str, str]:
    last = lines[-1].strip()
    bare = re.sub(r"^(?:>\s*)+", "", last).strip() or last
    closed = bare.rstrip(_CLOSERS + " ")
    above = next((x.strip() for x in reversed(lines[:-1]) if x.strip()), "")
    ended = bool(closed) and closed[-1] in _ENDS and not _URL_END.search(bare)
    while bare and not ended and unicodedata.category(bare[-1]) in ("So", "Sk", "Mn", "Me") and len(bare) > 1:
        bare = bare[:-1].rstrip()
        closed = bare.rstrip(_CLOSERS + " ")
        ended = bool(closed) and closed[-1] in _ENDS
    if ended:
        if marks:
            return ("whole", "mark", "") if not closed.endswith("...") else ("cut", "mark", "")
        return ("cut", "bracket", "") if _unclosed(lines) else ("whole", "stop", "")
    if marks:
        return ("cut", "mark", "")
    if bare.startswith("|"):
        width = next((x.count("|") for x in lines if x.strip().startswith("|") and x.strip().endswith("|")), 0)
        return ("whole", "stop", "") if bare.endswith("|") and len(bare) > 1 and (not width or bare.count("|") >= width) else ("cut", "table", "")
    if _URL_END.search(bare):
        return ("whole", "url", "") if _URL_WHOLE.search(bare) else ("cut", "url", "")
    if _BARE_BULLET.match(bare):
        return ("cut", "list", "")
    if _SALUTE.match(above) and len(bare.split()) <= 7:
        return ("ask", "sign", _last_word(bare))
    if _SALUTE.match(bare):
        return ("cut", "sign", "")
    if _SIGN.match(bare) and len(bare.split()) <= 8:
        return ("ask", "sign", _last_word(bare))
    if _REF.match(bare) and any(c.isdigit() for c in bare):
        return ("whole", "ref", "")
    if _SETTING.match(bare) and not re.match(r"^[A-Z]?[a-z]+: ", bare):
        return ("whole", "setting", "")
    if _SECTION.match(bare):
        return ("whole", "setting", "")
    if bare[-1] in ",;:(-–—/\\=+&<[{\"'«“" and not bare.endswith(("-->", "---", "***", "```")):
        if re.fullmatch(r"[-=*_~]{3,}", bare):
            return ("whole", "stop", "")
        if not (bare[-1] in "\"'" and bare.count(bare[-1]) % 2 == 0 and len(closed) and closed[-1] in _ENDS):
            return ("cut", "open", "")
    if re.fullmatch(r"[-=*_~]{3,}", bare):
        return ("whole", "stop", "")
    if _TRAILER.match(bare):
        return ("cut", "ref", "")
    kind = _kind(bare)
    if _last_word(bare) in _DANGLING and len(bare.split()) > 2:
        return ("cut", kind, "")
    if kind in ("list", "heading"):
        return ("cut", kind, "") if _unclosed(lines[-1:]) else ("ask", kind, _last_word(bare))
    if _CODE_LINE.match(lines[-1]) and bare[-1] in ")}];" and not _unclosed(lines[-1:]):
        return ("whole", "code", "")
    if _title_like(bare):
        return ("cut", "line", "") if _unclosed(lines[-1:]) else ("ask", "line", f"{_last_word(bare.split()[0])} {_last_word(bare)}")
    return ("cut", "line", "")


def _title_like(line: str) -> bool:
    words = line.split()
    return 1 <= len(words) <= 12 and not re.search(r"[.;!?](\s|$)|,\s", line)


# Markup that must be closed.
_PAIRED_TAGS = frozenset("a b i u s em strong code pre span div ul ol table blockquote details summary sub sup kbd mark small h1 h2 h3 h4 h5 h6".split())
_PROSE_TOKEN = re.compile(r"`+|https?://\S+|[:;=]-?[(\[{)\]}](?=\s|$)|\[[ xX]\]|</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>\n]*)?/?>|\*\*|~~|[(\[)\]\"“”„«»]")


def open_prose(text: str) -> str:
    """The innermost of bracket, quote, inline code, emphasis or markup that prose opens and does not close, or ''.

    A straight quote opens only before a word and after a blank or bracket, so
    that inch marks do not count; apostrophes never do. What a closing mark
    encloses is closed with it.
    """
    stack: list[str] = []

    def close(mark: str) -> bool:
        if mark not in stack:
            return False
        while stack.pop() != mark:
            pass
        return True

    at = 0
    while m := _PROSE_TOKEN.search(text, at):
        at, tok = m.end(), m[0]
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[at : at + 1]
        if tok[0] == "`":
            end = text.find(tok, at)
            if end < 0:
                return "`" if len(tok) == 1 and after.strip() else stack[-1] if stack else ""
            at = end + len(tok)
        elif tok in ("(", "["):
            stack.append(tok)
        elif tok in (")", "]"):
            close(_PAIRS[tok])
        elif tok == '"':
            if not close('"') and (not before or before.isspace() or before in "([{-–—/“„«»*_>") and after and not after.isspace():
                stack.append('"')
        elif tok in ("**", "~~"):
            if not close(tok) and after and not after.isspace() and (not before or not before.isalnum()):
                stack.append(tok)
        elif tok == "„":
            stack.append(tok)
        elif tok == "“":
            close("„") or stack.append(tok)
        elif tok == "”":
            close("“") or close("„")
        elif tok == "«":
            close("»") or stack.append(tok)
        elif tok == "»":
            close("«") or (after and not after.isspace() and stack.append(tok))
        elif tok[0] == "<" and (tag := m[1].lower()) in _PAIRED_TAGS and not tok.endswith("/>"):
            close(f"<{tag}>") if tok[1] == "/" else stack.append(f"<{tag}>")
    return stack[-1] if stack else ""


def _unclosed(lines: list[str]) -> bool:
    """Whether the last paragraph of prose leaves something open."""
    text = []
    for x in reversed(lines):
        if not x.strip():
            break
        text.append(x)
    return bool(open_prose("\n".join(reversed(text))))


def _baseline_lines(text: str) -> Iterator[tuple[str, str]]:
    """(kind, last word) of lines without a full stop that stand whole: more text follows them.

    Signature lines end a text and are counted there.
    """
    core, _ = _strip_tail(text.replace("\r\n", "\n").replace("\r", "\n"))
    lines = core.split("\n")
    fenced, above = False, ""
    for k, line in enumerate(lines):
        s = line.strip()
        if _FENCE.match(line):
            fenced, above = not fenced, s
            continue
        if fenced or not s:
            continue
        if k == len(lines) - 1:
            if _SALUTE.match(above) and len(s.split()) <= 7 or _SIGN.match(s) and len(s.split()) <= 8:
                yield ("sign", _last_word(s))
            break
        if s[-1] not in _ENDS + ",:;|" and not _CODE_LINE.match(line) and not _SETTING.match(s):
            kind = _kind(s)
            if kind != "line" or (not above or not lines[k - 1].strip()) and not lines[k + 1].strip() and _title_like(s) or not above and _title_like(s):
                yield (kind, _last_word(s))
                if kind == "line":
                    yield ("opener", _last_word(s.split()[0]))
        above = s


def signs(documents: DataFrame) -> DataFrame:
    """One pass over all texts that are not blank; two sorts of rows.

    (doc_id, source, verdict, kind, word, opener, chars, octets) of each text,
    and with verdict ``line`` the number n of whole lines of a source and kind
    that end with a word, counted a batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [judge(t) for t in b["text"]]
            words = [x[2].rpartition(" ") for x in v]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "verdict": [x[0] for x in v], "kind": [x[1] for x in v], "word": [w[2] for w in words], "opener": [w[0] for w in words], "chars": b["chars"], "octets": b["octets"], "n": 1})
            n = Counter((s, *x) for s, t in zip(b["source"], b["text"]) for x in _baseline_lines(t))
            yield pd.DataFrame([(None, s, "line", k, w, "", None, None, c) for (s, k, w), c in n.items()], columns=["doc_id", "source", "verdict", "kind", "word", "opener", "chars", "octets", "n"]).astype({"doc_id": "Int64", "chars": "Int32", "octets": "Int32"})

    texts = documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", "source", "text", F.length("text").alias("chars"), F.octet_length("text").alias("octets"))
    return texts.mapInPandas(run, "doc_id long, source string, verdict string, kind string, word string, opener string, chars int, octets int, n long")


def unknown_ends(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """(source, kind, word, opener, unknown) of every distinct question: whether its words end, and open, too few lines.

    The share of a word is that among its source's lines of the kind together
    with WEIGHT lines that end as those of the whole corpus do, so that a source
    with few lines leans on the others. A signature counts among its own lines
    and is taken off.
    """
    own = cut(lines.groupBy("source", "kind", "word").agg(F.sum("n").alias("n")))
    everywhere = own.groupBy("kind", "word").agg(F.sum("n").alias("n_all"))
    of_source = own.groupBy("source", "kind").agg(F.sum("n").alias("total"))
    of_kind = F.broadcast(own.groupBy("kind").agg(F.sum("n").alias("total_all")))  # one row per kind, of which there are five

    def share(keys: DataFrame) -> DataFrame:
        """(source, kind, word) -> (..., share, total_all)"""
        x = keys.join(own, ["source", "kind", "word"], "left").join(everywhere, ["kind", "word"], "left").join(of_source, ["source", "kind"], "left").join(of_kind, "kind", "left")
        itself = F.when(F.col("kind") == "sign", 1).otherwise(0)
        n, n_all = (F.greatest(F.coalesce(c, F.lit(0)) - itself, F.lit(0)) for c in ("n", "n_all"))
        total, total_all = F.coalesce("total", F.lit(0)), F.coalesce("total_all", F.lit(0))
        return x.select(*keys.columns, ((n + WEIGHT * n_all / F.greatest(total_all, F.lit(1))) / (total + WEIGHT)).alias("share"), total_all.alias("total_all"))

    keys = asked.select("source", "kind", "word", "opener").distinct()
    ends = share(keys.select("source", "kind", "word").distinct())
    opens = share(keys.where("opener != ''").select("source", F.when(F.col("opener") != "", "opener").alias("kind"), F.col("opener").alias("word")).distinct())
    opens = opens.select("source", F.col("word").alias("opener"), F.col("share").alias("opening"))
    rare = (F.col("share") < KNOWN) | ((F.col("opener") != "") & (F.col("opening") < KNOWN))
    return keys.join(ends, ["source", "kind", "word"]).join(opens, ["source", "opener"], "left").select("source", "kind", "word", "opener", (F.coalesce(rare, F.lit(False)) & (F.col("total_all") >= FEW)).alias("unknown"))


def field_limits(lengths: DataFrame) -> DataFrame:
    """(source, unit, length) of the field limits that the lengths show; lengths: (source, chars, octets)."""
    each = lengths.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("octets").alias("unit"), F.col("octets").alias("length")))).alias("x")).select("source", "x.*")
    n = each.where(F.col("length") >= LIMIT_LEAST).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-LIMIT_SPAN, LIMIT_SPAN)
    others = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_SPAN)
    return n.withColumn("others", others).where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_TIMES * F.greatest("others", F.lit(0.5)))).select("source", "unit", "length")


def truncation_signs(documents: DataFrame) -> DataFrame:
    """(doc_id, source, is_cut, kind) of every document with text that is not blank.

    Texts are read once; all else works on the narrow rows of that pass, and
    only texts that ask for the baseline are joined with it. Repeated rows give
    one; null sources share one baseline. Where the corpus has fewer than FEW
    whole lines of a kind, a missing full stop proves nothing.
    """
    seen = cut(signs(documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))))
    texts = seen.where("verdict != 'line'").drop("n")
    asked = texts.where("verdict = 'ask'")
    limits = field_limits(texts.select("source", "chars", "octets"))
    at = broadcast_if_small(limits.groupBy("source").agg(*(F.collect_set(F.when(F.col("unit") == u, F.col("length"))).alias(f"at_{u}") for u in ("chars", "octets"))))
    unknown = cut(unknown_ends(asked, seen.where("verdict = 'line'").select("source", "kind", "word", "n")))
    # a question that very many texts ask is spread over SALTS tasks if the answers are too many to broadcast
    answers = broadcast_if_small(unknown.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    answered = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(answers, ["source", "kind", "word", "opener", "salt"], "left").join(at, "source", "left")
    # a text of exactly the limit may be whole: the limit decides only where a subject line could also be a sentence
    limited = F.coalesce(F.array_contains("at_chars", F.col("chars")) | F.array_contains("at_octets", F.col("octets")), F.lit(False))
    is_cut = F.coalesce("unknown", F.lit(False)) | ((F.col("kind") == "line") & limited)
    return texts.where("verdict != 'ask'").select("doc_id", "source", (F.col("verdict") == "cut").alias("is_cut"), "kind").unionByName(answered.select("doc_id", "source", is_cut.alias("is_cut"), "kind")).distinct()


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents whose text was cut off; null, empty and blank texts are none."""
    return truncation_signs(documents).where("is_cut").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share): how often each source truncates."""
    per_doc = truncation_signs(documents).groupBy("doc_id", "source").agg(F.max("is_cut").alias("is_cut"))
    n_cut = F.sum(F.col("is_cut").cast("long"))
    return per_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), n_cut.alias("n_cut"), F.round(n_cut / F.count(F.lit(1)), 6).alias("share"))
