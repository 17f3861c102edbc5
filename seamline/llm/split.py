"""Splitting oversized items at natural boundaries by pointer doubling.

Every position of an item has a farthest legal successor: the end of the piece
that starts there, less the overlap. Squaring the successor table (``f = f o f``)
while marking what the marked starts reach derives all greedy cuts in O(log
pieces) steps instead of one step per piece.

Items of up to BLOCK units share one table per Arrow batch. A longer item is cut
into blocks that are read apart. A piece enters a block at one of its first
positions; each block is squared to a table that sends every such entry to the
entry of the next block, and these tables are squared by joins until the entries
that the first piece reaches are known in all blocks.

Items are texts (one unit per code point) or line ranges (one unit per line,
described by one byte per line that says how strongly the code pauses before it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

LINES, LINE_OVERLAP = 80, 5
CHARS, CHAR_OVERLAP = 250, 30
#: Units of text that one numpy pass holds; more items of a batch go to the next pass.
PASS_UNITS = 4_000_000
#: Units of an item beyond which it is cut in blocks of so many.
BLOCK = 1_000_000
#: Characters around a block on which the strength of its cuts depends.
AROUND = 8


def text_strength(text: str) -> np.ndarray:
    """For each of len(text)+1 cut positions 0..5: 0 splits a character cluster, 1 a word,
    2 follows a blank, 3 a sentence, 4 a line, 5 a paragraph."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    s = np.ones(n + 1, dtype=np.uint8)
    if not n:
        return s
    blank = (c == 32) | ((c >= 9) & (c <= 13)) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x3000) | (c == 0x85)
    end = np.isin(c, np.array([ord(x) for x in ".!?。！？…"], dtype=np.uint32))
    line = (c == 10) | (c == 13)
    s[1:][blank] = 2
    s[2:][end[:-1] & blank[1:]] = 3
    s[1:][np.isin(c, np.array([ord(x) for x in "。！？"], dtype=np.uint32))] = 3
    s[1:][line] = 4
    s[2:][line[:-1] & (c[1:] == 10) & (c[:-1] == 10)] = 5
    if n > 2:
        s[4:][(c[:-3] == 13) & (c[1:-2] == 10) & (c[2:-1] == 13) & (c[3:] == 10)] = 5
    # a pause ends with its last blank, so that pieces start with text
    s[1:-1][blank[1:] & (s[1:-1] < 4)] = 1
    joins = ((c >= 0x300) & (c <= 0x36F)) | (c == 0x200D) | ((c >= 0xFE00) & (c <= 0xFE0F)) | ((c >= 0x1F3FB) & (c <= 0x1F3FF)) | ((c >= 0x20D0) & (c <= 0x20FF))
    s[:-1][joins] = 0
    s[1:][c == 0x200D] = 0
    s[1:-1][(c[:-1] == 13) & (c[1:] == 10)] = 0
    s[0] = s[n] = 5
    return s


def line_strength(content: str) -> bytes:
    """One byte per line: how strongly code pauses before it.

    1 within a block, 2 where indentation falls, 3 after a blank line, 4 after a
    blank line at top level or before a definition, 0 within a blank stretch.
    """
    out = bytearray()
    before_blank, depth = True, 0
    for line in content.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        body = line.lstrip()
        if not body:
            out.append(0 if before_blank else 1)
            before_blank = True
            continue
        indent = len(line) - len(body)
        starts = body.startswith(("def ", "class ", "function ", "async ", "export ", "@", "/**", "//", "#"))
        if before_blank:
            out.append(4 if indent == 0 or starts else 3)
        else:
            out.append(2 if indent < depth or starts else 1)
        before_blank, depth = False, indent
    return bytes(out)


def successors(strength: np.ndarray, reach: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """End of the piece that starts at each position: the farthest cut within reach among the
    strongest that fill at least half of the limit; failing that the farthest natural one that
    still advances; failing that the limit itself. A reach that is the item's last ends it."""
    pos = np.arange(len(reach))
    at = np.arange(len(strength))
    end = np.full(len(reach), -1, dtype=np.int64)
    half = pos + max(overlap + 1, limit // 2)
    for floor_, classes in ((half, (5, 4, 3, 2)), (pos + overlap + 1, (5, 4, 3, 2, 1))):
        for k in classes:
            farthest = np.maximum.accumulate(np.where(strength >= k, at, -1))[reach]
            end = np.where((end < 0) & (farthest >= floor_), farthest, end)
    end = np.where(end < 0, reach, end)
    return np.where(reach == last, last, end)


def reached(step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions that the begins reach: the table is squared and what the marked ones point to is marked."""
    marked = np.zeros(len(step), dtype=bool)
    marked[begin] = True
    while True:
        new = step[np.flatnonzero(marked)]
        new = new[~marked[new]]
        if not len(new):
            return np.flatnonzero(marked)
        marked[new] = True
        step = step[step]


def cut_flat(strength: np.ndarray, base: np.ndarray, size: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy cuts of many items at once: (item, start, end) of the pieces, in order.

    strength holds size[i]+1 cut strengths per item, starting at base[i].
    """
    item_of = np.repeat(np.arange(len(size)), size + 1)
    pos = np.arange(len(strength))
    last = base[item_of] + size[item_of]
    end = successors(strength, np.minimum(pos + limit, last), last, limit, overlap)
    step = np.where(end == last, pos, end - overlap)  # a piece that ends the item points to itself
    at = reached(step, base)
    return item_of[at], at - base[item_of[at]], end[at] - base[item_of[at]]


def _passes(sizes: np.ndarray) -> Iterator[slice]:
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > PASS_UNITS:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _cuts(items: DataFrame, strength_of, limit: int, overlap: int, text: bool = False) -> DataFrame:
    """(item_id, n, value) -> (item_id, piece, start, end[, text]) of items of up to BLOCK units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _passes(b["n"].to_numpy()):
                ids, values = b["item_id"].to_numpy()[part], b["value"].tolist()[part]
                strengths = [strength_of(v, n) for v, n in zip(values, b["n"].to_numpy()[part])]
                size = np.array([len(s) - 1 for s in strengths], dtype=np.int64)
                base = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64)
                item, start, end = cut_flat(np.concatenate(strengths), base, size, limit, overlap)
                first = np.concatenate([[True], item[1:] != item[:-1]])
                runs = np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
                out = {"item_id": ids[item], "piece": np.arange(len(item)) - runs, "start": start, "end": end}
                yield pd.DataFrame({**out, "text": [values[i][x:y] for i, x, y in zip(item, start, end)]} if text else out)

    return items.select("item_id", "n", "value").mapInPandas(run, "item_id long, piece long, start long, end long" + (", text string" if text else ""))


def _long_cuts(items: DataFrame, strength_of, limit: int, overlap: int, block: int, text: bool = False) -> DataFrame:
    """``_cuts`` of items of more than ``block`` units; the same pieces."""
    if block <= 2 * limit:
        raise ValueError("a block must be longer than two pieces")
    kind = dict(items.dtypes)["value"]
    lead = F.least(F.lit(AROUND).cast("long"), F.col("block") * block)
    blocks = items.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block)))).select(
        "item_id", "n", "block", lead.alias("lead"),
        F.col("value").substr((F.col("block") * block - lead + 1).cast("int"), F.lit(block + limit + 2 * AROUND)).alias("value"),
    )
    blocks = cut(blocks)  # each block is read twice

    def table(value, n, k, lead):
        """End and step of every position of a block, counted from its begin."""
        rest = n - k * block
        size = min(rest, block + limit)
        s = strength_of(value, min(rest + lead, block + limit + 2 * AROUND))[lead : lead + size + 1]
        pos = np.arange(min(rest, block))
        last = np.full(len(pos), rest if rest <= block + limit else -1, dtype=np.int64)
        reach = np.minimum(pos + limit, rest)
        end = successors(s, reach, last, limit, overlap)
        return end, np.where(end == rest, pos, end - overlap)

    def entries(batches):
        for b in batches:
            for r in b.itertuples():
                end, step = table(r.value, r.n, r.block, r.lead)
                room = len(step)
                f = np.concatenate([step, np.arange(room, room + limit + 1)])  # what leaves the block stays where it is
                while True:
                    g = f[f]
                    if (g == f).all():
                        break
                    f = g
                entry = np.arange(min(limit, room))
                out = f[entry]
                leaves = out >= room
                yield pd.DataFrame({"item_id": r.item_id, "at": r.block * block + entry[leaves], "to": r.block * block + out[leaves]})

    jump = cut(blocks.mapInPandas(entries, "item_id long, at long, to long"))
    known = cut(items.select("item_id", F.lit(0).cast("long").alias("at")))
    while True:
        more = known.join(jump, ["item_id", "at"]).select("item_id", F.col("to").alias("at"))
        grown = cut(known.unionByName(more).distinct())
        if grown.count() == known.count():
            break
        known = grown
        jump = cut(jump.join(jump.select("item_id", F.col("at").alias("to"), F.col("to").alias("onward")), ["item_id", "to"]).select("item_id", "at", F.col("onward").alias("to")))

    def pieces(batches):
        for b in batches:
            for r in b.itertuples():
                end, step = table(r.value, r.n, r.block, r.lead)
                room = len(step)
                begin = int(r.at - r.block * block)
                at = reached(np.where(step < room, step, np.arange(room)), np.array([begin]))
                out = {"item_id": r.item_id, "block": r.block, "start": r.block * block + at, "end": r.block * block + end[at]}
                yield pd.DataFrame({**out, "text": [r.value[r.lead + x : r.lead + y] for x, y in zip(at, end[at])]} if text else out)

    begun = known.withColumn("block", F.floor(F.col("at") / block))
    found = cut(blocks.join(begun, ["item_id", "block"]).select("item_id", "n", "block", "lead", "value", "at").mapInPandas(pieces, "item_id long, block long, start long, end long" + (", text string" if text else "")))
    # pieces are numbered by the pieces of earlier blocks and their own place in the block
    before = found.groupBy("item_id", "block").agg(F.count(F.lit(1)).alias("m"))
    before = before.withColumn("before", F.sum("m").over(Window.partitionBy("item_id").orderBy("block")) - F.col("m")).drop("m")
    place = F.row_number().over(Window.partitionBy("item_id", "block").orderBy("start")) - 1
    return found.withColumn("place", place).join(before, ["item_id", "block"]).select("item_id", (F.col("before") + F.col("place")).alias("piece"), "start", "end", *(["text"] if text else []))


def _all_cuts(items: DataFrame, strength_of, limit: int, overlap: int, block: int, text: bool = False) -> DataFrame:
    """Pieces of (item_id, n, value), each item in one row: short items by batch, long ones by block."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    out = _cuts(items.where(F.col("n") <= block), strength_of, limit, overlap, text)
    long = cut(items.where(F.col("n") > block))
    return out if long.isEmpty() else out.unionByName(_long_cuts(long, strength_of, limit, overlap, block, text))


def split_texts(texts: DataFrame, limit: int = CHARS, overlap: int = CHAR_OVERLAP, block: int = BLOCK) -> DataFrame:
    """(item_id, text) -> (item_id, piece, start, end, text) of texts above the limit.

    start and end count code points from 0, end excluded; consecutive pieces
    share exactly ``overlap`` of them and together cover the text. Null, empty
    and short texts give no rows; repeated rows give one set of pieces; of
    several texts of one id the greatest is cut.
    """
    long = texts.where(F.col("item_id").isNotNull() & (F.length("text") > limit))
    once = long.groupBy("item_id").agg(F.max("text").alias("value")).select("item_id", F.length("value").cast("long").alias("n"), "value")
    return _all_cuts(once, lambda v, n: text_strength(v), limit, overlap, block, text=True)


def split_lines(ranges: DataFrame, sources: DataFrame, limit: int = LINES, overlap: int = LINE_OVERLAP, block: int = BLOCK) -> DataFrame:
    """(item_id, file_id, low, high) -> (item_id, piece, start, end): line ranges above the limit.

    Lines are numbered as in the file, both ends counted. Sources (file_id,
    content) say where the code pauses; ranges without text, or that reach past
    its end, pause nowhere, so that their cuts are those of the limit. Null
    bounds give no rows; repeated ranges one set of pieces.
    """
    long = ranges.where(F.col("high") - F.col("low") + 1 > limit).select("item_id", "file_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")).dropDuplicates(["item_id"])

    def lines(batches):
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "pauses": [line_strength(c) for c in b["content"]]})

    held = sources.where(F.col("content").isNotNull()).select("file_id", "content").join(long.select("file_id").distinct(), "file_id", "left_semi").mapInPandas(lines, "file_id long, pauses binary").dropDuplicates(["file_id"])
    span = F.col("high") - F.col("low") + 1
    part = F.when((F.col("low") >= 1) & (F.col("high") <= F.length("pauses")), F.expr("substring(pauses, cast(low as int), cast(high - low + 1 as int))"))
    items = cut(long.join(held, "file_id", "left").select("item_id", "low", span.alias("n"), part.alias("value")))

    def strength(p: bytes | None, n: int) -> np.ndarray:
        s = np.zeros(n, dtype=np.uint8) if p is None else np.frombuffer(p, dtype=np.uint8)
        return np.concatenate([s + 1, np.array([5], dtype=np.uint8)])  # position i cuts before line i

    pieces = _all_cuts(items.select("item_id", "n", "value"), strength, limit, overlap, block)
    return pieces.join(items.select("item_id", "low"), "item_id").select("item_id", "piece", (F.col("low") + F.col("start")).alias("start"), (F.col("low") + F.col("end") - 1).alias("end"))


def oversized_pieces(symbols: DataFrame, sources: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(item_kind, item_id, piece, start, end, text): all pieces of oversized symbols and previews.

    A symbol's lines run from the smaller to the larger of its line numbers; a
    null end is no case. text is null for symbols.
    """
    ranges = symbols.where(F.col("line_start").isNotNull() & F.col("line_end").isNotNull()).select(
        F.col("id").alias("item_id"), "file_id", F.least("line_start", "line_end").cast("long").alias("low"), F.greatest("line_start", "line_end").cast("long").alias("high")
    )
    a = split_lines(ranges, sources).select(F.lit("symbol").alias("item_kind"), "item_id", "piece", "start", "end", F.lit(None).cast("string").alias("text"))
    b = split_texts(embeddings.select(F.col("id").alias("item_id"), F.col("content_preview").alias("text"))).select(F.lit("preview").alias("item_kind"), "item_id", "piece", "start", "end", "text")
    return a.unionByName(b)
