"""Evaluation texts that leak into training text.

A positional inverted index over the corpus is built once and stored: segments
of whole documents, each with its sorted terms (hashed words) and, per term, the
list of its positions. Every word of every document has its posting. The index
is partitioned by document, as search engines do it, so a word that stands in a
third of all documents is spread over all segments and no list is ever gathered.

A query reads the segments twice. First it counts how often each pair of
neighbouring words of the items stands in the corpus: the offset-adjusted
intersection of the two words' lists. Then it takes the RAREST pairs of every
stretch of PASSAGE words, intersects their lists, and compares the words around
each hit by position. What agrees enough on neighbouring diagonals is decided by
an alignment of the words around the hit, for many hits at once.

Why RAREST pairs suffice: a passage of n words with at most n / CHANGED changes
holds a stretch of PASSAGE words with at most three changes; each change spoils at
most two pairs, so one of any seven pairs of the stretch is whole. And such a
passage always holds one of PASSAGE words with two changes or one of 30 words with
three, so that the alignment needs no more than the words around a hit.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A passage has at least PASSAGE words, of which one in CHANGED may be changed, dropped or added.
PASSAGE, CHANGED = 20, 10
#: Changes that the alignment follows, and the pairs of a stretch that they cannot all spoil.
CHANGES = 3
RAREST = 2 * CHANGES + 1
#: Wording of at least COMMON_WORDS words that stands in COMMON_ITEMS items counts for none.
COMMON_WORDS, COMMON_ITEMS = 10, 3
#: Postings of a segment; a longer document is cut into parts that overlap by OVERLAP words, more
#: than any passage that the alignment looks at.
SEGMENT, OVERLAP = 400_000, 128
#: Unused positions between documents, so that nothing aligns across them.
GAP = 48
#: A word that a segment lacks.
ABSENT = 2**31 - 1
#: Words of items that are searched for in one pass over the index; more items take more passes.
ITEM_WORDS = 1_000_000
#: Hits and alignments that one numpy pass holds.
HITS, ALIGNED = 40_000, 2_000

INDEX = "docs array<long>, starts array<int>, sizes array<int>, terms binary, counts binary, positions binary"

_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,200}>")
_LINE_MARK = re.compile(r"^[ \t]*(?:[>|]+[ \t]*)*(?:\d{1,4}[.):|][ \t]+)?", re.M)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")


def words(text: str | None) -> list[str]:
    """Words without letter case, punctuation, markup, quote and line marks, and spacing."""
    if not text:
        return []
    t = _TAG.sub(" ", text) if "<" in text else text
    t = html.unescape(t) if "&" in t else t
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    return _WORD.findall(_LINE_MARK.sub("", t).lower().replace("’", "'").replace("'", ""))


class Terms(dict):
    """Word to 64-bit term, remembered; never 0, which stands for no word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        x = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63) or 1
        self[word] = x
        return x

    def of(self, listed: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in listed), dtype=np.int64, count=len(listed))


def _segment(docs: list[int], tokens: list[np.ndarray]) -> dict:
    """One row of the index: postings of the documents, laid out one after the other with gaps."""
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + GAP)[:-1]]) + GAP
    flat = np.concatenate(tokens)
    at = np.arange(len(flat)) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    terms, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    positions = at[np.argsort(inverse, kind="stable")].astype(np.int32)
    return {"docs": docs, "starts": starts.astype(np.int32), "sizes": sizes.astype(np.int32), "terms": terms.tobytes(), "counts": counts.astype(np.int32).tobytes(), "positions": positions.tobytes()}


def build_index(documents: DataFrame, segment: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """INDEX rows of (doc_id, text): every word of every document; null and wordless texts are left out.

    Rows hold about ``segment`` postings each. The result may be written as a table
    and searched later, with other items.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, docs, held, n = Terms(), [], [], 0
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                x = terms.of(words(t))
                for lo in range(0, max(1, len(x) - overlap), segment - overlap):
                    part = x[lo : lo + segment]
                    if not len(part):
                        continue
                    if n and n + len(part) > segment:
                        yield pd.DataFrame([_segment(docs, held)])
                        docs, held, n = [], [], 0
                    docs.append(d)
                    held.append(part)
                    n += len(part)
        if docs:
            yield pd.DataFrame([_segment(docs, held)])

    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, INDEX)


class Segment:
    """A row of the index with its posting lists."""

    def __init__(self, row):
        self.docs, self.starts, self.sizes = np.asarray(row.docs, dtype=np.int64), np.asarray(row.starts), np.asarray(row.sizes)
        self.terms, counts = np.frombuffer(row.terms, dtype=np.int64), np.frombuffer(row.counts, dtype=np.int32)
        self.positions = np.frombuffer(row.positions, dtype=np.int32)
        self.ends = np.cumsum(counts)
        # which term holds a position: the lists, read the other way round
        self.at = np.full(int(self.starts[-1] + self.sizes[-1]) + GAP, -1, dtype=np.int32)
        self.at[self.positions] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term in this segment; ABSENT where it has no posting."""
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, ABSENT).astype(np.int32)

    def postings(self, i: int) -> np.ndarray:
        return self.positions[self.ends[i - 1] if i else 0 : self.ends[i]]

    def both(self, a: int, b: int) -> np.ndarray:
        """Positions of a that b follows: the shorter list, its offset adjusted, against the other."""
        if a == ABSENT or b == ABSENT:
            return self.positions[:0]
        x, y = self.postings(a), self.postings(b)
        return x[self.at[x + 1] == b] if len(x) <= len(y) else y[self.at[y - 1] == a] - 1


class Items:
    """Words of a block of items, one after the other with gaps."""

    def __init__(self, rows: list):
        terms, gap = Terms(), np.zeros(GAP, dtype=np.int64)
        flat, own, of, names = [gap], [gap.astype(bool)], [gap - 1], []
        for k, r in enumerate(rows):
            x = terms.of(list(r["w"]))
            names.append(r["instance_id"])
            flat += [x, gap]
            own += [~np.asarray(r["common"], dtype=bool), gap.astype(bool)]
            of += [np.full(len(x), k), gap - 1]
        self.names, self.terms, self.own, self.of = names, np.concatenate(flat), np.concatenate(own), np.concatenate(of)
        self.pair_at = np.flatnonzero(self.own[:-1] & self.own[1:])
        key = np.stack([self.terms[self.pair_at], self.terms[self.pair_at + 1]], axis=1)
        self.pairs, self.pair_of = np.unique(key, axis=0, return_inverse=True) if len(key) else (key, np.zeros(0, dtype=np.int64))
        self.pair_of = self.pair_of.reshape(-1)

    def seeds(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pair) of the RAREST pairs of every stretch of PASSAGE own words."""
        never = np.iinfo(np.int64).max
        cost = np.full(len(self.terms), never, dtype=np.int64)
        cost[self.pair_at] = count[self.pair_of]
        if len(cost) < PASSAGE:
            return self.pair_at[:0], self.pair_of[:0]
        stretch = np.lib.stride_tricks.sliding_window_view(cost, PASSAGE - 1)
        whole = np.flatnonzero((stretch < never).all(axis=1))
        chosen = np.zeros(len(cost), dtype=bool)
        for lo in range(0, len(whole), HITS):
            part = whole[lo : lo + HITS]
            best = np.argsort(stretch[part], axis=1, kind="stable")[:, :RAREST]
            chosen[(part[:, None] + best).reshape(-1)] = True
        keep = chosen[self.pair_at]
        return self.pair_at[keep], self.pair_of[keep]


def item_words(items: DataFrame) -> DataFrame:
    """(instance_id, w, common): words of each statement and, per position, whether the wording is common to items.

    Repeated rows count once; null statements and those of fewer than PASSAGE
    words are left out after the common wording is found.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"instance_id": b["instance_id"], "w": [words(t) for t in b["problem_statement"]]})

    once = items.where(F.col("problem_statement").isNotNull() & F.col("instance_id").isNotNull()).select("instance_id", "problem_statement").distinct()
    tokens = cut(once.mapInPandas(run, "instance_id string, w array<string>").where(F.size("w") > 0))
    at = F.sequence(F.lit(1), F.size("w") - COMMON_WORDS + 1)
    long = tokens.where(F.size("w") >= COMMON_WORDS).select("instance_id", F.posexplode(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, COMMON_WORDS)))).alias("at", "term"))
    shared = long.groupBy("term").agg(F.countDistinct("instance_id").alias("n")).where(F.col("n") >= COMMON_ITEMS).select("term")
    covered = long.join(shared, "term", "left_semi").groupBy("instance_id").agg(F.collect_set("at").alias("starts"))
    return tokens.where(F.size("w") >= PASSAGE).join(covered, "instance_id", "left").select(
        "instance_id", "w",
        F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.exists(F.coalesce("starts", F.array().cast("array<int>")), lambda s: (s <= i) & (i < s + COMMON_WORDS))).alias("common"),
    )


def alike(seg: Segment, local: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the words around item position p and segment position t agree in all but CHANGES of some
    PASSAGE consecutive ones, each looked for on the diagonals up to CHANGES away."""
    reach = PASSAGE - 1
    q = local[p[:, None] + np.arange(-reach, reach + 1)]
    d = seg.at[np.clip(t[:, None] + np.arange(-reach - CHANGES, reach + CHANGES + 1), 0, len(seg.at) - 1)]
    same = np.zeros(q.shape, dtype=bool)
    for shift in range(2 * CHANGES + 1):
        same |= q == d[:, shift : shift + q.shape[1]]
    n = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    return (n[:, PASSAGE:] - n[:, :-PASSAGE]).max(axis=1) >= PASSAGE - CHANGES


def aligned(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Per row, whether d holds a passage of q: at least PASSAGE words of q of which at most one in
    CHANGED, and CHANGES in all, are changed, dropped or added; first and last word equal. Negative
    words of q equal nothing and end a passage.

    far[e][:, j]: words of the longest stretch of q that begins with an equal word, has e changes
    and ends with word j of d.
    """
    none = np.int16(-10_000)
    n, width = d.shape
    far = [np.full((n, width + 1), none, dtype=np.int16) for _ in range(CHANGES + 1)]
    found = np.zeros(n, dtype=bool)
    for x in q.T:
        same, over = x[:, None] == d, x < 0
        now = []
        for e in range(CHANGES + 1):
            best = np.where(same, (np.maximum(far[0][:, :-1], 0) if e == 0 else far[e][:, :-1]) + np.int16(1), none)
            found |= best.max(axis=1) >= max(PASSAGE, CHANGED * e)
            if e:
                np.maximum(best, far[e - 1][:, :-1] + np.int16(1), out=best)  # changed
                np.maximum(best, far[e - 1][:, 1:] + np.int16(1), out=best)  # dropped
                np.maximum(best, now[e - 1][:, :-1], out=best)  # added
            best[over] = none
            now.append(np.concatenate([np.full((n, 1), none, dtype=np.int16), best], axis=1))
        far = now
    return found


def search(seg: Segment, items: Items, seeds: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, str]]:
    """(doc_id, instance_id) of the passages in a segment."""
    at, pair = seeds
    local = np.where(items.own, seg.local(items.terms), -3).astype(np.int32)
    order = np.argsort(pair, kind="stable")
    at, pair = at[order], pair[order]
    a, b = local[at], local[at + 1]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
    ends = np.append(first[1:], len(pair))
    ps, ts, n = [], [], 0
    near: list[tuple[np.ndarray, np.ndarray]] = []

    def sift():
        p, t = np.concatenate(ps), np.concatenate(ts)
        for lo in range(0, len(p), HITS):
            ok = alike(seg, local, p[lo : lo + HITS], t[lo : lo + HITS])
            near.append((p[lo : lo + HITS][ok], t[lo : lo + HITS][ok]))

    for lo, hi in zip(first, ends):
        hit = seg.both(int(a[lo]), int(b[lo]))
        if len(hit):
            ps.append(np.repeat(at[lo:hi], len(hit)))
            ts.append(np.tile(hit, hi - lo))
            n += len(hit) * (hi - lo)
            if n > 8 * HITS:
                sift()
                ps, ts, n = [], [], 0
    if n:
        sift()
    if not near:
        return
    p, t = np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near]).astype(np.int64)
    doc, item = np.searchsorted(seg.starts, t, side="right") - 1, items.of[p]
    order = np.lexsort((p, item, doc))
    p, t, doc, item = p[order], t[order], doc[order], item[order]
    done: set[tuple[int, int]] = set()
    q_reach, d_reach = CHANGED * CHANGES + 2, CHANGED * CHANGES + 2 + CHANGES
    # one hit of each document and item first; the others only where that one does not decide
    while len(p):
        lead = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        k = np.flatnonzero(lead)
        for lo in range(0, len(k), ALIGNED):
            i = k[lo : lo + ALIGNED]
            q = p[i][:, None] + np.arange(-q_reach, q_reach + 1)
            d = t[i][:, None] + np.arange(-d_reach, d_reach + 1)
            begin = seg.starts[doc[i]].astype(np.int64)
            inside = (d >= begin[:, None]) & (d < (begin + seg.sizes[doc[i]])[:, None])
            dw = np.where(inside, seg.at[np.clip(d, 0, len(seg.at) - 1)], -1)
            qc = np.clip(q, 0, len(local) - 1)
            qw = np.where((items.of[qc] == item[i][:, None]) & (q == qc), local[qc], -3)
            found = aligned(qw, dw)
            done |= {(int(x), int(y)) for x, y in zip(doc[i][found], item[i][found])}
        rest = ~lead
        p, t, doc, item = p[rest], t[rest], doc[rest], item[rest]
        if len(p) and done:
            keep = np.fromiter(((int(x), int(y)) not in done for x, y in zip(doc, item)), dtype=bool, count=len(p))
            p, t, doc, item = p[keep], t[keep], doc[keep], item[keep]
    for x, y in done:
        yield int(seg.docs[x]), items.names[y]


def leaked(documents: DataFrame, items: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, instance_id) of documents that hold a passage of an item's statement.

    ``index`` is a stored index of the documents; without one it is built and
    stored in the shared folder. Null and empty texts and statements of fewer
    than PASSAGE words have no rows; repeated rows count once; every copy of a
    text is reported.
    """
    spark = documents.sparkSession
    index = cut(build_index(documents)) if index is None else index
    own = cut(item_words(items))
    blocks = max(1, -(-(own.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0) // ITEM_WORDS))
    out = None
    for k in range(blocks):
        # a block of items is bounded by ITEM_WORDS words on average, whatever the number of items
        rows = own.where(F.pmod(F.xxhash64("instance_id"), F.lit(blocks)) == k).collect()
        block = Items(rows)
        shared = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pairs = shared.value.pairs
            total = np.zeros(len(pairs), dtype=np.int64)
            for b in batches:
                for row in b.itertuples():
                    seg = Segment(row)
                    x, y = seg.local(pairs[:, 0]), seg.local(pairs[:, 1])
                    for i in np.flatnonzero((x != ABSENT) & (y != ABSENT)):
                        total[i] += len(seg.both(int(x[i]), int(y[i])))
            i = np.flatnonzero(total)
            yield pd.DataFrame({"pair": i, "n": total[i]})

        n = np.zeros(len(block.pairs), dtype=np.int64)
        if len(n):
            for r in index.mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most one row per pair of the block
                n[r["pair"]] = r["n"]
        seeds = spark.sparkContext.broadcast(block.seeds(n))

        def find(batches: Iterator[pd.DataFrame], shared=shared, seeds=seeds) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.itertuples():
                    yield pd.DataFrame(list(search(Segment(row), shared.value, seeds.value)), columns=["doc_id", "instance_id"])

        part = index.mapInPandas(find, "doc_id long, instance_id string")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
