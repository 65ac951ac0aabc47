"""Periodic runs of words: Lyndon roots extended by longest common extensions on suffix trees.

A run is a stretch of words with a smallest period, repeated at least ``EXPONENT`` times, that no word beside
it goes on with. Every run begins a period at a Lyndon root: the longest Lyndon word from that place,
which ends where the next smaller suffix begins, under the order of the words or its reverse. So two
candidates per place are extended in both directions, each by one question to a suffix tree (of the words and of
their reversal) in constant time: the lowest common ancestor by a sparse table over an Euler tour.

Trees are only grown where a run can be: all words of a run occur in it at least ``EXPONENT`` times, so a
text is cut at words that do not, and the stretches left are cut again by their own counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, text_of

LEAST, EXPONENT = 6, 4


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers, closed by an end mark smaller than all.

    Nodes are numbered; edge ``v`` is text[begin[v]:end[v]] on the way into node v. ``first`` is a leaf's
    place in the Euler tour, ``rank`` a suffix's place in the sorted order.
    """

    def __init__(self, codes: list[int]):
        text = [c + 1 for c in codes] + [0]
        n = len(text)
        self.n = n
        begin, end, link, children = [0], [0], [0], [{}]
        node, edge, length, left = 0, 0, 0, 0
        for i, c in enumerate(text):
            left += 1
            last = -1
            while left:
                if not length:
                    edge = i
                at = children[node].get(text[edge])
                if at is None:
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    children.append(None)
                    children[node][text[edge]] = len(begin) - 1
                    if last >= 0:
                        link[last] = node
                        last = -1
                else:
                    size = (end[at] if end[at] <= i else i + 1) - begin[at]
                    if length >= size:
                        edge += size
                        length -= size
                        node = at
                        continue
                    if text[begin[at] + length] == c:
                        length += 1
                        if last >= 0:
                            link[last] = node
                        break
                    split = len(begin)
                    begin += (begin[at], i)
                    end += (begin[at] + length, n)
                    link += (0, 0)
                    children += ({text[begin[at] + length]: at, c: split + 1}, None)
                    children[node][text[edge]] = split
                    begin[at] += length
                    if last >= 0:
                        link[last] = split
                    last = split
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self._tour(begin, end, children)

    def _tour(self, begin: list[int], end: list[int], children: list) -> None:
        """The Euler tour's depths, in words, with children in the order of their first words."""
        n = self.n
        first, order, depths = np.zeros(n, dtype=np.int64), [], [0]
        stack = [(0, iter(sorted(children[0].items())))]
        way = [0]
        while stack:
            _, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                way.pop()
                if way:
                    depths.append(way[-1])
                continue
            child = step[1]
            depth = way[-1] + end[child] - begin[child]
            if children[child] is None:
                suffix = n - depth
                first[suffix] = len(depths)
                order.append(suffix)
                depths += (depth, way[-1])
            else:
                depths.append(depth)
                way.append(depth)
                stack.append((child, iter(sorted(children[child].items()))))
        self.first = first
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        table = [np.array(depths, dtype=np.int32)]
        while 2 << len(table) - 1 <= len(depths):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words suffixes a and b have in common, for different a and b."""
        low, high = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            mine = level == k
            row = self.table[k]
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value; the length where there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_in(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small numbers, from its suffix trees."""
    n = len(codes)
    ahead, behind = SuffixTree(codes.tolist()), SuffixTree(codes[::-1].tolist())
    places = np.arange(n)
    found: set[tuple[int, int, int]] = set()
    for rank in (ahead.rank[:n], -ahead.rank[:n]):
        after = np.array(next_smaller(rank.tolist()), dtype=np.int64)
        able = after < n
        i, j = places[able], after[able]
        right = ahead.extension(i, j)
        # A run's first root lies in its first two periods, so it goes on for all but two of them.
        again = right >= (exponent - 2) * (j - i)
        i, j, right = i[again], j[again], right[again]
        left = np.zeros(len(i), dtype=np.int64)
        inner = i > 0
        # The reversal's suffix n - i spells the words before place i backwards.
        left[inner] = behind.extension(n - i[inner], n - j[inner])
        start, length, period = i - left, j + right - i + left, j - i
        whole = length >= np.maximum(least, exponent * period)
        found.update(zip(start[whole].tolist(), length[whole].tolist(), period[whole].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, int]]:
    """Parts (begin, end) that hold all runs whole: in each of them every word is frequent."""
    todo = [(0, len(codes))]
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        part = codes[begin:end]
        _, own, counts = np.unique(part, return_inverse=True, return_counts=True)
        bad = np.flatnonzero(counts[own] < exponent)
        if not len(bad):
            yield begin, end
            continue
        edges = np.concatenate(([-1], bad, [end - begin])) + begin
        long = np.flatnonzero(np.diff(edges) - 1 >= least)
        todo += [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if len(words) < least:
        return []
    known: dict = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    out = []
    for begin, end in stretches(codes, least, exponent):
        small = np.unique(codes[begin:end], return_inverse=True)[1]
        out += [(begin + s, length, period) for s, length, period in runs_in(small, least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what any run holds after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop)[:-1] == 0
    return words if kept.all() else [w for w, k in zip(words, kept) if k]


def periodic_runs(
    docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256[, runs, collapsed])
    per document row: the longest run (ties: smallest start, then period), digests of all runs and of the
    text without repeats; the runs and that text too if ``keep_text``.

    Words are whatever stands between ASCII white space, numbered from 0. A run is at least ``least`` words and
    ``exponent`` periods long. A null text has no words; without runs the four numbers are null. Whole texts
    are worked on, one at a time; repeated rows are answered alike and no rows give none.
    """
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
        + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if keep_text else "")
    )
    names = [part.split()[0] for part in schema.split("array<")[0].split(", ")] + (["collapsed"] if keep_text else [])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = text.encode().split()
                runs = runs_of(words, least, exponent)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                short = b" ".join(collapsed(words, runs))
                row = (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2])
                row += (sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(short))
                if keep_text:
                    row += ([dict(zip(("start", "length", "period"), r)) for r in runs], short.decode())
                out.append(row)
            made = pd.DataFrame(out, columns=names[1:])
            made.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield made.astype(dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], "Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(work, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which a tenth of the texts, by a hash of the id, end in a repeated piece.

    With h the crc32 of the id as text and g = h div 10, a text of n > 0 words with h % 10 = 0 goes on from word
    a = g % n by repeating the 1 + (n - a) div (3 + g % 8) words from there. Others, and rows without an id, stay.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        g = F.expr("h div 10")
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    chosen = F.coalesce((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), F.lit(False))
    base = docs.select(F.col("doc_id"), text_of().alias("text"), h.alias("h"))
    with_words = base.withColumn("w", F.when(chosen, words))
    return with_words.select("doc_id", F.when(F.col("w").isNotNull(), repeated(F.col("w"))).otherwise(F.col("text")).alias("text"))
