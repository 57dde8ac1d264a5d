"""Periodic runs of words: suffix trees of a text and of its reversal, and extension of Lyndon roots.

A run is a stretch that repeats with a period and cannot be extended. Every run holds a Lyndon root of one
of two orders of the words (ascending, descending), so the longest Lyndon words at all
positions are all candidates there are. How far a candidate repeats forwards and backwards are two
longest common extensions, each the depth of a lowest common ancestor in a suffix tree: an Euler
tour and a table of range minima answer it in constant time, for all candidates at once.

Trees are built only where a text repeats itself. In a run of at least ``least`` words and three periods,
every word lies in a 16-word window that occurs again inside the run; so stretches covered by windows
that occur again within the same stretch hold all runs, and neither hashes nor stretches lose one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, give_back, in_arrow, key_and_bytes, mixed, query, table, windowed

LEAST, POWER = 24, 3


class SuffixTree:
    """Ukkonen's tree of a sequence of ranks 1.. (0 closes it), with longest common extensions.

    Edges hang in one dictionary by (node, first rank). Node 0 is the root.
    """

    def __init__(self, ranks: np.ndarray):
        self.text = text = [*ranks.tolist(), 0]
        self.span = span = int(ranks.max(initial=0)) + 1
        end = len(text)
        begin, close, link = [0], [0], [0]  # an edge is text[begin:close]; leaves are open to the end
        edges: dict[int, int] = {}
        node = length = edge = rest = 0
        for at, c in enumerate(text):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = at
                slot = node * span + text[edge]
                child = edges.get(slot)
                if child is None:
                    edges[slot] = len(begin)
                    begin.append(at)
                    close.append(end)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    start = begin[child]
                    size = min(close[child], at + 1) - start
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if text[start + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(begin)
                    begin += (start, at)
                    close += (start + length, end)
                    link += (0, 0)
                    edges[slot] = split
                    edges[split * span + c] = split + 1
                    begin[child] = start + length
                    edges[split * span + text[start + length]] = child
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - rest + 1
        self.begin, self.close = begin, close
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        kids = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.kids, self.first = kids[order].tolist(), np.searchsorted(keys[order] // span, np.arange(len(begin) + 1)).tolist()
        self._tour()

    def _tour(self) -> None:
        """Euler tour: at every visit the depth in words of the node; leaves take the rank order of their suffixes."""
        begin, close, kids, first, n = self.begin, self.close, self.kids, self.first, len(self.text)
        depth = [0] * len(begin)
        seen, leaf_at, leaves, stack = [], [0] * n, [], [(0, first[0])]
        while stack:
            node, next_ = stack.pop()
            d = depth[node]
            if next_ == first[node] == first[node + 1]:
                leaf_at[n - d] = len(seen)
                leaves.append(n - d)
                seen.append(d)
                continue
            seen.append(d)
            if next_ < first[node + 1]:
                child = kids[next_]
                stack.append((node, next_ + 1))
                depth[child] = d + close[child] - begin[child]
                stack.append((child, first[child]))
        self.leaves, self.leaf_at = np.array(leaves), np.array(leaf_at)
        low = [np.array(seen, dtype=np.int32)]
        while 2 ** len(low) <= len(seen):
            half = 2 ** (len(low) - 1)
            low.append(np.minimum(low[-1][:-half], low[-1][half:]))
        self.low = low

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (different) share: depth of the lowest common ancestor."""
        a, b = self.leaf_at[i], self.leaf_at[j]
        a, b = np.minimum(a, b), np.maximum(a, b) + 1
        level = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.low[k][a[at]], self.low[k][b[at] - 2 ** int(k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position: the way to the next smaller suffix."""
    values, n = rank.tolist(), len(rank)
    out, stack = [0] * n, []
    for i in range(n - 1, -1, -1):
        while stack and values[stack[-1]] > values[i]:
            stack.pop()
        out[i] = (stack[-1] if stack else n) - i
        stack.append(i)
    return np.array(out, dtype=np.int64)


def maximal_runs(words: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of at least ``least`` words and ``power`` (2 or more) periods, by start, then period."""
    n = len(words)
    if n < 2:
        return []
    _, ranks = np.unique(words, return_inverse=True)
    ranks = ranks.astype(np.int64) + 1
    tree, back = SuffixTree(ranks), SuffixTree(ranks[::-1])
    found = set()
    # the second order turns the words around, but a suffix still precedes its extensions
    turned = SuffixTree(ranks.max() + 1 - ranks)
    for leaves in (tree.leaves, turned.leaves):
        rank = np.empty(n + 1, dtype=np.int64)
        rank[leaves] = np.arange(n + 1)
        i = np.arange(n)
        period = lyndon_lengths(rank[:n])
        j = i + period
        ahead = np.where(j < n, tree.common(i, np.where(j < n, j, n)), 0)
        # the words before i and j, read backwards
        p, q = n - i, n - j
        behind = np.where(i > 0, back.common(np.where(i > 0, p, n), np.where(i > 0, q, 0)), 0)
        start, length = i - behind, behind + period + ahead
        good = (length >= power * period) & (length >= least)
        found |= set(zip(start[good].tolist(), length[good].tolist(), period[good].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating_stretches(hashes: np.ndarray, owner: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, end) of stretches of one owner that are covered by windows occurring twice in the stretch."""
    grams = windowed(hashes, width)
    whole = owner[:len(grams)] == owner[width - 1:]
    at = np.nonzero(whole)[0]
    key = mixed(grams[at] + mixed(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.nonzero(key[order[1:]] == key[order[:-1]])[0]
    left, right = at[order[same]], at[order[same + 1]]  # a window and its next occurrence
    while True:
        cover = np.zeros(len(hashes) + 1, dtype=np.int32)
        for side in (left, right):
            one = np.unique(side)
            np.add.at(cover, one, 1)
            np.add.at(cover, one + width, -1)
        covered = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.r_[False, covered, False].astype(np.int8))
        # two documents that touch are two stretches
        cut = np.zeros(len(hashes), dtype=bool)
        cut[1:] = covered[1:] & covered[:-1] & (owner[1:] != owner[:-1])
        starts, ends = np.sort(np.r_[np.nonzero(edge == 1)[0], np.nonzero(cut)[0]]), np.sort(np.r_[np.nonzero(edge == -1)[0], np.nonzero(cut)[0]])
        stretch = np.searchsorted(starts, left, side="right") == np.searchsorted(starts, right, side="right")
        if stretch.all():
            return list(zip(starts.tolist(), ends.tolist()))
        left, right = left[stretch], right[stretch]


def _summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The row of a document: number of runs, the one with the greatest exponent, digests, words kept."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    best = None
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    kept = b" ".join(words) if best is None else b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g)
    start, length, period = best or (None, None, None)
    return len(runs), start, length, period, best and 1000 * length // period, listed, kept


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers after planting a period into the tail of every tenth document (by crc32 of its id), or None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER, change=None) -> DataFrame:
    """Columns id, n_runs, start, length, period, exponent_milli (of the run with the greatest exponent), runs
    (array of start, length, period), runs_sha256, kept (bytes: the words without repeats of a period, joined by one space).

    Words are what ASCII white space separates, compared byte by byte; they are numbered from 0. A null or
    empty text has no words and no run: its four columns are null. Ties go to the smallest start, then the
    smallest period. One row per input row; ids may repeat or be null. An empty table gives an empty
    result; other columns are not read. Text of any length is handled whole; memory follows the
    longest stretch of a text that repeats itself, about 2 KB a word. ``least`` >= 24 and ``power`` >= 3.
    ``change(id, n)``, if given, may return word numbers to put in place of 0..n-1.
    """
    if least < 24 or power < 3:
        raise ValueError("the windows that find repeating stretches need least >= 24 and power >= 3")
    width = 2 * least // 3  # words of a run that occur again, at least

    def run(batches):
        hashed = WordHashes()
        for b in batches:
            words, hashes = [], []
            for i, text in zip(b["id"], b["text"]):
                w = text.split()
                h = hashed.of(w)
                at = change(i, len(w)) if change else None
                if at is not None:
                    w, h = [w[k] for k in at.tolist()], h[at]
                words.append(w)
                hashes.append(h)
            sizes = np.array([len(w) for w in words])
            owner, base = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
            found: list[list] = [[] for _ in words]
            for start, end in repeating_stretches(np.concatenate(hashes), owner, width):
                if end - start >= least:
                    d = int(owner[start])
                    off = start - int(base[d])
                    names: dict[bytes, int] = {}
                    ranks = np.array([names.setdefault(w, len(names)) for w in words[d][off:off + end - start]])
                    found[d] += [(off + s, n, p) for s, n, p in maximal_runs(ranks, least, power)]
            rows = [_summary(w, r) for w, r in zip(words, found)]
            out = dict(zip(("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "kept"), map(list, zip(*rows))))
            yield out | {"id": b["id"], "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]}
        give_back()

    return in_arrow(key_and_bytes(docs, id_col, text_col), run, "id long, n_runs long, start long, length long, period long, exponent_milli long, "
                    "runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, kept binary")


@query("op11_periodic_runs", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
                 lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295) AS h FROM documents),
sized AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h % 10 = 0 AND len(w) > 0 AS plant, h // 10 AS g FROM d),
cut AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
step AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
number AS (SELECT doc_id, n, w, CASE WHEN plant THEN a END AS a, p, unnest(range(n)) AS i FROM step),
word AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM number),
gram AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS t FROM word),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.t = y.t AND y.i > x.i
         WHERE 3 * (y.i - x.i) <= x.n AND y.i + 16 <= y.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 16 + q AS len FROM isle GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len),
best AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM run GROUP BY doc_id),
top AS (SELECT doc_id, s, len, q, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) AS k FROM run),
drops AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT word.doc_id, sha256(coalesce(string_agg(word, ' ' ORDER BY word.i) FILTER (drops.i IS NULL), '')) AS c
         FROM word LEFT JOIN drops ON drops.doc_id = word.doc_id AND drops.i = word.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * len // q AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(c, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id AND top.k = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id
""")
def op11(spark, sf_dir):
    found = periodic_runs(table(spark, sf_dir, "documents"), change=planted)
    return found.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                        F.sha2("kept", 256).alias("collapsed_sha256"))
