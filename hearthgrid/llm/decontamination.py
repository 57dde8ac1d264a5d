"""Benchmark decontamination by pigeonhole edit matching.

An item of length L may be hit with at most e = floor(rate x L) edits. It is cut into e + 1 pieces;
an occurrence with at most e edits leaves one piece whole, so every occurrence contains an exact
piece. One automaton finds all pieces of a block of items in a text; around each hit the item is
verified with Myers' bit-parallel edit distance, where the text around the occurrence is free.
Case and white space do not count: both sides are lower-cased and words joined by one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import in_arrow, keep_rows, key_and_bytes, query, table

RATE, BLOCK_CHARS = 0.05, 4_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits`` + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Myers:
    """Least edit distance of a pattern to any stretch of a text."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(pattern):
            self.masks[c] |= 1 << k

    def least(self, text: str) -> int:
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, masks = full, 0, self.size, self.masks
        best = score
        for c in text:
            eq = masks.get(c, 0)
            diag = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | (full & ~(diag | plus)), diag & plus
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & full
            plus = (down << 1 & full) | (full & ~(diag | up))
            minus = up & diag
        return best


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.automaton, found = ahocorasick.Automaton(), defaultdict(list)
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        for k, (_, t, edits) in enumerate(self.items):
            for offset, piece in pieces_of(t, edits):
                found[piece].append((k, offset))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), tuple(where)))
        self.automaton.make_automaton()
        self.verifiers: dict[int, Myers] = {}

    def match(self, text: str) -> Iterator[tuple[int, int]]:
        """(item id, least distance) of every item that the text holds within its budget."""
        spans = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                start = end + 1 - size - offset
                _, item, edits = self.items[k]
                low, high = max(0, start - edits), min(len(text), start + len(item) + edits)
                if spans[k] and low <= spans[k][-1][1] and low >= spans[k][-1][0]:
                    spans[k][-1][1] = max(high, spans[k][-1][1])  # hits of one occurrence are verified together
                else:
                    spans[k].append([low, high])
        for k, around in spans.items():
            i, item, edits = self.items[k]
            if any(item in text[a:b] for a, b in around):
                yield i, 0
                continue
            if not edits:
                continue
            verifier = self.verifiers.setdefault(k, Myers(item))
            best = min(verifier.least(text[a:b]) for a, b in around)
            if best <= edits:
                yield i, best


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of bounded length; one block is held at a time."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter(
        "i is not null and t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        text = plain(r["t"])
        if not text:
            continue
        if held and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((r["i"], text))
        held += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Columns doc_id, item_id, distance: every item that a whole text holds within floor(rate x length) edits.

    Items are sent to the tasks in blocks of at most ``block_chars`` characters (one longer item is a
    block); each block is one pass over the texts. Null or empty texts hold nothing; items with null
    id or without words are left out; equal items count once; an item id with several texts gives
    the least distance. Repeated rows of documents give repeated rows, a null doc id stays null.
    Extra columns are not read.
    """
    rows = key_and_bytes(docs, id_col, text_col)
    schema, out = "doc_id long, item_id long, distance int", None
    for block in _item_blocks(benchmark, item_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for b in batches:
                found = []
                for i, text in zip(b["id"], b["text"]):
                    best: dict[int, int] = {}
                    for item, distance in matcher.match(plain(text.decode("utf-8", "replace"))):
                        best[item] = min(distance, best.get(item, distance))
                    found += [(i, item, d) for item, d in sorted(best.items())]
                yield {"doc_id": [f[0] for f in found], "item_id": [f[1] for f in found], "distance": [f[2] for f in found]}
        part = in_arrow(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` that hold no item within its budget, all columns kept; nothing is shuffled."""
    for block in _item_blocks(benchmark, item_col, item_text_col, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        ready: list[Matcher] = []  # one per task

        def clean(texts, sent=sent, ready=ready):
            if not ready:
                ready.append(Matcher(sent.value, rate))
            return [next(ready[0].match(plain(t.decode("utf-8", "replace"))), None) is None for t in texts]
        docs = keep_rows(docs, text_col, clean)
    return docs


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
