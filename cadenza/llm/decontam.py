"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with single spaces. An item of n characters may differ
from a passage by k = floor(rate * n) edits. Of k + 1 pieces of the item, k edits leave one whole,
so every such passage holds an exact piece; an Aho-Corasick automaton finds all pieces of all items
in one walk over the text. Each hit fixes where the passage must lie to within k characters, and
Myers' bit-parallel algorithm computes the least edit distance there.

Items travel in automata of at most ``ITEM_CHARS`` characters; a larger benchmark takes more passes.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.arrowtext import held, slices, texts_of
from cadenza.llm.workspace import Workspace

RATE = 0.05
ITEM_CHARS = 4_000_000
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("distance", T.LongType())])
_MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())])


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length that make up the text."""
    bounds = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(s, text[s:e]) for s, e in zip(bounds, bounds[1:], strict=False) if e > s]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, end of the first such stretch)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, math.floor(rate * len(t))) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, distance) of passages in normalised text, one for each item and place."""
        if not self.items or not text:
            return []
        tried: dict[tuple[int, int], None] = {}
        for end, (length, places) in self.automaton.iter(text):
            at = end - length + 1
            for n, offset in places:
                tried.setdefault((n, at - offset))
        found: list[tuple[int, int, int, int]] = []
        placed: dict[int, list[int]] = {}  # of each item the diagonals of its passages, in order
        for n, diagonal in tried:
            item, pattern, budget = self.items[n]
            # passages around diagonals within the budget of each other are the same passage
            known = placed.setdefault(n, [])
            near = bisect_left(known, diagonal - budget)
            if near < len(known) and known[near] <= diagonal + budget:
                continue
            low = max(0, diagonal - budget)
            window = text[low : max(0, diagonal) + len(pattern) + 2 * budget]
            distance, end = (0, diagonal - low + len(pattern)) if text.startswith(pattern, max(diagonal, 0)) and diagonal >= 0 else myers(pattern, window)
            if distance <= budget:
                back, length = myers(pattern[::-1], window[:end][::-1])
                found.append((item, low + end - length, low + end, distance))
                insort(known, diagonal)
        return sorted(found, key=lambda m: (m[0] is not None, m[0] or 0, *m[1:]))


def find(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_chars: int = ITEM_CHARS) -> DataFrame:
    """The rows of ``docs`` with ``matches``: array<item_id, start, end, distance> (a column of that name is replaced).

    Positions count characters of the normalised text. Null and empty texts and items match nothing;
    an item too short for an edit must occur exactly; texts are whole, however long, and an item that
    a text repeats matches at each place; of passages that tie the first counts; repeated rows and items
    stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.drop("matches")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    size = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-size // item_chars))
    part = lambda number: wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).collect()  # noqa: E731 about ``item_chars`` characters
    share = lambda rows: spark.sparkContext.broadcast([(r["item"], normal(r["text"])) for r in rows])
    if passes == 1:
        return _matched(source, share(part(0)), rate, text_col)
    # rows get a number once; the passes bring back numbers and matches only, and one join puts them together
    ws, row = Workspace(spark, "decontaminate"), "_row"
    while row in source.columns:
        row += "_"
    numbered = ws.save(source.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = [ws.save(_matched(texts, share(part(n)), rate, "text").where(F.size("matches") > 0).select("row", "matches"), f"pass-{n}") for n in range(passes)]
    merged = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    none = F.array().cast(T.ArrayType(MATCH))
    return numbered.join(merged.withColumnRenamed("row", row), row, "left").select(*source.columns, F.coalesce("matches", none).alias("matches"))


def _matched(docs: DataFrame, shared: Broadcast, rate: float, text_col: str) -> DataFrame:
    key, names = uuid.uuid4().hex, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held(key, lambda: Matcher(shared.value, rate))
        for batch in slices(batches, text_col):
            found = [[dict(zip(("item_id", "start", "end", "distance"), m, strict=True)) for m in matcher.matches(normal(text))] for text in texts_of(batch, text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_MATCH))], [*names, "matches"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(MATCH))]))
