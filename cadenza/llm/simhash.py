"""SimHash near-duplicate detection with BK-trees in pigeonhole shards.

Fingerprints: 64 bits by majority over the XXH64 of all word shingles of the whole text. Two
fingerprints link if they differ in at most two bits.

Search: the 64 bits fall into four blocks of 16. Two fingerprints that differ in at most two bits
agree on at least two whole blocks, so each distinct fingerprint goes to six shards, one for each
pair of blocks, keyed by the 32 bits of that pair. Within a shard a BK-tree (children keyed by
their Hamming distance to the parent) is queried along the edges within the radius only. The
trees' members grow with the corpus, so shards travel by a shuffle on their key and no tree is
broadcast. A shard with more than ``SHARD_LIMIT`` fingerprints is dealt out again by parts of its
remaining 32 bits, which keeps each tree small and loses nothing.

``similar`` and ``keep_one`` are the form for near copies: five-word shingles, a similarity of 0.8, a
wide radius and an exact check (``shingles``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import shingles
from cadenza.llm.arrowtext import slices
from cadenza.llm.graph import connected_components
from cadenza.llm.workspace import Workspace

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in one tree; larger shards are dealt out again.
SHARD_LIMIT = 20_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed before their bits are summed: bounds memory on very long texts.
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text.

    A-Z become lower case; words are runs without space or \\t\\n\\v\\f\\r; shingles are ``shingle``
    successive words joined by a space, repeats included. Fewer words make one shingle; no word
    gives zero.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; null counts as empty."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(x or b"", shingle) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return source.mapInArrow(run, "id long, fp long")


class BKTree:
    """Integers under Hamming distance; a child hangs on the edge that is its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert a value that is not in the tree; its node number."""
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while node:
            distance = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = node
                break
            at = child
        return node

    def within(self, value: int, radius: int) -> list[int]:
        """Node numbers of all values at most ``radius`` away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            below = self.children[at]
            if below:
                stack.extend(child for edge, child in below.items() if distance - radius <= edge <= distance + radius)
        return found


def _link(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its group) for values that links within one shard join."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):  # ascending, so that roots are the smallest
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _shard_edges(shards: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """shards(shard, fp) → (shard, a, b): links as (fp, group's fp); b is null for members of a shard over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

        def done(key: int, fps: list[np.ndarray]) -> pa.RecordBatch | None:
            values = np.concatenate(fps)
            if len(values) < 2:
                return None
            if limit is not None and len(values) > limit:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key)), pa.array(values), pa.nulls(len(values), pa.int64())], schema=schema)
            links = _link(values.view(np.uint64).tolist(), radius)
            if not links:
                return None
            ends = np.array(links, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(links), key)), pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], schema=schema)

        key, held = None, []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if s == e:
                    continue
                if held and keys[s] != key:
                    if len(held) > 1 or len(held[0]) > 1:
                        out = done(key, held)
                        if out is not None:
                            yield out
                    held = []
                key = int(keys[s])
                held.append(fps[s:e])
        if held and (out := done(key, held)) is not None:
            yield out

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(parts, "shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "shard long, a long, b long")


def link_fingerprints(ws: Workspace, fps: DataFrame, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b) over the distinct longs ``fp``: edges that connect exactly what links within the radius connect."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks taken in pairs serve radii up to 2")
    block = lambda i: F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = list(combinations(range(4), 2))
    # the pair's number is hashed in with its 32 bits, so a shard is named by one long without ambiguity
    keys = [F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for n, (i, j) in enumerate(pairs)]
    links = ws.save(_shard_edges(fps.select(F.explode(F.array(*keys)).alias("shard"), "fp"), radius, limit), "links")
    large = links.where("b is null")
    if not large.isEmpty():
        rest = F.lit(None).cast("long")
        for n, pair in enumerate(pairs):
            i, j = sorted(set(range(4)) - set(pair))
            rest = F.when(F.shiftright("shard", 32) == n, F.shiftleft(block(i), 16).bitwiseOR(block(j))).otherwise(rest)
        split = large.select("shard", F.col("a").alias("fp")).withColumn("rest", rest)
        thirds = [(0, 0x7FF), (11, 0x7FF), (22, 0x3FF)]  # two differing bits leave one of three parts whole
        parts = [F.xxhash64("shard", F.lit(n), F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit(mask))) for n, (shift, mask) in enumerate(thirds)]
        # a 64-bit name may be shared by chance; that only puts more fingerprints into one exact search
        finer = _shard_edges(split.select("fp", F.explode(F.array(*parts)).alias("shard")).select("shard", "fp").distinct(), radius, None)
        links = links.where("b is not null").unionByName(ws.save(finer, "links-finer"))
    return links.select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """(id_col, fp long, component_id): one row per row of ``docs``.

    component_id is the smallest id reachable over links, the row's own included. Nulls: a null text
    is an empty one (fingerprint zero, linked like any other); ids are integers, and null ids keep their
    row but never name a component unless nothing else does. Texts are whole, however long, hashed in
    stretches. Repeated rows and ties stay; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.save(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = ws.save(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    return group(ws, prints, link_fingerprints(ws, distinct.select("fp"), radius, limit), id_col, distinct)


def group(ws: Workspace, prints: DataFrame, edges: DataFrame, id_col: str, distinct: DataFrame | None = None) -> DataFrame:
    """(id_col, fp, component_id) of prints(id, fp) and the edges between their fp."""
    if distinct is None:
        distinct = ws.save(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    groups = connected_components(ws, edges).select(F.col("node").alias("fp"), "component")
    named = distinct.join(groups, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = ws.save(named, "named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingles.WORDS, block: int = shingles.BLOCK) -> DataFrame:
    """(id_col, fp long, component_id) as ``near_duplicates``, linked by a Jaccard similarity of 0.8 of word shingles.

    SimHash and BK-trees find the candidates and an exact comparison decides; see ``shingles``. ``fp``
    names the set of shingles; null texts and texts without words have the empty set, zero, and link
    with each other. Texts are whole, however long; repeated rows and ties stay; null ids keep their
    row as in ``near_duplicates``; an empty table gives an empty result; other columns are ignored.
    """
    ws, prints, edges = shingles.find(docs, id_col, text_col, words, block)
    return group(ws, prints, edges, id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = shingles.WORDS) -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their group of ``similar`` texts.

    Rows that share id and text collapse into one. Rows without id stay only where no row of their
    group has one; of those, equal texts collapse.
    """
    return keep_first(docs, similar(docs, id_col, text_col, words), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``keep_one`` of the groups in found(id_col, component_id)."""
    ws = Workspace(docs.sparkSession, "simhash-kept")
    first = ws.save(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col), "first")
    total, distinct = first.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce(F.col(id_col), F.lit(-1)))).first()
    left, right = docs.alias("left"), first.distinct().hint("merge").alias("right")
    kept = left.join(right, F.col(f"left.{id_col}").eqNullSafe(F.col(f"right.{id_col}")), "left_semi")
    return kept if total == distinct else kept.dropDuplicates([id_col, text_col])
