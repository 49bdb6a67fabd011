"""Best-fit packing of tokenised documents by a plan over the histogram of piece lengths.

Lengths are integers up to the capacity, so how many pieces have each length says all that packing
needs. One pass over the documents tokenises and cuts them; the plan is made on the driver from at
most ``capacity`` counts, whatever the corpus size; then each piece finds its place from its length
and its rank among pieces of that length. No piece list reaches the driver or a single task.

Plan: pieces above a third of the capacity go at most two to a sequence, matched greedily (the
longest with the longest that still fits beside it). Shorter pieces follow in descending order into
the tightest gap that holds them; what fits nowhere opens new sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm import bpe
from cadenza.llm.arrowtext import slices, texts_of
from cadenza.llm.workspace import Workspace

CAPACITY = 2048
END_ID = 0
#: Bytes of text encoded at once: less than elsewhere, as the pipeline's executors hold more beside it.
_SLICE = 1 << 20


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks [first, last): ``per_bin`` to a sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    last: int
    sequence: int
    per_bin: int
    offset: int


class _Plan:
    """Sequences in runs of equal filling: gap → [(first sequence, how many)]."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {n: c for n, c in counts.items() if c}
        self.rank: dict[int, int] = defaultdict(int)
        self.slots: list[Slot] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.gaps: list[int] = []
        self.sequences = 0

    def _free(self, gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if not self.runs[gap]:
                insort(self.gaps, gap)
            self.runs[gap].append((first, bins))

    def _take(self, length: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        at = self.rank[length]
        self.slots.append(Slot(length, at, at + n, first_bin, per_bin, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def _fill(self, length: int, n: int, first: int, bins: int, gap: int) -> int:
        """Place up to n pieces into a run of bins with this gap; returns how many were placed."""
        per_bin = gap // length
        full = min(n // per_bin, bins)
        offset = self.capacity - gap
        placed = full * per_bin
        if full:
            self._take(length, placed, first, per_bin, offset)
            self._free(gap - per_bin * length, first, full)
        rest = min(n - placed, per_bin) if full < bins else 0
        if rest:
            self._take(length, rest, first + full, rest, offset)
            self._free(gap - rest * length, first + full, 1)
        used = full + bool(rest)
        self._free(gap, first + used, bins - used)
        return placed + rest

    def match_large(self) -> None:
        third = self.capacity // 3
        lengths = sorted(n for n in self.left if n > third)
        while lengths:
            long = lengths[-1]
            if long not in self.left:
                lengths.pop()
                continue
            at = bisect_left(lengths, self.capacity - long + 1) - 1
            while at >= 0 and lengths[at] not in self.left:
                lengths.pop(at)
                at -= 1
            if at < 0 or (lengths[at] == long and self.left[long] == 1):
                n = self.left[long] if at < 0 else 1
                first = self._open(n)
                self._take(long, n, first, 1, 0)
                self._free(self.capacity - long, first, n)
                continue
            short = lengths[at]
            bins = self.left[long] // 2 if short == long else min(self.left[long], self.left[short])
            first = self._open(bins)
            self._take(long, bins, first, 1, 0)
            self._take(short, bins, first, 1, long)
            self._free(self.capacity - long - short, first, bins)

    def fit_small(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    bins = -(-n // (self.capacity // length))
                    self._fill(length, n, self._open(bins), bins, self.capacity)
                    continue
                gap = self.gaps[at]
                first, bins = self.runs[gap].pop()
                if not self.runs[gap]:
                    self.gaps.pop(at)
                self._fill(length, n, first, bins, gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """(slots that place every piece, number of sequences) for counts by length (1 to capacity)."""
    if any(not 1 <= n <= capacity for n, c in counts.items() if c):
        raise ValueError("piece lengths run from 1 to the capacity")
    made = _Plan(counts, capacity)
    made.match_large()
    made.fit_small()
    return made.slots, made.sequences


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids binary, shard, local_rank): ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seen = bpe.load(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", _SLICE):
            ids, offsets = encoder.encode(texts_of(batch, "text"))
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            doc, piece, start, length, local, raw = [], [], [], [], [], []
            for i, (begin, end) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                for p, (s, n) in enumerate(cut(end - begin, capacity)):
                    doc.append(i)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    local.append(seen[n])
                    seen[n] += 1
                    raw.append(ids[begin + s : begin + s + n].tobytes())
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary()), pa.array(np.full(len(doc), shard, np.int32)), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids", "shard", "local_rank"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, piece int, start long, length long, ids binary, shard int, local_rank long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per piece: id_col, piece, start, length, the kept columns, sequence_id, offset.

    ``keep`` names what else of a piece to return: ``ids`` (little-endian unsigned 32-bit integers)
    or an empty tuple. Null and empty texts make a piece of the end id alone; texts are whole, however
    long; ids are integers, and null and repeated ones are packed like any other row; ties are broken by
    input order within a partition; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "packing")
    pieces = ws.save(tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids")), "pieces", "zstd")
    by_shard = ws.save(pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "histogram")
    counts = {r["length"]: r["n"] for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(counts, capacity)
    schema = "length long, first long, last long, first_sequence long, per_bin long, first_offset long"
    # the plan has some slots per length, however many documents there are
    table = spark.createDataFrame([(s.length, s.first, s.last, s.sequence, s.per_bin, s.offset) for s in slots], schema)
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_shard.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the bases grow with the number of input splits, so they are never broadcast
    ranked = pieces.join(bases.hint("shuffle_hash"), ["length", "shard"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))).drop(table["length"])
    within = F.col("rank") - F.col("first")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *keep,
        (F.col("first_sequence") + F.floor(within / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(within, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
