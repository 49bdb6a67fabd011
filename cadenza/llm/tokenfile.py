"""Token-id files: canonical, length-limited Huffman codes in independent blocks.

A file set has three tables: ``codebook`` (symbol, length: all a canonical code needs), ``blocks``
and a ``shard`` number that gives the order of the part files. Each document is a block of its own:
its codes start on a byte, and ``checkpoints`` holds the bit offset of every ``STRIDE``-th id, so
any stretch of ids decodes without what stands before it. Decoding looks ``limit`` bits up in a
table and steps all stretches of a batch forward together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm import bpe
from cadenza.llm.arrowtext import binary_parts, ragged_take, slices, texts_of
from cadenza.llm.workspace import Workspace

END_ID = 2
STRIDE = 256
#: Longest code; a table of 2**LIMIT entries decodes it.
LIMIT = 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; zero where the count is zero."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    is_leaf, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        is_leaf.append(order < len(leaves))
        merged = weights[order]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[used[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


@dataclass
class Codebook:
    """Canonical codes: by length, then by symbol."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.symbols = np.flatnonzero(self.lengths)
        self.symbols = self.symbols[np.lexsort((self.symbols, self.lengths[self.symbols]))]
        bits = self.lengths[self.symbols]
        self.limit = int(bits.max()) if len(bits) else 1
        # the first code of all is zero; each next is the one before plus one at its own length
        steps = np.left_shift(1, self.limit - bits)
        starts = np.cumsum(steps) - steps
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[self.symbols] = (starts >> (self.limit - bits)).astype(np.uint64)
        self.table = np.repeat(self.symbols, steps).astype(np.uint32)
        self.table = np.concatenate([self.table, np.zeros((1 << self.limit) - len(self.table), np.uint32)])

    def encode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all blocks, byte offsets of the blocks, bit offset of each id in its block)."""
        bits = self.lengths[ids]
        if len(ids) and not bits.min():
            raise ValueError("an id has no code")
        ends = np.concatenate([[0], np.cumsum(bits)])
        block_bits = ends[offsets[1:]] - ends[offsets[:-1]]
        block_bytes = np.concatenate([[0], np.cumsum((block_bits + 7) >> 3)])
        counts = np.diff(offsets)
        inner = ends[:-1] - np.repeat(ends[offsets[:-1]], counts)
        at = inner + np.repeat(block_bytes[:-1] * 8, counts)
        words = np.zeros((int(block_bytes[-1]) >> 3) + 2, np.uint64)
        if len(ids):
            word, room = at >> 6, 64 - (at & 63) - bits
            code = self.codes[ids]
            high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[heads]] = np.bitwise_or.reduceat(high, heads)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").view(np.uint8)[: block_bytes[-1]], block_bytes, inner

    def decode(self, data: np.ndarray, bit_offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of stretches that start at these bit offsets of ``data``, each of so many ids."""
        if not len(counts):
            return np.zeros(0, np.uint32)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        # 32 bits from each byte on: a code of up to 25 bits at any bit of that byte lies within
        window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
        order = np.argsort(-counts, kind="stable")
        at, left = bit_offsets[order].astype(np.int64), counts[order]
        out = np.zeros((int(left[0]), len(left)), np.uint32)
        lengths = self.lengths.astype(np.int64)
        shift = np.uint32(32 - self.limit)
        for step in range(int(left[0])):
            alive = int(np.searchsorted(-left, -step, side="left"))
            here = at[:alive]
            symbols = self.table[(window[here >> 3] << (here & 7).astype(np.uint32)) >> shift]
            out[step, :alive] = symbols
            here += lengths[symbols]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        rows = ragged_take(np.zeros(len(counts), np.int64), counts)
        return out[rows, np.repeat(back, counts)]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids and the end id, little-endian, in 16 bits where the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load(tokenizer)
        for batch in slices(batches, "text", bpe.SLICE_BYTES):
            ids, offsets = encoder.encode(texts_of(batch, "text"))
            ids = np.insert(ids, offsets[1:], end_id).astype(_dtype(encoder.tokenizer.get_vocab_size()))
            offsets = (offsets + np.arange(len(offsets))) * ids.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], ["id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, ids binary")


def _dtype(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, dtype: str) -> DataFrame:
    """(symbol, n) over all rows; each task sends one row per symbol it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(binary_parts(batch.column(0))[0].view(dtype))
            if len(found) > len(counts):
                found, counts = counts, found.astype(np.int64)
            counts[: len(found)] += found
        symbols = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(counts[symbols])], ["symbol", "n"])

    return tokens.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write the file set of all texts, null as empty, in ascending id order (null ids first, ties in any order)."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "tokenfile")
    vocabulary = bpe.load(tokenizer).tokenizer.get_vocab_size()
    dtype = _dtype(vocabulary)
    tokens = ws.save(tokenised(docs, tokenizer, end_id, id_col, text_col), "ids", "zstd")
    counts = np.zeros(max(vocabulary, end_id + 1), np.int64)
    for row in count_ids(tokens, dtype).collect():  # at most a row per symbol of the vocabulary
        counts[row["symbol"]] = row["n"]
    book = Codebook(code_lengths(counts, limit))
    shared = spark.sparkContext.broadcast(book.lengths.astype(np.uint8).tobytes())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, shard, before = Codebook(np.frombuffer(shared.value, np.uint8).astype(np.int64)), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "ids"):
            raw, offsets = binary_parts(batch.column(1))
            ids, offsets = raw.view(dtype).astype(np.int64), offsets // np.dtype(dtype).itemsize
            counts = np.diff(offsets)
            data, at, inner = book.encode(ids, offsets)
            stretches = -(-counts // STRIDE)
            marks = inner[np.repeat(offsets[:-1], stretches) + STRIDE * ragged_take(np.zeros(len(stretches), np.int64), stretches)]
            blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
            bounds = np.concatenate([[0], np.cumsum(stretches)]).astype(np.int32)
            columns = [pa.array(np.full(len(counts), shard, np.int32)), batch.column(0), pa.array(counts), pa.array(before + offsets[:-1]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(marks)), blocks.cast(pa.binary())]
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "n_ids", "shard_start", "checkpoints", "bits"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ids travel before they are coded: finding the ranges then costs a plain scan
    ordered = tokens.repartitionByRange(parts, "id").sortWithinPartitions("id")
    blocks = ordered.mapInArrow(encode, "shard int, id long, n_ids long, shard_start long, checkpoints array<long>, bits binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    rows = [(int(s), int(book.lengths[s])) for s in book.symbols]
    spark.createDataFrame(rows, "symbol long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    ws.drop("ids")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_ids, ids_crc32, ids): start counts the ids of all documents before; ids little-endian in 32 bits."""
    rows = spark.read.parquet(f"{path}/codebook").collect()  # one row per symbol of the vocabulary
    lengths = np.zeros(max([r["symbol"] for r in rows], default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["symbol"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths.tobytes())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(shared.value, np.uint8).astype(np.int64))
        for batch in slices(batches, "bits", 1 << 22):
            (raw, at), counts = binary_parts(batch.column(5)), batch.column(2).to_numpy()
            begins = at[:-1] * 8
            marks = batch.column(4).flatten().to_numpy()
            stretches = -(-counts // STRIDE)
            last = np.cumsum(stretches) - 1
            each = np.full(len(marks), STRIDE, np.int64)
            each[last] = counts - STRIDE * (stretches - 1)
            ids = book.decode(raw, marks + np.repeat(begins, stretches), each).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
            parts = [ids[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)]
            crc = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc, pa.array(parts if with_ids else [None] * len(parts), pa.binary())], ["shard", "id", "n_ids", "shard_start", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "id", "n_ids", "shard_start", "checkpoints", "bits")
    # one row per part file
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    decoded = blocks.mapInArrow(decode, "shard int, id long, n_ids long, shard_start long, ids_crc32 long, ids binary")
    return decoded.join(F.broadcast(bases), "shard").select("id", (F.col("base") + F.col("shard_start")).alias("start"), "n_ids", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, limit: int = LIMIT) -> DataFrame:
    """Write the file set into the shared folder and read it back: id_col, start, n_tokens, ids_crc32 and, if asked, ids.

    Null texts count as empty and give the end id alone; texts are whole, however long; ids are integers
    and null ids come first; repeated ids keep their rows, in any order among themselves; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "token-ids")
    write(docs, ws.path("files"), tokenizer, end_id, id_col, text_col, limit)
    found = read(docs.sparkSession, ws.path("files"), with_ids)
    return found.select(F.col("id").alias(id_col), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32", *(["ids"] if with_ids else []))
