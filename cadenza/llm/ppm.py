"""Language-model scoring by prediction by partial matching over bytes.

A text is scored as its tokens: words of lower-cased text (A-Z only) joined by single spaces, then
an end symbol. The model is a trie of byte contexts up to ``ORDER`` bytes. A symbol is looked for
in the longest context that the trie holds; where it lacks, the model pays that context's escape
probability and goes to the next shorter one, leaving out symbols that the longer one would have
predicted; below the empty context all remaining byte values are equally likely. A context gives
``discount`` of each distinct symbol's count to its escape, plus the mass of what the trie left out.

Pretrained scoring learns the counts of all training texts: of the longest order how often, of a
shorter one behind how many different bytes (a symbol that a longer context predicts does not count
again below). The discount of an order follows from how many entries occur once and twice. Nothing is
cut off. Most bytes of a text stand in a frequent window of ``ORDER`` + 1 bytes, so executors hold the
finished log probabilities of up to ``HEAD_GRAMS`` frequent ones. All other windows meet the whole trie:
it is sharded by the last bytes of the context, which all contexts of a window share, so each task
holds one part of the trie and scores what falls there; only the shortest orders, which bytes bound,
travel whole. Escape and exclusion terms depend on the trie alone and are worked out once per context.
Adaptive scoring (``Adaptive``) learns from the text itself as it goes.

Beside it stands a unigram base: word counts over all training texts. Executors receive the counts
of at most ``HEAD_WORDS`` frequent words; all other words of a document meet their counts in a join.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import held, segment_sum, slices, texts_of
from cadenza.llm.sampling import fold
from cadenza.llm.workspace import Workspace

ORDER = 5
HEAD_GRAMS = 400_000
#: Entries of an order that may travel whole, beyond the two orders that bytes bound.
LOW_GRAMS = 500_000
HEAD_WORDS = 200_000
END = 10  # a byte that no token contains
#: Byte values a token sequence can hold: all but \\t, \\v, \\f and \\r; the end symbol is the line feed.
ALPHABET = 252
#: Entries a counting task holds before it sends them on.
FLUSH = 1_000_000
#: Bytes of text counted or scored at once, and windows of them.
SLICE_BYTES, TOGETHER = 2 << 20, 1 << 19


def split(texts: pa.Array) -> pa.LargeListArray:
    """Words of each text; a text without words gives one empty string."""
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))


def padded(words: pa.LargeListArray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets): each text is ``order`` end symbols, its joined words, one end symbol."""
    joined = pc.binary_join(words, pa.scalar(" ", pa.large_string()))
    edge = pa.scalar("\n" * order, pa.large_string())
    joined = pc.binary_join_element_wise(edge, joined, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    joined = pa.concat_arrays([joined])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def windows(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(each symbol behind its ``order`` bytes as one number, offsets by text)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    n = len(data) - order
    keys = np.zeros(n, np.uint64)
    for k in range(order + 1):
        keys <<= np.uint64(8)
        keys |= data[k : k + n]
    symbol = np.ones(len(data), bool)
    symbol[(offsets[:-1][:, None] + np.arange(order)).ravel()] = False
    counts = np.diff(offsets) - order
    return keys[symbol[order:]], np.concatenate([[0], np.cumsum(counts)])


class Lookup:
    """Positions of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys, self.at = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = first[free[first]]
            self.keys[slot[won]], self.at[slot[won]] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.at[slot], -1)
        open_ = np.flatnonzero((found < 0) & (self.at[slot] >= 0))
        while len(open_):
            slot_left = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = slot_left
            same = self.keys[slot_left] == keys[open_]
            found[open_[same]] = self.at[slot_left[same]]
            open_ = open_[~same & (self.at[slot_left] >= 0)]
        return found


@dataclass
class Level:
    grams: np.ndarray  # context and symbol as a number, sorted
    log_count: np.ndarray
    direct: np.ndarray  # log probability where this context is the longest
    contexts: np.ndarray  # sorted
    escape: np.ndarray  # leaving this context, come to first
    onward: np.ndarray  # leaving the next shorter context without this one's symbols
    share: np.ndarray  # log of what the next shorter context divides by without this one's symbols


class Trie:
    """Pretrained model from (gram, count) tables of orders 0 to n and each order's discount.

    A part of a trie serves the windows whose contexts it holds: an order may lack contexts, but
    those it has are whole, and so are their suffixes' in the orders below.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], discounts: list[float]) -> None:
        self.levels: list[Level] = []
        below = None
        for (grams, counts), d in zip(tables, discounts, strict=True):
            order = np.argsort(grams)
            grams, counts = grams[order].astype(np.uint64), counts[order].astype(np.float64)
            contexts, size = np.unique(grams >> np.uint64(8), return_counts=True)
            node = np.repeat(np.arange(len(contexts)), size)
            total, distinct = np.bincount(node, counts, minlength=len(contexts)), size.astype(np.float64)
            escape = np.log(d * distinct / total)
            onward = share = np.zeros(len(contexts))
            if below is not None:
                b_grams, b_counts, b_contexts, b_total, b_distinct, b_d = below
                mask = np.uint64((1 << 8 * len(self.levels)) - 1)
                parent = np.searchsorted(b_contexts, contexts & (mask >> np.uint64(8)))
                taken = np.bincount(node, b_counts[np.searchsorted(b_grams, grams & mask)], minlength=len(contexts))
                others = b_distinct[parent] - distinct
                whole = b_total[parent] - taken
                onward = np.where(others > 0, np.log(np.maximum(b_d * others, 1e-300) / np.maximum(whole, 1e-300)), 0.0)
                share = np.log(np.maximum(whole, 1e-300))
            log_count = np.log(counts - d)
            self.levels.append(Level(grams, log_count, log_count - np.log(total)[node], contexts, escape, onward, share))
            below = grams, counts, contexts, total, distinct, d
        self.order = len(tables) - 1
        self.symbols = len(self.levels[0].grams)

    def log10_each(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte."""
        out = np.zeros(len(keys))
        node = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level.grams):
                continue
            own = keys[open_]
            gram = own & np.uint64((1 << 8 * (k + 1)) - 1)
            context = gram >> np.uint64(8)
            at = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            here = level.contexts[at] == context
            place = np.minimum(np.searchsorted(level.grams, gram), len(level.grams) - 1)
            seen = level.grams[place] == gram
            come = node[open_] >= 0
            above = self.levels[k + 1] if k < self.order else level
            child = np.maximum(node[open_], 0)
            fresh, later = here & ~come, here & come
            add = np.zeros(len(own))
            add[fresh] = np.where(seen, level.direct[place], level.escape[at])[fresh]
            if later.any():
                add[later] = np.where(seen[later], level.log_count[place[later]] - above.share[child[later]], above.onward[child[later]])
            out[open_] += add
            node[open_] = np.where(here, at, node[open_])
            open_ = open_[~(here & seen)]
        out[open_] -= math.log(max(ALPHABET - self.symbols, 1))
        return out / math.log(10)


class Adaptive:
    """Learns from one text while coding it: one dictionary of counts per context, half a count of each symbol to the escape."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, Counter] = {}

    def log10(self, text: str, learn: bool = True) -> float:
        data = b"\n" * self.order + b" ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()) + b"\n"
        total = 0.0
        for i in range(self.order, len(data)):
            total += math.log10(self.probability(data[i - self.order : i], data[i]))
            if learn:
                for k in range(self.order + 1):
                    self.counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
        return total

    def probability(self, context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                continue
            open_ = {s: c for s, c in seen.items() if s not in out}
            whole = sum(open_.values())
            if symbol in open_:
                return p * (open_[symbol] - 0.5) / whole
            if open_:
                p *= 0.5 * len(open_) / whole
            out |= set(seen)
        return p / max(ALPHABET - len(out), 1)


def count(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(word, gram, n): counts of all words and of all windows of the longest order; the other key is null.

    Each task counts before it sends; the rest is one aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        schema = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

        def sums() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in grams]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in grams])).astype(np.int64)

        def send_words() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], schema=schema)
            words.clear()
            return batch

        def send_grams() -> pa.RecordBatch:
            keys, n = sums()
            grams.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], schema=schema)

        for batch in slices(batches, text_col, SLICE_BYTES):
            parts = split(texts_of(batch, text_col))
            coded = parts.flatten().dictionary_encode()
            found = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
            for word, n in zip(coded.dictionary.to_pylist(), found, strict=True):
                if word:
                    words[word] += n
            keys, n = np.unique(windows(*padded(parts, order), order)[0], return_counts=True)
            grams.append((keys, n))
            held += len(keys)
            if held > FLUSH:
                grams = [sums()]
                held = len(grams[0][0])
                if held > FLUSH:
                    yield send_grams()
                    held = 0
            if len(words) > FLUSH // 4:
                yield send_words()
        if words:
            yield send_words()
        if grams:
            yield send_grams()

    found = docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "word string, gram long, n long")
    return found.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach, about as small as can be, from a histogram in steps of an eighth of a power of two."""
    step = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect()  # 504 rows at most
    total, found = 0, None
    for r in rows:
        total += r["k"]
        if total > most:
            break
        found = r["least"]
    return found if found is not None else (rows[0]["top"] + 1 if rows else 1)


@dataclass
class Model:
    levels: list[DataFrame]  # (gram, c) by order, whole
    discounts: list[float]
    head: tuple[np.ndarray, np.ndarray]  # frequent windows and their log10 probabilities
    low: list[tuple[np.ndarray, np.ndarray]]  # the shortest orders, which every shard needs

    def shard(self) -> Column:
        """Name of the part of the trie that holds all contexts of ``gram`` which ``low`` does not."""
        return F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * len(self.low)) - 1))


def build(ws: Workspace, counts: DataFrame, order: int = ORDER, most: int = HEAD_GRAMS, low_grams: int = LOW_GRAMS) -> Model:
    """The model over counts(gram, n): at most ``most`` windows and the shortest orders reach the driver."""
    full = ws.save(counts.where("gram is not null").select("gram", "n", F.col("n").alias("c")), f"grams-{order}")
    levels = [full]
    for k in range(order - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram"))
        levels.append(ws.save(shorter.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")), f"grams-{k}"))
    levels.reverse()
    discounts, sizes = [], []
    for grams in levels:
        few = grams.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"), F.count(F.lit(1)).alias("all")).first()
        discounts.append(discount(few["once"], few["twice"]))
        sizes.append(few["all"])
    # two bytes make 65,536 entries at most; a third order joins them if its size, known here, is small
    bytes_ = min(order, 3 if order > 2 and sizes[2] <= low_grams else 2)
    low = [_columns(grams.select("gram", "c")) for grams in levels[:bytes_]]
    frequent = full.where(F.col("n") >= _threshold(full, most)).withColumn("context", F.shiftright("gram", 8))
    totals = full.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"))
    direct = F.log10(F.col("c") - F.lit(discounts[-1])) - F.log10("total")
    head = _columns(frequent.join(totals, "context").select("gram", direct.alias("direct")))
    return Model([x.select("gram", "c") for x in levels], discounts, (head[0].astype(np.uint64), head[1]), low)


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy()


def resolve(windows_: DataFrame, model: Model) -> DataFrame:
    """windows_(row, gram, times) → (row, score): each window's log10 probability by the whole trie, as often as it occurs."""
    spark, order, first = windows_.sparkSession, len(model.levels) - 1, len(model.low)
    shared = spark.sparkContext.broadcast(pickle.dumps((model.low, model.discounts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[tuple[list, list]] = [([], []) for _ in range(order + 1)]
        trie = None
        for batch in batches:
            kinds, grams, counts = (batch.column(i).to_numpy() for i in range(3))
            for k in np.unique(kinds).tolist():
                own = kinds == k
                if k <= order:
                    tables[k][0].append(grams[own])
                    tables[k][1].append(counts[own])
                    continue
                if trie is None:
                    low, discounts = pickle.loads(shared.value)
                    empty_ = np.zeros(0, np.int64)
                    upper = [(np.concatenate([*g, empty_]), np.concatenate([*c, empty_])) for g, c in tables[first:]]
                    trie, tables = Trie([*low, *upper], discounts), []
                found = trie.log10_each(grams[own].astype(np.uint64)) * counts[own]
                # one row per window: how many share a task says nothing about the corpus, and Spark adds them up
                yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(own)), pa.array(found)], ["row", "score"])

    none = F.lit(None).cast("long").alias("row")
    union = windows_.select(F.lit(order + 1).alias("kind"), "gram", F.col("times").alias("c"), "row")
    for k in range(first, order + 1):
        union = union.unionByName(model.levels[k].select(F.lit(k).alias("kind"), "gram", "c", none))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the trie's entries come before the windows that need them
    return union.repartition(parts, model.shard()).sortWithinPartitions("kind").mapInArrow(run, "row long, score double")


def discount(once: int, twice: int) -> float:
    """What to take off a count, from how many entries have counts one and two."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once + twice else 0.5


def score(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, most: int = HEAD_GRAMS, head_words: int = HEAD_WORDS, low_grams: int = LOW_GRAMS) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``; counts come from all of ``learn``.

    Whole texts, however long, null as empty (one end token). Repeated rows and null ids stay (ids are integers); other
    columns are ignored, whatever their names; without rows to learn from every token is unknown and
    the model is uniform over bytes; an empty table gives an empty result. ``most``, ``head_words`` and
    ``low_grams`` bound what executors hold and change no score.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "ppm")
    counts = ws.save(count(learn, text_col, order), "counts", "zstd")
    n_docs = learn.select(F.lit(1)).count()
    words = counts.where("word is not null").select("word", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    bound = _threshold(words, head_words)
    head = words.where(F.col("n") >= bound).toArrow()  # at most head_words rows
    model = build(ws, counts, order, most, low_grams) if n_docs else None
    keys = pa.chunked_array(head.column("word").chunks, pa.string()).combine_chunks().cast(pa.large_string())
    shared = spark.sparkContext.broadcast(pickle.dumps((model.head if model else None, keys, head.column("n").to_numpy().astype(np.float64), n_docs)))
    key = uuid.uuid4().hex

    def load() -> tuple:
        grams, names, n_head, n_docs = pickle.loads(shared.value)
        return (Lookup(grams[0]), grams[1]) if grams else None, names, np.log10(np.concatenate([n_head, [n_docs]]) + 0.5), n_docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, names, logs, n_docs = held(key, load)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE_BYTES):
            parts = split(texts_of(batch, "text"))
            offsets = parts.offsets.to_numpy().astype(np.int64)
            coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            offsets = offsets - offsets[0]
            codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            at = pc.fill_null(pc.index_in(distinct, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            blank = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
            known, real = at[codes], ~blank[codes]
            tokens = segment_sum(real.astype(np.int64), offsets) + 1
            in_head = segment_sum((known >= 0).astype(np.int64), offsets) + (n_docs > 0)
            base = segment_sum(np.where(known >= 0, logs[known], 0.0), offsets) + logs[-1]
            rare = np.flatnonzero((known < 0) & real)
            doc = np.repeat(np.arange(len(tokens)), np.diff(offsets))[rare]
            pairs, tf = np.unique(doc * max(len(distinct), 1) + codes[rare], return_counts=True)
            word_list, times = _by_doc(pairs // max(len(distinct), 1), len(tokens), distinct.take(pa.array(pairs % max(len(distinct), 1))).cast(pa.string()), tf)
            own, grams = _head_scores(frequent, *padded(parts, order), order)
            gram_list, gram_times = _by_doc(grams[0], len(tokens), pa.array(grams[1]), grams[2])
            ids = pa.array(row + np.arange(len(tokens)))
            row += len(tokens)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), pa.array(tokens), pa.array(in_head), pa.array(base), pa.array(own), word_list, times, gram_list, gram_times],
                ["row", "id", "n_tokens", "known", "base", "score", "words", "times", "grams", "gram_times"],
            )

    schema = "row long, id long, n_tokens long, known long, base double, score double, words array<string>, times array<long>, grams array<long>, gram_times array<long>"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = ws.save(source.mapInArrow(run, schema), "scored", "zstd")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # only words that are rare everywhere get here, so no key of this join is hot
    met = rare.join(words.where(F.col("n") < bound), "word", "left")
    count_ = F.coalesce("n", F.lit(0))
    extra = met.groupBy("row").agg(F.sum(F.when(count_ > 0, F.col("times")).otherwise(0)).alias("known_more"), F.sum(F.col("times") * F.log10(count_ + 0.5)).alias("base_more"))
    out = scored.select("row", "id", "n_tokens", "known", "base", "score").join(extra, "row", "left")
    if model:
        left = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("times"))
        out = out.join(resolve(left, model).groupBy("row").agg(F.sum("score").alias("score_more")), "row", "left")
    else:
        out = out.withColumn("score_more", F.lit(0.0))
    norm = math.log10(total + 0.5 * (distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )


def _by_doc(doc: np.ndarray, docs: int, values: pa.Array, times: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lists of values and of their times for each text; ``doc`` ascends."""
    bounds = pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, values), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64)))


def _head_scores(frequent: tuple[Lookup, np.ndarray] | None, data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sum of each text's frequent windows, (text, window, times) of all others); without a model every byte value is alike."""
    docs = len(offsets) - 1
    out = np.zeros(docs)
    none = np.zeros(0, np.int64)
    if frequent is None:
        return -math.log10(ALPHABET) * (np.diff(offsets) - order), (none, none, none)
    table, logs = frequent
    left: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(order, len(data), TOGETHER):  # positions of symbols, those of the padding left out
        spots = np.arange(at, min(at + TOGETHER, len(data)))
        doc = np.searchsorted(offsets, spots, "right") - 1
        symbol = spots - offsets[doc] >= order
        keys = np.zeros(len(spots), np.uint64)
        for k in range(order, -1, -1):
            keys <<= np.uint64(8)
            keys |= data[at - k : at - k + len(spots)]
        keys, doc = keys[symbol], doc[symbol]
        found = table.find(keys)
        hit = found >= 0
        out += np.bincount(doc[hit], logs[found[hit]], minlength=docs)
        left.append((doc[~hit], keys[~hit].view(np.int64)))
    if not left:
        return out, (none, none, none)
    doc, keys = (np.concatenate([x[i] for x in left]) for i in range(2))
    order_ = np.lexsort((keys, doc))
    doc, keys = doc[order_], keys[order_]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])) if len(doc) else none
    return out, (doc[first], keys[first], np.diff(np.concatenate([first, [len(doc)]])))


def score_adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id_col and score: each text's log10 probability under a model that starts empty and learns from that text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [Adaptive(order).log10(t) for t in texts_of(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], [id_col, "score"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def learned(docs: DataFrame, id_col: str = "doc_id", hold_out: int = 1) -> DataFrame:
    """Rows whose fold is not ``hold_out``; rows without id are scored but never learned."""
    return docs.where(fold(id_col) != hold_out)
