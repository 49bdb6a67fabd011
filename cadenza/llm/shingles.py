"""Near duplicates by the Jaccard similarity of word shingles: SimHash, BK-trees in shards, exact check.

Two texts link if the sets of their five-word shingles have a Jaccard similarity of at least 0.8
(9 * common >= 4 * both sizes). Each set has a 64-bit SimHash. Fingerprints of two such sets differ in
some 10 bits, in more than ``RADIUS`` with a probability of about one in a million.

Blocks of a fingerprint are no shard keys at that radius: too few stay whole. Shards are keyed by
shingles instead. In any fixed order of all shingles, two sets 0.8 alike share one of their first
n - ceil(0.8 n) + 1, so each set goes to one shard per such shingle and no pair is lost. Shingles that
are frequent in a sample come last, which keeps shards small; the sample decides nothing else.

Shards of up to ``SMALL`` sets compare all their pairs: fingerprints within the radius, and sizes and
places of the shard's shingle in both orders that 0.8 allows, as only what follows the first shared
shingle can be shared. Sets with the same first shingle meet in its shard and are left out elsewhere. A
shard gives its pairs, or the sets in them where those are fewer: never more rows than it has.

Those sets and the larger shards stand in BK-trees, followed along the edges within the radius. They
first link each set to its nearest neighbour; what is then in one component is not paired again. Parity
maps must allow every pair: such a map has a bit for each of ``PARITIES`` residues, set if an odd number
of shingles fall there, and two maps never differ in more bits than the sets in shingles. Shards over
``BLOCK`` sets are dealt out as pairs of blocks. Every pair left is compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import encode_words, ragged_take, release, slices, texts_of
from cadenza.llm.bktree import PackedBKTree
from cadenza.llm.graph import connected_components
from cadenza.llm.ppm import split
from cadenza.llm.workspace import Workspace

WORDS = 5
RADIUS = 24
SMALL = 32
BLOCK = 2048
PARITIES = 512
#: Residues of the maps that are made of the texts in candidate pairs: large sets fill the small maps.
FINE = 8192
#: Share of rows, and of those the share that makes a shingle frequent: both only order the shingles.
SAMPLE, FREQUENT = 16, 1000
_PRINTS = "id long, key long, fp long, sim long, n int, parity binary, prefix array<long>, hot array<boolean>"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Candidate pairs that a task holds before it sends the distinct ones on.
_FLUSH = 1 << 20
#: Bytes of text whose shingles are held at once.
_SLICE = 1 << 20
#: A place's low bits: the set's size and the sixteenth of the prefix; above them the code of the first shingle.
_PLACE_BITS = 35
#: Buckets of keys that choose the texts to compare; bounds what is broadcast.
_BUCKETS = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): of each text the sorted distinct hashes of its shingles.

    A-Z count as lower case; words are runs without ASCII white space. A text of fewer words has one
    shingle, all of them; a text without words has none.
    """
    codes, offsets, names = encode_words(split(texts))
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[codes] if len(names) else np.zeros(0, np.uint64)
    blank = np.array([not w for w in names], bool)[codes] if len(names) else np.zeros(0, bool)
    counts = np.diff(offsets)
    hashes, docs = [], []
    n = len(own) - words + 1
    if n > 0:
        whole = np.full(n, words, np.uint64)
        for k in range(words):
            whole = _mix(whole * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
        runs = np.maximum(counts - words + 1, 0)
        hashes.append(whole[ragged_take(offsets[:-1], runs)])
        docs.append(np.repeat(np.arange(len(counts)), runs))
    for i in np.flatnonzero((counts > 0) & (counts < words)).tolist():
        s, e = int(offsets[i]), int(offsets[i + 1])
        if not blank[s]:
            whole = np.array([e - s], np.uint64)
            for k in range(s, e):
                whole = _mix(whole * np.uint64(0x9E3779B97F4A7C15) + own[k : k + 1])
            hashes.append(whole)
            docs.append(np.array([i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    all_, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((all_, doc))
    all_, doc = all_[order], doc[order]
    first = np.ones(len(all_), bool)
    first[1:] = (all_[1:] != all_[:-1]) | (doc[1:] != doc[:-1])
    return all_[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(counts)))])


def simhashes(members: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set: a bit is one if set in over half the members."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = offsets[:-1][some]
        for bit in range(64):
            ones = np.add.reduceat(((members >> np.uint64(bit)) & np.uint64(1)).astype(np.uint32), starts)
            out[some] |= (ones * 2 > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def parities(members: np.ndarray, offsets: np.ndarray, residues: int = PARITIES) -> np.ndarray:
    """A row of ``residues`` / 8 bytes for each set."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    odd = np.bincount(doc * residues + (members % np.uint64(residues)).astype(np.int64), minlength=(len(offsets) - 1) * residues) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, residues), axis=1, bitorder="little")


def _name(members: bytes) -> int:
    """What stands for a set everywhere: equal sets bear it together; zero for the empty one."""
    return int.from_bytes(xxhash.xxh3_64_digest(members), "little", signed=True) if members else 0


def _listed(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _prints(docs: DataFrame, frequent: np.ndarray, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", _SLICE):
            members, offsets = shingle_sets(texts_of(batch, "text"), words)
            sizes = np.diff(offsets)
            raw, ends = members.tobytes(), (offsets * 8).tolist()
            names = np.array([_name(raw[s:e]) for s, e in zip(ends, ends[1:], strict=False)], np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            late = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] == members if len(frequent) else np.zeros(len(members), bool)
            order = np.lexsort((late, doc))  # stable: within a text by hash
            most = np.where(sizes > 0, sizes // 5 + 1, 0)  # n - ceil(0.8 n) + 1
            first = order[ragged_take(offsets[:-1], most)]
            bounds = np.concatenate([[0], np.cumsum(most)])
            maps = parities(members, offsets)
            columns = [
                batch.column(0), batch.column(1), pa.array(names), pa.array(simhashes(members, offsets).view(np.int64)), pa.array(sizes.astype(np.int32)),
                pa.array([x.tobytes() for x in maps], pa.binary()), _listed(pa.array(members[first].view(np.int64)), bounds), _listed(pa.array(late[first]), bounds),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "fp", "sim", "n", "parity", "prefix", "hot"])

    return docs.mapInArrow(run, _PRINTS)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes in at least one of FREQUENT rows of a sample of rows, eight rows at least; their number does not grow with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(texts_of(batch, "text"), words)[0].view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    least = max(8, sample.count() // FREQUENT)
    found = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _alike(n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes that 0.8 allows."""
    return (5 * n[i] >= 4 * n[j]) & (5 * n[j] >= 4 * n[i])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without their last key's rows, which go with the next, so that no key is split."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        changes = np.flatnonzero(np.diff(keys))
        last = int(changes[-1]) + 1 if len(changes) else 0
        if kept and keys[0] != kept[0].column(0)[0].as_py():
            yield _joined(kept)
            kept = []
        if last:
            yield _joined([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield _joined(kept)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _placed(sets: DataFrame) -> DataFrame:
    """(shard, fp, sim, place, hot) for each shingle of the sets' prefixes."""
    rows = sets.select("fp", "sim", "n", F.element_at("prefix", 1).alias("first"), F.posexplode(F.arrays_zip("prefix", "hot")).alias("at", "x"))
    sixteenth = F.expr("16L * at div (n div 5 + 1)")
    size = F.col("n").cast("long") * 16 + sixteenth
    place = F.shiftleft("first", _PLACE_BITS).bitwiseOR(size)
    return rows.select(F.col("x.prefix").alias("shard"), "fp", "sim", place.alias("place"), F.col("x.hot").alias("hot"))


def _small(shards: DataFrame) -> DataFrame:
    """shards(shard, fp, sim, place) → (a, b, shard, fp): candidate pairs of small shards, and the members of the others.

    A small shard whose sets form more pairs than they are gives those sets, under a name of their own
    that equal groups share.
    """
    schema = pa.schema([*_PAIR, ("shard", pa.int64()), ("fp", pa.int64())])

    def rows(held: list[np.ndarray], pairs: bool) -> pa.RecordBatch:
        ends = np.unique(np.concatenate(held), axis=0)
        held.clear()
        none, both = [pa.nulls(len(ends), pa.int64())] * 2, [pa.array(ends[:, 0]), pa.array(ends[:, 1])]
        return pa.RecordBatch.from_arrays([*both, *none] if pairs else [*none, *both], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        for batch in _grouped(batches):
            keys, fps, sims, place = (c.to_numpy() for c in batch.columns)
            sims, place = sims.view(np.uint64), place.view(np.uint64)
            first, low = place >> np.uint64(_PLACE_BITS), (place & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            n = low >> 4
            after = n + (-(low & 15) * (n // 5 + 1) // 16)  # the shingle itself and what follows it, or a little more
            here = (keys.view(np.uint64) << np.uint64(_PLACE_BITS)) >> np.uint64(_PLACE_BITS) == first
            starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            large = np.flatnonzero(sizes > SMALL)
            if len(large):
                at = ragged_take(starts[large], sizes[large])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(keys[at]), pa.array(fps[at])], schema=schema)
            for size in range(2, SMALL + 1):  # all shards of a size at once: too small for trees
                own = starts[sizes == size]
                if not len(own):
                    continue
                left, right = np.triu_indices(size, 1)
                i, j = own[:, None] + left, own[:, None] + right
                near = 9 * np.minimum(after[i], after[j]) >= 4 * (n[i] + n[j])
                near &= (np.bitwise_count(sims[i] ^ sims[j]) <= RADIUS) & ((first[i] != first[j]) | here[i])
                if not near.any():
                    continue
                inside = np.zeros((len(own), size), bool)
                for pair in np.flatnonzero(near.any(axis=0)).tolist():
                    inside[:, left[pair]] |= near[:, pair]
                    inside[:, right[pair]] |= near[:, pair]
                many = near.sum(axis=1) > inside.sum(axis=1)
                near[many] = False
                if near.any():
                    pairs.append(np.sort(np.stack([fps[i[near]], fps[j[near]]], axis=1), axis=1))
                if many.any():
                    sets, inside = fps[own[many][:, None] + np.arange(size)], inside[many]
                    # a 64-bit name may be shared by chance; that only puts more sets into one search
                    names = _mix((_mix(sets.view(np.uint64)) * inside).sum(axis=1, dtype=np.uint64)).view(np.int64)
                    groups.append(np.stack([np.broadcast_to(names[:, None], sets.shape)[inside], sets[inside]], axis=1))
            if sum(map(len, pairs)) > _FLUSH:
                yield rows(pairs, True)
            if sum(map(len, groups)) > _FLUSH:
                yield rows(groups, False)
        if pairs:
            yield rows(pairs, True)
        if groups:
            yield rows(groups, False)

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long, shard long, fp long")


def _allowed(n: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs that the parity maps allow, bits in which the maps differ)."""
    both = (n[i] + n[j]).astype(np.int64)
    apart = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
    return apart <= both - 2 * -(-4 * both // 9), apart


def _maps(column: pa.Array, residues: int = PARITIES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), residues // 64)


def _possible(pairs: DataFrame, facts: DataFrame, residues: int = PARITIES) -> DataFrame:
    """The pairs (a, b) that the parities in facts(fp, n, parity) allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(batch)
            n = np.concatenate([batch.column(2).to_numpy(), batch.column(4).to_numpy()])
            maps = np.concatenate([_maps(batch.column(3), residues), _maps(batch.column(5), residues)])
            keep, _ = _allowed(n, maps, np.arange(k), np.arange(k, 2 * k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep))

    side = lambda name: facts.select(F.col("fp").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"parity_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "parity_a", "n_b", "parity_b")
    return both.mapInArrow(run, "a long, b long")


def _search(shards: DataFrame, every: bool) -> DataFrame:
    """shards(shard, side, fp, sim, n, parity, component) → distinct (a, b) by a BK-tree per shard.

    For each set its nearest of another component, or every one that the parities allow; ``side``
    tells the two blocks of a pair apart, -1 where both are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches):
            keys, side, fps, sims, n, _, group = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            maps = _maps(batch.column(5))
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            found = []
            for s, e in zip(bounds, bounds[1:], strict=False):
                values = sims[s:e].view(np.uint64)
                best: dict[int, tuple[int, int]] = {}
                for i, j in PackedBKTree(values).within(values, RADIUS):
                    i, j = i + s, j + s
                    keep = (i != j) & (group[i] != group[j]) & _alike(n, i, j)
                    keep &= (side[i] == -1) | (side[i] != side[j])
                    if every:
                        keep &= i > j
                    i, j = i[keep], j[keep]
                    keep, apart = _allowed(n, maps, i, j)
                    i, j, apart = i[keep], j[keep], apart[keep]
                    if every:
                        found.append(np.stack([i, j], axis=1))
                        continue
                    order = np.lexsort((j, apart, i))
                    i, j, apart = i[order], j[order], apart[order]
                    for x in np.flatnonzero(np.diff(i, prepend=-1)).tolist():
                        best[int(i[x])] = min(best.get(int(i[x]), (1 << 30, 0)), (int(apart[x]), int(j[x])))
                if best:
                    found.append(np.array([(i, j) for i, (_, j) in best.items()]))
                if sum(map(len, found)) > _FLUSH:
                    yield _pairs(fps, found)
                    found = []
            if found:
                yield _pairs(fps, found)

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def _pairs(fps: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.unique(np.sort(fps[np.concatenate(found)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=_PAIR)


def _verified(ws: Workspace, label: str, pairs: DataFrame, named: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of sets that are in fact 0.8 alike; named(fp, key) has a row of ``source`` for each set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
        for batch in slices(batches, "text", _SLICE):
            found, offsets = shingle_sets(texts_of(batch, "text"), words)
            raw, ends = found.tobytes(), (offsets * 8).tolist()
            # rows of other texts may bear the same key
            own = [_name(raw[s:e]) == fp for s, e, fp in zip(ends, ends[1:], batch.column(0).to_pylist(), strict=False)]
            yield batch.column(0), found, offsets, pa.array(own, pa.bool_())

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, found, offsets, own in read(batches):
            yield pa.RecordBatch.from_arrays([fps, _listed(pa.array(found.view(np.int64)), offsets)], ["fp", "members"]).filter(own)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, found, offsets, own in read(batches):
            fine = pa.array([x.tobytes() for x in parities(found, offsets, FINE)], pa.binary())
            yield pa.RecordBatch.from_arrays([fps, pa.array(np.diff(offsets).astype(np.int32)), fine], ["fp", "n", "parity"]).filter(own)

    def texts(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        wanted = ws.save(named.join(ends, "fp", "left_semi"), name)
        bucket = F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)).alias("bucket")
        # most texts are in no pair: their buckets tell before anything is shuffled
        likely = source.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi")
        return likely.join(wanted, "key").select("fp", "text")

    facts = texts(pairs, f"{label}-wanted").mapInArrow(maps, "fp long, n int, parity binary").groupBy("fp").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    pairs = ws.save(_possible(pairs, facts, FINE), f"{label}-possible")
    ws.settle()
    sets = texts(pairs, f"{label}-compared").mapInArrow(members, "fp long, members array<long>").groupBy("fp").agg(F.first("members").alias("members"))
    side = lambda name: sets.select(F.col("fp").alias(name), F.col("members").alias(f"of_{name}"))
    # row by row in Spark: batches of pairs of long texts would be large
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = 9 * F.size(F.array_intersect("of_a", "of_b")) >= 4 * (F.size("of_a") + F.size("of_b"))
    verified = ws.save(both.where(alike).select("a", "b"), label)
    ws.drop(f"{label}-wanted", f"{label}-possible", f"{label}-compared")
    ws.settle()
    return verified


def _dealt(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Shards over the block size as pairs of blocks: a set goes to every pair that its block is in."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    out = members.join(sizes, "shard").withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a pair of a block with itself compares all; of two blocks, only across
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    # a 64-bit name may be shared by chance; that only puts more pairs under the bounds
    name = F.struct("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return out.select(F.xxhash64(name).alias("shard"), side.alias("side"), "fp", "sim", "n", "parity", "component")


def link_sets(ws: Workspace, prints: DataFrame, source: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(a, b) over the longs ``fp``: edges that connect exactly what similarities of 0.8 or more connect; drops the table ``wide`` of prints."""
    one = prints.groupBy("fp").agg(F.min("key").alias("key"), F.first(F.struct("sim", "n", "parity", "prefix", "hot")).alias("x"))
    one = ws.save(one.where("x.n > 0").select("fp", "key", "x.*"), "sets")
    ws.drop("wide")
    ws.settle()
    rows = _placed(one)
    # frequent shingles make large shards for sure; their rows never meet in one task
    found = ws.save(_small(rows.where("not hot").drop("hot")), "small")
    members = ws.save(found.where("shard is not null").select("shard", "fp").unionByName(rows.where("hot").select("shard", "fp")).distinct(), "members")
    sizes = ws.save(members.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    light = ws.save(one.select("fp", "key", "sim", "n", "parity"), "facts")
    facts, named = light.select("fp", "sim", "n", "parity"), light.select("fp", "key")
    ws.drop("sets")
    ws.settle()
    shards = _dealt(members.join(facts, "fp").withColumn("component", F.col("fp")), sizes, block)
    pairs = found.where("a is not null").select("a", "b").distinct()
    first = _possible(pairs, facts).unionByName(_search(shards, False)).distinct()
    edges = _verified(ws, "edges", ws.save(first, "nearest"), named, source, words)
    groups = connected_components(ws, edges, "nearest").select(F.col("node").alias("fp"), "component")
    later = members.join(facts, "fp").join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    rest = ws.save(_search(_dealt(later, sizes, block), True).join(edges, ["a", "b"], "left_anti"), "rest")
    more = _verified(ws, "edges-rest", rest, named, source, words)
    ws.drop("small", "members", "sizes", "nearest", "rest", "facts")
    return edges.unionByName(more)


def find(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, block: int = BLOCK) -> tuple[Workspace, DataFrame, DataFrame]:
    """(workspace, prints(id, fp), edges): the parts of ``simhash.near_duplicates`` for a similarity."""
    ws = Workspace(docs.sparkSession, "shingles")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("id", F.coalesce("id", F.xxhash64("text")).alias("key"), "text")
    wide = ws.save(_prints(source, _frequent(source, words), words), "wide")
    prints = ws.save(wide.select("id", "fp"), "prints")
    return ws, prints, link_sets(ws, wide, source, words, block)
