"""Near-duplicate embeddings: randomised-rotation binary codes decide which pairs are computed exactly.

Equal vectors form one class and are compared once. Candidates: each class goes to ``tables``
buckets, each named by the signs of its vector on some random orthonormal directions; how many
directions follows from the number of classes, and how many tables from the chance of missing a pair
at the threshold (at most ``MISS``; far less for closer pairs). Within a bucket a vector's code is
the signs of its randomly rotated coordinates, stored with the inner product of vector and code.
Against another vector, rounded at random to four bits a coordinate, bit counts give an unbiased
estimate of their inner product with a confidence bound; only pairs whose upper bound reaches the
threshold are computed in double precision, and only those at or above it link.

A pair that meets in several buckets counts in the first. Buckets give back counts and one edge per
vector, never pairs. Buckets of more than ``SPLIT`` members are dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.graph import connected_components
from cadenza.llm.workspace import Workspace

THRESHOLD = 0.9
MISS = 1e-3
BUCKET = 512
SPLIT = 4096
#: Width of the confidence bound, in units of the estimate's own deviation.
EPSILON = 4.0
_TILE = 512


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def layout(n: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits per table, tables) for n vectors: buckets of about ``bucket`` random vectors, and the promised recall."""
    bits = min(48, max(1, math.ceil(math.log2(max(n, 2) / bucket))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def hyperplanes(dim: int, count: int) -> np.ndarray:
    return np.concatenate([rotation(dim, 1 + i) for i in range(-(-count // dim))])[:count]


class Codes:
    """Binary codes of unit vectors and estimates from them."""

    def __init__(self, dim: int) -> None:
        self.dim, self.rotation = dim, rotation(dim, 0)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code bits packed in 64-bit words, inner product of each vector and its code)."""
        turned = unit @ self.rotation.T
        return self.pack(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(self.dim)

    def pack(self, bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits, axis=1, bitorder="little")
        wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        return wide.view(np.uint64)

    def planes(self, unit: np.ndarray, seed: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Four bit planes of the rotated vectors, rounded at random; lowest value, step and sum of each."""
        turned = unit @ self.rotation.T
        low = turned.min(axis=1)
        step = np.maximum(turned.max(axis=1) - low, 1e-12) / 15
        level = (turned - low[:, None]) / step[:, None]
        level = np.clip(np.floor(level + np.random.default_rng(seed).random(level.shape)), 0, 15).astype(np.uint8)
        return [self.pack(level >> b & 1 == 1) for b in range(4)], low, step, level.sum(axis=1)

    def upper(self, code: np.ndarray, factor: np.ndarray, planes: list[np.ndarray], low: np.ndarray, step: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Upper confidence bounds, shape (codes, queries)."""
        estimate, width = self.estimate(code, factor, planes, low, step, sums)
        return estimate + width

    def estimate(self, code: np.ndarray, factor: np.ndarray, planes: list[np.ndarray], low: np.ndarray, step: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dot = np.zeros((len(code), len(low)), np.int32)
        for b, plane in enumerate(planes):
            for w in range(code.shape[1]):
                dot += np.bitwise_count(code[:, w][:, None] & plane[:, w][None, :]).astype(np.int32) << b
        ones = np.bitwise_count(code).sum(axis=1).astype(np.float64)
        with_code = (2 * step * dot + 2 * low * ones[:, None] - step * sums - self.dim * low) / math.sqrt(self.dim)
        spread = np.sqrt(np.maximum(1 - factor**2, 0) / max(self.dim - 1, 1)) / factor
        width = EPSILON * (spread[:, None] + step[None, :] / (2 * factor[:, None]))
        return with_code / factor[:, None], width


def _fields(dim: int, words: int, sig: int, kind: str) -> list[tuple]:
    return [("vector", kind, (dim,)), ("code", "<u8", (words,)), ("factor", "<f8"), ("signs", "u1", (sig,))]


def _bucket(keys: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit names of buckets; one that two keys share by chance would only count their pairs there."""
    x = keys.astype(np.uint64) + np.uint64((dim * 0x9E3779B97F4A7C15 + table * 0xBF58476D1CE4E5B9) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _keyed(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """classes(class, n, vector of ``kind`` components) → (bucket, table, class, n, dim, packed), one row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column(2)
                sizes = lists.value_lengths().to_numpy()
                for dim in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dim)
                    vectors = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    if dim not in made:
                        made[dim] = Codes(dim), hyperplanes(dim, bits * tables)
                    codes, planes = made[dim]
                    unit = _unit(vectors)
                    signs = unit @ planes.T > 0
                    code, factor = codes.encode(unit)
                    packed_signs = np.packbits(signs, axis=1, bitorder="little")
                    packed = np.zeros(len(rows), np.dtype(_fields(dim, code.shape[1], packed_signs.shape[1], kind)))
                    packed["vector"], packed["code"], packed["factor"], packed["signs"] = vectors, code, factor, packed_signs
                    raw = packed.tobytes()
                    size = packed.dtype.itemsize
                    blobs = pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())
                    keys = _keys(signs, bits, tables)
                    own = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), blobs]
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys[:, t], t, dim)), pa.array(np.full(len(rows), t, np.int32)), *own], ["bucket", "table", "class", "n", "dim", "packed"])

    return classes.select("class", "n", "vector").mapInArrow(run, "bucket long, table int, class long, n long, dim int, packed binary")


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    return signs.reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _pairs(table: int, left: np.ndarray, right: np.ndarray, same: bool, bits: int, tables: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (left, right) that link and meet in no earlier table."""
    dim = left["vector"].shape[1]
    codes = Codes(dim)
    unit_l, unit_r = _unit(left["vector"]), _unit(right["vector"])
    bits_of = lambda x: _keys(np.unpackbits(x["signs"], axis=1, count=bits * tables, bitorder="little"), bits, tables)[:, :table]
    keys_l, keys_r = bits_of(left), bits_of(right)
    for b in range(0, len(right), _TILE):
        end = min(b + _TILE, len(right))
        planes = codes.planes(unit_r[b:end], seed=table)
        for a in range(0, end if same else len(left), _TILE):
            stop = min(a + _TILE, len(left))
            upper = codes.upper(left["code"][a:stop], left["factor"][a:stop], *planes)
            i, j = np.nonzero(upper >= threshold)
            i, j = i + a, j + b
            if same:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 1 << 15):
                ii, jj = i[c : c + (1 << 15)], j[c : c + (1 << 15)]
                exact = np.einsum("pd,pd->p", unit_l[ii], unit_r[jj]) >= threshold
                ii, jj = ii[exact], jj[exact]
                fresh = ~(keys_l[ii] == keys_r[jj]).any(axis=1) if table else np.ones(len(ii), bool)
                yield ii, jj, fresh


_LINKS = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64())])


def _compare(ids: np.ndarray, n: np.ndarray, dims: np.ndarray, packed: list[bytes], table: int, bits: int, tables: int, threshold: float, kind: str, sides: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Links within one bucket, or between the two sides of one pair of blocks."""
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        rows = np.frombuffer(b"".join(packed[i] for i in own.tolist()), np.dtype(_fields(dim, -(-dim // 64), -(-bits * tables // 8), kind)))
        part = [own, own] if sides is None else [own[sides[own] == s] for s in (0, 1)]
        where = np.empty(len(ids), np.int64)
        where[own] = np.arange(len(own))
        for ii, jj, fresh in _pairs(table, rows[where[part[0]]], rows[where[part[1]]], sides is None, bits, tables, threshold):
            i, j = part[0][ii], part[1][jj]
            np.add.at(links, i[fresh], n[j[fresh]])
            np.add.at(links, j[fresh], n[i[fresh]])
            # one edge per vector and smallest partner joins as much as all of them
            least = np.full(len(ids), len(ids))
            np.minimum.at(least, j, i)
            np.minimum.at(least, i, j)
            for a in np.flatnonzero(least < len(ids)).tolist():
                x, y = top(a), top(int(least[a]))
                root[max(x, y)] = min(x, y)
            for a, c in zip(i.tolist(), j.tolist(), strict=True) if len(i) < 64 else _bridges(i, j, root, top):
                x, y = top(a), top(c)
                if x != y:
                    root[max(x, y)] = min(x, y)
    tops = np.array([top(i) for i in range(len(ids))])
    keep = np.flatnonzero((links > 0) | (tops != np.arange(len(ids))))
    if not len(keep):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(ids[tops[keep]]), pa.nulls(len(keep), pa.int64()), pa.nulls(len(keep), pa.int64())], schema=_LINKS)


def _bridges(i: np.ndarray, j: np.ndarray, root: np.ndarray, top) -> list[tuple[int, int]]:
    """Those pairs whose ends are not joined yet, one for each pair of groups."""
    tops = np.array([top(k) for k in range(len(root))])
    a, b = tops[i], tops[j]
    apart = a != b
    if not apart.any():
        return []
    return [(int(x), int(y)) for x, y in {*zip(a[apart].tolist(), b[apart].tolist(), strict=True)}]


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int | None) -> Iterator[tuple[tuple, list[list], int]]:
    """Rows of equal first ``keys`` columns, from batches sorted by them; of runs longer than ``most`` only the length."""
    key, held, size = None, None, 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if key is not None:
                    yield key, held, size
                key, held, size = row[:keys], [], 0
            size += 1
            if most is None or size <= most:
                held.append(row[keys:])
            else:
                held = []
    if key is not None:
        yield key, held, size


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET, split: int = SPLIT) -> DataFrame:
    """id_col, n_links, component_id, kept for each row of ``vectors``.

    n_links counts the other rows whose cosine with this one reaches the threshold; component_id is
    the smallest id reachable over links, the row's own included; kept marks the row that bears it.
    Vectors that are null, empty, zero or hold a null, NaN or infinity link with nothing; vectors of
    different lengths, however long, do not link. Equal vectors link with each other whatever their ids; null ids
    keep their row and name a component only if nothing else does. An empty table gives an empty
    result; other columns are ignored.
    """
    spark, ws = vectors.sparkSession, Workspace(vectors.sparkSession, "embeddings")
    v = F.col("vector")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # components of other types than float are compared as doubles
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    source = source.withColumn("sound", F.coalesce(sound, F.lit(False)))
    grouped = source.where("sound").groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    classes = ws.save(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    bits, tables = layout(classes.count(), threshold, miss, bucket)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def columns(held: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        ids, n, dims, packed = zip(*held, strict=True)
        return np.array(ids), np.array(n), np.array(dims), list(packed)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held, size in _runs(batches, 2, split):
            if size > split:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([key[0]], pa.int64()), pa.array([size], pa.int64())], schema=_LINKS)
            elif size > 1 and (out := _compare(*columns(held), key[1], bits, tables, threshold, kind)) is not None:
                yield out

    schema = "class long, links long, root long, bucket long, size long"
    keyed = _keyed(classes, bits, tables, kind)
    found = ws.save(keyed.repartition(parts, "bucket").sortWithinPartitions("bucket", "table").mapInArrow(small, schema), "links")
    hot = found.where("bucket is not null").select("bucket", F.ceil(F.col("size") / (split // 2)).cast("int").alias("blocks"))
    links = found.where("bucket is null").select("class", "links", "root")
    if not hot.isEmpty():

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (_, i, j, table), held, _ in _runs(batches, 4, None):
                sides = None if i == j else np.array([r[0] for r in held])
                out = _compare(*columns([r[1:] for r in held]), table, bits, tables, threshold, kind, sides)
                if out is not None:
                    yield out

        rows = keyed.join(hot, "bucket").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "table", (F.col("block") > F.col("other")).cast("int").alias("side"), "class", "n", "dim", "packed")
        pairs = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "table")
        links = links.unionByName(ws.save(pairs.mapInArrow(dealt, schema), "links-hot").select("class", "links", "root"))
    groups = connected_components(ws, links.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    total = links.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "vector", "n", "first_id").join(groups, "class", "left").join(total, "class", "left")
    named = ws.save(named.select("vector", "first_id", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "named")
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_vector = named.join(smallest, "component").select("vector", "n_links", "component_id", F.lit(True).alias("sound"))
    out = source.join(by_vector, ["vector", "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: All pairs and the closure over their links: what the query must return, for tables small enough for that.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
