"""Tolerance matching of event lists and the figures that follow from it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadenza.operators.folds import neighbours


def _settle(own: list[tuple], p, tol):
    """Take the nearest truth within ``tol`` out of ``own``, unused (time, number) in order, and return its time; truths behind reach go."""
    gone = 0
    while gone < len(own) and p - own[gone][0] > tol:
        gone += 1
    if gone:
        del own[:gone]
    at = bisect_left(own, (p,))
    left = p - own[at - 1][0] if at else None
    if at < len(own):
        apart = own[at][0] - p
        if left is None or apart <= left:
            last = bisect_right(own, (own[at][0], float("inf"))) - 1  # of equal times the last in the list
            if apart <= tol and (left is None or apart < left or own[last][1] > own[at - 1][1]):
                return own.pop(last)[0]
    return own.pop(at - 1)[0] if left is not None and left <= tol else None


def greedy_match(pred: DataFrame, truth: DataFrame, keys: list[str], time: str, tol: int | float) -> DataFrame:
    """keys, pred_time, truth_time: predictions in ascending order each take the nearest unused truth within ``tol``.

    At equal distance the later truth in list order wins; ``truth`` may carry ``list_no`` for that order, else
    time is the order. Merged timelines are cut where successive events lie further apart than ``tol``:
    no match spans such a gap, so each stretch is one pass over sorted rows that holds what lies within
    ``tol``.
    """
    listed = truth if "list_no" in truth.columns else truth.withColumn("list_no", F.row_number().over(Window.partitionBy(*keys).orderBy(time)))
    both = pred.select(*keys, F.col(time).alias("_t"), F.lit(None).cast("int").alias("_no")).unionByName(listed.select(*keys, F.col(time).alias("_t"), F.col("list_no").cast("int").alias("_no")))
    w = Window.partitionBy(*keys).orderBy("_t")
    since = F.col("_t") - F.lag("_t").over(w)
    both = both.withColumn("_since", since)
    both = both.withColumn("_part", F.sum((F.col("_since").isNull() | (F.col("_since") > tol)).cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    rows = both.where("_t is not null").select(*keys, "_t", "_no", F.xxhash64(*keys, "_part").alias("_run"))
    kind = rows.schema["_t"].dataType
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("pred_time", kind), T.StructField("truth_time", kind)])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # predictions wait until all truths within reach have come
        current, own, types = None, (), None
        waiting: deque = deque()
        truths: list[tuple] = []
        pairs: list[tuple] = []

        def settle() -> None:
            p = waiting.popleft()
            found = _settle(truths, p, tol)
            if found is not None:
                pairs.append((*own, p, found))

        for batch in batches:
            types = batch.schema.types[: n + 1]
            for i, (t, no, name) in enumerate(zip(*(batch.column(n + c).to_pylist() for c in range(3)), strict=True)):
                if name != current:
                    while waiting:
                        settle()
                    truths.clear()
                    current, own = name, tuple(batch.column(c)[i].as_py() for c in range(n))
                while waiting and t - waiting[0] > tol:
                    settle()
                if no is None:
                    waiting.append(t)
                else:
                    truths.append((t, no))
            yield made(pairs, types)
            pairs.clear()
        if types is not None:
            while waiting:
                settle()
            yield made(pairs, types)

    def made(pairs: list[tuple], types: list) -> pa.RecordBatch:
        columns = list(zip(*pairs, strict=True)) or [()] * (n + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [*types, types[n]], strict=True)], [*keys, "pred_time", "truth_time"])

    return rows.repartition("_run").sortWithinPartitions("_run", "_t", "_no").mapInArrow(run, schema)


#: Lists up to this length are matched many at a time.
SHORT = 256


def match_lists(pred: np.ndarray, truth: np.ndarray, tol: float) -> np.ndarray:
    """What ``greedy_match`` does, row by row of arrays: the truth that each prediction takes, else NaN. Rows ascend and end in inf."""
    out = np.full(pred.shape, np.nan)
    if max(pred.shape[1], truth.shape[1]) > SHORT:
        for row, p_row, t_row in zip(out, pred, truth, strict=True):
            times, at, own = t_row[np.isfinite(t_row)].tolist(), 0, []
            for k, p in enumerate(p_row[np.isfinite(p_row)].tolist()):
                while at < len(times) and times[at] - p <= tol:
                    own.append((times[at], at))
                    at += 1
                found = _settle(own, p, tol)
                if found is not None:
                    row[k] = found
        return out
    free = truth[:, ::-1].copy()  # of equal distances the first is the later truth
    row = np.arange(len(pred))
    with np.errstate(invalid="ignore"):
        for k in range(pred.shape[1]):
            apart = np.abs(free - pred[:, k, None])
            at = apart.argmin(axis=1)
            good = row[apart[row, at] <= tol]
            out[good, k] = free[good, at[good]]
            free[good, at[good]] = np.inf
    return out


def blocks(left: pa.Array, right: pa.Array, cells: int, times: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, left, right, n_left, n_right): list columns as sorted matrices that end in inf, rows of like length together; rows with an empty list are left out.

    ``times`` pairs of elements of a block make ``cells`` at most; a row with a list over ``SHORT`` comes alone.
    """
    starts, sizes, values = [], [], []
    for column in (left, right):
        offsets = column.offsets.to_numpy()
        starts.append(offsets[:-1])
        sizes.append(np.diff(offsets))
        values.append(column.values.to_numpy(zero_copy_only=False))
    longest = np.maximum(*sizes)
    order = np.lexsort((sizes[1], sizes[0], longest))
    order = order[np.minimum(*sizes)[order] > 0]

    def matrix(side: int, rows: np.ndarray) -> np.ndarray:
        place = np.arange(sizes[side][rows].max())
        inside = place < sizes[side][rows, None]
        out = np.full(inside.shape, np.inf)
        out[inside] = values[side][(starts[side][rows, None] + place)[inside]]
        out.sort(axis=1)
        return out

    at = 0
    while at < len(order):
        end, most = at + 1, [int(n[order[at]]) for n in sizes]
        while end < len(order) and longest[order[end]] <= SHORT:
            most = [max(a, int(n[order[end]])) for a, n in zip(most, sizes, strict=True)]
            if (end + 1 - at) * most[0] * most[1] * times > cells:
                break
            end += 1
        rows = order[at:end]
        yield rows, matrix(0, rows), matrix(1, rows), sizes[0][rows].astype("int64"), sizes[1][rows].astype("int64")
        at = end


def matched_lists(lists: DataFrame, pred: str, truth: str, tol: float, name: str = "tp") -> DataFrame:
    """Adds how many elements of one array column ``greedy_match`` pairs with another's; arrays of finite doubles."""
    schema = T.StructType([*lists.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, "int64")
            for rows, p, t, _, _ in blocks(batch.column(pred), batch.column(truth), 1 << 20):
                n[rows] = (~np.isnan(match_lists(p, t, tol))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], schema.names)

    return lists.mapInArrow(run, schema)


def ratios(tp: Column, n_pred: Column, n_truth: Column) -> tuple[Column, Column, Column]:
    """precision, recall and F1, rounded to three places; a ratio without denominator is 1, F1 of nothing 0."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(1.0)
    r = F.when(n_truth > 0, tp / n_truth).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.bround(p, 3).alias("precision"), F.bround(r, 3).alias("recall"), F.bround(f1, 3).alias("f1")


def scores(matched: DataFrame, pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 (rounded to three places); a ratio without denominator is 1, F1 of nothing 0."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    joined = count(pred, "n_pred").join(count(truth, "n_truth"), keys, "full").join(count(matched, "tp"), keys, "left").na.fill(0, ["n_pred", "n_truth", "tp"])
    return joined.select(*keys, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"), *ratios(F.col("tp"), F.col("n_pred"), F.col("n_truth")))


def macro_mean(per_film: DataFrame, counted: Column | None = None) -> DataFrame:
    """Means over films of precision, recall and F1, of those that ``counted`` admits."""
    value = lambda c: F.avg(c if counted is None else F.when(counted, F.col(c))).alias(f"mean_{c}")
    return per_film.agg(value("precision"), value("recall"), value("f1"), F.count(F.lit(1)).alias("n_films"))


def trap_hits(pred: DataFrame, traps: DataFrame, keys: list[str], time: str, tol: int | float) -> DataFrame:
    """keys, time, trap_no, trap_type: predictions strictly inside a trap shrunk by ``tol``, or within ``tol`` of a trap without bounds; the first trap in list order counts."""
    inside = F.when(F.col("lo").isNotNull(), (F.col(time) > F.col("lo") + tol) & (F.col(time) < F.col("hi") - tol)).otherwise(F.abs(F.col(time) - F.col("at")) <= tol)
    hit = pred.join(traps, keys).where(inside)
    return hit.groupBy(*keys, time).agg(F.min("trap_no").alias("trap_no"), F.min_by("trap_type", "trap_no").alias("trap_type"))


def covered(df: DataFrame, spans: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds ``covered``: whether any closed span holds the time; true where a key has no spans.

    One merged pass: a time is covered if some span that began by then reaches it.
    """
    both = df.withColumn("_own", F.lit(1)).withColumn("_at", F.col(time).cast("double"))
    starts = spans.where("lo is not null and hi is not null").select(*keys, F.lit(0).alias("_own"), F.col("lo").cast("double").alias("_at"), F.col("hi").cast("double").alias("_hi"))
    both = both.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    reach = F.max("_hi").over(w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_reach", reach).withColumn("_some", F.max("_hi").over(w))
    return both.where("_own = 1").withColumn("covered", F.col("_some").isNull() | F.coalesce(F.col("_at") <= F.col("_reach"), F.lit(False))).drop("_own", "_at", "_hi", "_reach", "_some")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, tol: int | float) -> DataFrame:
    """keys, time, match_time: the nearest right event of each left one within ``tol``, the earlier on ties; null without.

    One merged pass with the last right event before and the first after; no range join.
    """
    both = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_own")).unionByName(right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_own")))
    both = neighbours(both, keys, "_t", F.when(F.col("_own") == 0, F.col("_t")))
    before, after = F.col("_t") - F.col("_before"), F.col("_after") - F.col("_t")
    pick = F.when(F.coalesce(before <= after, before.isNotNull()), F.when(before <= tol, F.col("_before"))).otherwise(F.when(after <= tol, F.col("_after")))
    return both.where("_own = 1").select(*keys, F.col("_t").alias(time), pick.alias("match_time"))


def near_any(left: DataFrame, right: DataFrame, keys: list[str], time: str, tol: int | float, name: str = "near") -> DataFrame:
    """keys, time, ``name``: whether a right event lies within ``tol``."""
    return nearest(left, right, keys, time, tol).select(*keys, time, F.col("match_time").isNotNull().alias(name))
