"""Greedy thinning of ordered events, without one task per sequence holding all of it at once.

Whether an event is kept depends on the last one kept. But an event at least ``gap`` after its
predecessor is kept whatever came before, so a sequence falls apart there into chains that are
folded on their own: one pass over sorted rows that remembers the last event kept, nothing else, so a
chain of any length takes time in proportion and no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def chains(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "chain") -> DataFrame:
    """Number the stretches that begin where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _apart(marked: DataFrame, keys: list[str], order: str, payload: list[str], gap: float | int, strict: bool) -> DataFrame:
    """The first row of each chain, then each more (or, unless ``strict``, no less) than ``gap`` after the last kept."""
    rows = marked.select(*keys, order, *payload, F.xxhash64(*keys, "_chain").alias("_run"))
    at, names = len(keys), [*keys, order, *payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            keep = []
            for name, t in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(at).to_pylist(), strict=True):
                good = name != current or (t - last > gap if strict else t - last >= gap)
                if good:
                    current, last = name, t
                keep.append(good)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    schema = T.StructType([f for f in rows.schema.fields if f.name != "_run"])
    return rows.repartition("_run").sortWithinPartitions("_run", order, *payload).mapInArrow(run, schema)


def thin(df: DataFrame, keys: list[str], order: str, gap: float | int, payload: list[str] | None = None) -> DataFrame:
    """keys, order and payload of the events kept: the first, then each at least ``gap`` after the last kept."""
    w = Window.partitionBy(*keys).orderBy(order)
    since = F.col(order) - F.lag(order).over(w)
    marked = chains(df.where(F.col(order).isNotNull()).withColumn("_since", since), keys, order, F.col("_since").isNull() | (F.col("_since") >= gap), "_chain")
    return _apart(marked, keys, order, payload or [], gap, False)


def exclude_growing(candidates: DataFrame, fixed: DataFrame, keys: list[str], order: str, gap: float | int) -> DataFrame:
    """Candidates more than ``gap`` from every fixed event and from every candidate kept before them."""
    far = exclude_near(candidates, fixed, keys, order, gap)
    w = Window.partitionBy(*keys).orderBy(order)
    since = F.col(order) - F.lag(order).over(w)
    marked = chains(far.withColumn("_since", since), keys, order, F.col("_since").isNull() | (F.col("_since") > gap), "_chain")
    return _apart(marked, keys, order, [], gap, True)


def neighbours(df: DataFrame, keys: list[str], order: str, other: Column) -> DataFrame:
    """Adds ``_before`` and ``_after``: the last ``other`` value up to each row and the first from it on, ties included.

    Both frames grow from one end of the sorted rows, the second of the rows in descending order, so
    each is one pass.
    """
    w = Window.partitionBy(*keys)
    back = w.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_before", F.max(other).over(back)).withColumn("_after", F.min(other).over(ahead))


def exclude_near(candidates: DataFrame, fixed: DataFrame, keys: list[str], order: str, gap: float | int) -> DataFrame:
    """Candidates with no fixed event within ``gap``: one merged pass with running neighbours, no range join."""
    both = candidates.select(*keys, order, F.lit(1).alias("_own")).unionByName(fixed.select(*keys, order, F.lit(0).alias("_own")))
    near = neighbours(both, keys, order, F.when(F.col("_own") == 0, F.col(order)))
    close = F.coalesce(F.col(order) - F.col("_before") <= gap, F.lit(False)) | F.coalesce(F.col("_after") - F.col(order) <= gap, F.lit(False))
    return near.where((F.col("_own") == 1) & ~close).select(*keys, order)
