"""Folds and bounded training samples. Classifiers learn from samples; nothing else does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids get null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def texts_of_ids(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, a table the caller has bounded by a row count."""
    bounded = F.broadcast(ids)
    return docs.select(F.col(id_col), F.col(text_col)).join(bounded, id_col).select(id_col, text_col, *others)
