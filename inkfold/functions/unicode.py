"""Unicode compatibility folding: the one text step Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters beyond ASCII that compatibility folding always leaves alone, alone or
# next to each other: a text made of these and ASCII never has to visit Python.
STABLE = (
    r"¡-§©«-®°±¶·»¿-ı"
    r"‐‒-‖‘-‣、-〩ぁ-ゖァ-ヾ"
    r"一-鿿가-힣"
)


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _fold_all(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda values: [None if v is None else unicodedata.normalize("NFKC", v) for v in values],
        na_action="ignore",
    )


def needs_folding(text: Column) -> Column:
    """ASCII, most of a text, is told by one comparison before the ranges are tried."""
    return text.rlike(rf"[[^\x00-\x7F]&&[^{STABLE}]]")


def nfkc(text: Column) -> Column:
    """NFKC; Python only ever receives the rows that can change."""
    return F.coalesce(_fold(F.when(needs_folding(text), text)), text)


def nfkc_each(texts: Column) -> Column:
    """NFKC of every element of a string array, in one batch call per row group."""
    return F.coalesce(_fold_all(F.when(F.exists(texts, needs_folding), texts)), texts)
