"""The few functions Spark has no built-in for, in Arrow batches."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fold(s):
    return s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def nfkd_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return s.map(_fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if "&" in x else x, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_unescape_all(s: pd.Series) -> pd.Series:
    """The same for every element of a list."""
    return s.map(lambda xs: None if xs is None else [x if x is None or "&" not in x else html.unescape(x) for x in xs])


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, the first one being the pattern: not symmetric. NULL if either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
