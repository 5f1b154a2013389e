"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litweave.llm import bpe


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): the token ids of each row's text, one row for each row of ``df``.

    NULL and empty texts give the empty list, a blank text the ids of its blanks, and what looks like a special token is
    ordinary text. Lone surrogates can't occur in Spark strings. Repeated keys give repeated rows, a NULL key stays NULL,
    other columns of ``df`` are not read. Narrow: no shuffle; one pass in Arrow batches over the whole texts.
    """
    path = path or bpe.vocabulary_path()
    kind = df.schema[key].dataType

    def run(batches):
        tokenizer = bpe.load(path)
        for b in batches:
            each = [tokenizer.encode(x.as_py()) for x in b.column(1)]
            ends = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=ends[1:])
            flat = np.concatenate(each) if each else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``: 0 for NULL and empty texts. Narrow, like ``encode``."""
    path = path or bpe.vocabulary_path()

    def run(batches):
        tokenizer = bpe.load(path)
        for b in batches:
            n = pa.array([tokenizer.count(x.as_py()) for x in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, "n_tokens"])

    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keep), T.StructField("n_tokens", T.LongType())])
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
