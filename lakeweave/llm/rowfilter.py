"""Filter whole rows by a judgement of their text, batch by batch, without a join or a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernel import Texts, pieces
from .workers import map_batches


def keep_rows(docs: DataFrame, text: str, judge: Callable[[Texts], np.ndarray]) -> DataFrame:
    """The rows, all columns as they are, for whose text judge() gives True."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in pieces(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(np.asarray(judge(texts), bool)))

    return map_batches(docs, run, docs.schema, judge.__module__)
