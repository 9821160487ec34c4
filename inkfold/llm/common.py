"""Helpers that the corpus operators share: words of a batch, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from inkfold.tables import materialize

__all__ = ["gathered", "materialize", "partitions", "slices", "sums", "texts_of", "tune", "words_of"]

#: Rows of one Arrow batch between the JVM and Python. Documents can be long, so it's well below Spark's own default.
BATCH_ROWS = 2000
#: A batch of texts is worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece hold about `most` bytes; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like slices, but small batches are also put together, to about `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, text, most):
        own = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if held and size + own > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column, nulls as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words `[^\\x20\\x09-\\x0D]+` of each text: codes of all words, each text's offsets into them, the words by code."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty is not None and empty >= 0:
        gone = codes == empty
        bounds = bounds - np.concatenate([[0], np.cumsum(gone)])[bounds]
        codes = codes[~gone]
    return codes, bounds, coded.dictionary


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])
