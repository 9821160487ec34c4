"""Packing by concatenation: all documents are one long row of ids, which is cut into windows of a fixed size.

The first pass tokenizes, and writes each document's ids with its place among the ids of its partition. Prefix sums, within
blocks of partitions and over the blocks, turn the partitions' totals into the place where each begins. The second pass then
knows each document's global place, and so the windows that it lies in: pieces need no shuffle. For the windows' own ids,
those that lie within one run of rows are whole at once; only the ids at a run's two ends, its boundary records, are dealt
out by window and joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import gathered, materialize, texts_of, tune
from inkfold.llm.tokens import TOKEN_SLICE, encode_texts, library_encoder

SIZE = 1024
END = 0
#: Partitions whose totals are summed up in one block.
BLOCK = 1024
#: Chunks whose ids a worker remembers, over all the tasks that it runs.
REMEMBERED = 1_000_000

_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=1)
def _encoder(path: str):
    """A worker's own, from task to task; what it remembers changes no ids."""
    return library_encoder(path, REMEMBERED)


def tokenized(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """First pass: doc_id, its ids and the end id (little-endian, 2 or 4 bytes each), how many (n), its partition (part), the ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = _encoder(path)
        part, seen = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, "text", TOKEN_SLICE):
            flat, bounds = encode_texts(texts_of(batch), encode, special)
            flat = np.insert(flat, bounds[1:], end)
            bounds = bounds + np.arange(len(bounds))
            kind = "<u2" if flat.max(initial=0) < 1 << 16 else "<u4"
            width, data = int(kind[-1]), pa.py_buffer(flat.astype(kind).tobytes())
            ids = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), data])
            cols = [batch.column("doc_id"), ids, pa.array(np.diff(bounds)), pa.array(np.full(len(bounds) - 1, part, np.int32)), pa.array(bounds[:-1] + seen)]
            seen += int(bounds[-1])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n", "part", "before"])

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, n bigint, part int, before bigint")


def part_starts(totals: DataFrame) -> DataFrame:
    """totals(part, n) -> (part, base): the ids before each part. Sums within blocks, then over the blocks' own totals, so that no task sees more than a block of parts or all blocks."""
    blocks = totals.withColumn("block", F.floor(F.col("part") / BLOCK).cast("int"))
    inside = blocks.withColumn("inner", F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("n"))
    outer = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outer"))
    return inside.join(outer, "block").select("part", (F.col("inner") + F.col("outer")).alias("base"))


class _Windows:
    """Windows over `total` ids: full ones, then the rest cut at powers of two, so that nothing is padded."""

    def __init__(self, total: int, size: int):
        rest, self.size, self.n_full = total % size, size, total // size
        cuts = [1 << i for i in range(rest.bit_length())[::-1] if rest >> i & 1]
        self.tail = np.cumsum([self.n_full * size, *cuts])

    def of(self, places: np.ndarray) -> np.ndarray:
        late = self.n_full + np.searchsorted(self.tail, places, side="right") - 1
        return np.where(places < self.tail[0], places // self.size, late)

    def begins(self, windows: np.ndarray) -> np.ndarray:
        return np.where(windows < self.n_full, windows * self.size, self.tail[np.clip(windows - self.n_full, 0, len(self.tail) - 1)])


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows, one after another."""
    parts = [np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // n}") for x, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True)]
    return np.concatenate(parts).astype("<u4")


def _placed(docs: DataFrame, path: str, size: int, end: int) -> tuple[DataFrame, _Windows]:
    """The documents' ids with each one's global place, and the windows. What goes to every task is a row for each task of the first pass; the driver gets one sum."""
    ids = materialize(tokenized(docs, path, end))  # places must not change when a task is run again
    starts = part_starts(ids.groupBy("part").agg(F.sum("n").alias("n")))
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = ids.join(F.broadcast(starts), "part").select("doc_id", "ids", "n", (F.col("base") + F.col("before")).alias("at"))
    return placed, _Windows(total, size)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each part of a document in one window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any others; other columns are
    ignored; an empty table gives no rows. Documents lie one after another in the order of the first pass.
    """
    placed, windows = _placed(docs, path, size, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            first = windows.of(at)
            count = windows.of(at + n - 1) - first + 1
            doc = np.repeat(np.arange(len(at)), count)
            window = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            begin = windows.begins(window)
            low, high = np.maximum(at[doc], begin), np.minimum((at + n)[doc], windows.begins(window + 1))
            own = low - at[doc] + (np.cumsum(n) - n)[doc]
            raw = memoryview(_flat(batch).tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own.tolist(), (own + high - low).tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (low - at[doc], high - low, np.array(crc, np.int64), n[doc], window, low - begin))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, _OUT)


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each window: sequence_id, ids (array of int). Only windows over the ends of runs of rows are shuffled, as their boundary records."""
    placed, windows = _placed(docs, path, size, end)

    def cut(at: int, ids: np.ndarray) -> Iterator[tuple[int, int, bytes, bool]]:
        """A run's windows: (window, offset in it, ids, whole)."""
        first, last = windows.of(np.array([at, at + len(ids) - 1]))
        begins = windows.begins(np.arange(first, last + 2))
        for window, a, b in zip(range(first, last + 1), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            low, high = max(a, at), min(b, at + len(ids))
            yield window, low - a, ids[low - at : high - at].tobytes(), high - low == b - a

    def rows(found: list[tuple[int, int, bytes, bool]]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) if found else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["sequence_id", "offset", "ids", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, held = 0, np.empty(0, "<u4")  # a run's ids that don't end a window yet
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[tuple[int, int, bytes, bool]] = []
            flat, n, at = _flat(batch), batch.column("n").to_numpy(), batch.column("at").to_numpy()
            ends = np.cumsum(n)
            breaks = [0, *(np.flatnonzero(at[1:] != (at + n)[:-1]) + 1).tolist(), len(at)]
            for a, b in zip(breaks, breaks[1:], strict=False):
                if len(held) and begin + len(held) != at[a]:
                    found += cut(begin, held)
                    held = held[:0]
                begin = begin if len(held) else int(at[a])
                held = np.concatenate([held, flat[ends[a] - n[a] : ends[b - 1]]])
                whole = int(windows.begins(windows.of(np.array([begin + len(held)])))[0]) - begin  # up to the last window's begin
                if whole > 0:
                    found += cut(begin, held[:whole])
                    begin, held = begin + whole, held[whole:]
            yield rows(found)
        yield rows(list(cut(begin, held)) if len(held) else [])

    cuts = materialize(placed.mapInArrow(run, "sequence_id bigint, offset bigint, ids binary, whole boolean"))
    parts = cuts.where(~F.col("whole")).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = parts.select("sequence_id", F.aggregate(F.col("parts.ids"), F.lit(b""), lambda x, y: F.concat(x, y)).alias("ids"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(found, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return cuts.where("whole").select("sequence_id", "ids").union(joined).mapInArrow(lists, "sequence_id bigint, ids array<int>")
