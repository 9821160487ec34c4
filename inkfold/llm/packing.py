"""Best-fit packing with Martello-Toth dominance reduction.

How many pieces there are of each length decides the packing, so the plan is made from at most `size` counts and is a
bounded list of patterns: lengths that share a sequence, and how many such sequences. Reduction fixes sets that dominate
all alternatives for their longest piece; best fit, longest first, packs what remains. Each piece then finds its place by
its rank among the pieces of its length, counted by partition and by prefix sums over partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, slices, texts_of, tune
from inkfold.llm.tokens import TOKEN_SLICE, encode_texts, library_encoder

SIZE = 1024
END = 2

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """Cut each document's ids and the end id into pieces of at most `size`; of a longer one all but the first are full.

    part and rank tell a piece from others of its length. ids: also the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, special = library_encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text", TOKEN_SLICE):
            flat, bounds = encode_texts(texts_of(batch), encode, special)
            n = len(bounds) - 1
            flat = np.insert(flat, bounds[1:], end).astype("<u4")  # the end id after each document
            bounds = bounds + np.arange(n + 1)
            total = np.diff(bounds)
            count = -(-total // size)
            doc = np.repeat(np.arange(n), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = total - (count - 1) * size
            start = np.where(piece > 0, first[doc] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, first[doc])
            lo = bounds[doc] + start
            rank = np.empty(len(doc), np.int64)
            order = np.argsort(length, kind="stable")
            sizes = np.bincount(length, minlength=size + 1)
            rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + seen[length[order]]
            seen += sizes
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(lo, bounds[-1]), pa.int32()), pa.array(flat.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES + ", ids array<int>" * ids)


class _Left:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], size: int):
        self.counts = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] += n

    def largest(self, most: int) -> int:
        """The largest length up to most; 0: none."""
        at = np.flatnonzero(self.counts[1 : most + 1]) if most > 0 else ()
        return int(at[-1]) + 1 if len(at) else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest pieces' lengths."""
        out: list[int] = []
        for length in np.flatnonzero(self.counts).tolist():
            out += [length] * min(n - len(out), int(self.counts[length]))
            if len(out) == n:
                break
        return out

    def fits(self, lengths: list[int]) -> int:
        """How many times these pieces are there together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)


def _dominating(left: _Left, long: int, size: int) -> list[int] | None:
    """A set with a piece of this length that dominates every other set with one, of the pieces that are left; None: undecided."""
    left.counts[long] -= 1
    room = size - long
    partner = left.largest(room)
    two, three = left.smallest(2), left.smallest(3)
    pair = sum(two) if len(two) == 2 and sum(two) <= room else 0
    if pair and len(three) == 3 and sum(three) <= room and partner < room:
        pair = room + 1  # three may fit: not decided here
    elif pair:  # the best two that fit
        at = np.arange(size + 1)
        largest = np.maximum.accumulate(np.where(left.counts > 0, at, 0))
        one = np.flatnonzero(left.counts[: room + 1])
        other = largest[room - one]
        alone = (other == one) & (left.counts[one] < 2)
        other = np.where(alone, largest[one - 1], other)
        pair = int((one + other)[other > 0].max(initial=0))
    left.counts[long] += 1
    if pair and partner < pair:
        return None
    return [long, partner] if partner else [long]


def reduce(left: _Left, size: int) -> list[tuple[list[int], int]]:
    """Fix sets that dominate every other set with one of their pieces; they leave `left`. Longer pieces come first.

    A set dominates another if the other's pieces can be dealt out among its own without exceeding any. For a piece that is
    one partner which fills the sequence; the largest fitting partner if two more never fit, or if it's at least as long as
    any two that do; and no partner if none fits. An undecided piece stays, and the next is tried; what was fixed may
    decide it later.
    """
    fixed: list[tuple[list[int], int]] = []
    again = True
    while again:
        again = False
        for long in np.flatnonzero(left.counts)[::-1].tolist():
            while left.counts[long] and (found := _dominating(left, long, size)):
                n = left.fits(found)
                for x in found:
                    left.counts[x] -= n
                fixed.append((found, n))
                again = True
    return fixed


def best_fit(left: _Left, size: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, of all that is left. Sequences with equal contents are one pattern."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    for length in np.flatnonzero(left.counts)[::-1].tolist():
        n = int(left.counts[length])
        while n:
            room = min((r for r in open_ if r >= length), default=size)
            held, many = open_[room].pop() if room in open_ else ([], n)
            if room in open_ and not open_[room]:
                del open_[room]
            each = min(room // length, n)  # it stays the best fit until it's too full
            used = min(many, n // each)
            if held and used < many:
                open_.setdefault(room, []).append((held, many - used))
            open_.setdefault(room - each * length, []).append((held + [length] * each, used))
            n -= each * used
        left.counts[length] = 0
    return [x for some in open_.values() for x in some]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) for all pieces."""
    left = _Left(counts, size)
    return [x for x in [*reduce(left, size), *best_fit(left, size)] if x[1]]


def _placed(patterns: list[tuple[list[int], int]], size: int):
    """Rows (length, rank) find their sequence and offset. The pieces of a length are used in the order of their ranks."""
    rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a sequence, offset
    used, sequence = [0] * (size + 1), 0
    for lengths, n in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rows.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    table = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, low, first, each, offset = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            cols = {"sequence_id": first + (rank - low) // each, "offset": offset + (rank - low) % each * length}
            own = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *map(pa.array, cols.values())], names=[*own, *cols])

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and ids if asked for.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any others; other columns are
    ignored; an empty table gives no rows. What the driver gets is the count of each length, `size` rows at most.
    """
    cut = materialize(pieces(docs, path, size, end, ids))  # ranks must not change when a task is run again
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = cut.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ranked")).alias("rank"), *["ids"] * ids)
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_placed(plan(counts, size), size), out)
