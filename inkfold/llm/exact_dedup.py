"""Exact dedup by deterministic block naming.

A text is cut into fixed-size blocks. Equal blocks get one integer name: blocks meet in a partition by their hash, are
sorted there, and each distinct block's name is made of the partition and its place in the order. Adjacent names are then
paired and named the same way, level by level, until one name is left for each text. Equal names mean equal texts and
the reverse, as blocks and pairs are compared whole: hashes only choose partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.llm.common import materialize, partitions, slices, texts_of, tune

#: Bytes of a block. Most documents are one or two blocks; only longer ones go through the levels above.
BLOCK_BYTES = 2048
SPACES = b" \t\n\v\f\r"
_RUNS = re.compile(rb"[\x20\x09-\x0D]+")

#: Where a block occurs: its document, the text's SHA-256 (tells rows with one doc_id apart), how many such rows there are, its place.
_OCCURRENCES = "array<struct<id:bigint,sha:binary,rows:bigint,at:bigint>>"
_OCC_FIELDS = {"id": pa.int64(), "sha": pa.binary(), "rows": pa.int64(), "at": pa.int64()}


def normalised(text: str) -> bytes:
    """UTF-8 of the text with every run of `[\\x20\\x09-\\x0D]` as one space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in SPACES else b"") + b" ".join(words) + (b" " if raw[-1] in SPACES else b"")


def _grouped(keys: list, occurrences: list[tuple]) -> tuple[list, list]:
    """Equal keys of a batch become one row, so that a hot block is a row for each batch, not for each document."""
    at: dict = {}
    for key, occ in zip(keys, occurrences, strict=True):
        at.setdefault(key, []).append(occ)
    return list(at), list(at.values())


def _occ_array(lists: list[list[tuple]]) -> pa.Array:
    flat = [o for x in lists for o in x]
    cols = list(zip(*flat, strict=True)) if flat else [()] * len(_OCC_FIELDS)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, _OCC_FIELDS.values(), strict=True)], names=list(_OCC_FIELDS))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), values)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, occ = [], []
            for doc, text in zip(batch.column("id").to_pylist(), texts_of(batch).to_pylist(), strict=True):
                raw = normalised(text)
                sha, n = hashlib.sha256(raw).digest(), max(1, -(-len(raw) // size))
                for at in range(n):
                    keys.append(raw[at * size : (at + 1) * size])
                    occ.append((doc, sha, 1, at))
            keys, occ = _grouped(keys, occ)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _occ_array(occ)], names=["key", "occ"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair the adjacent names of each text; a last odd one is paired with -1."""
    for batch in batches:
        keys, occ = [], []
        for doc, sha, rows, names in zip(*(batch.column(c).to_pylist() for c in ("id", "sha", "copies", "names")), strict=True):
            row = [x["name"] for x in sorted(names, key=lambda x: x["at"])]
            row += [-1] * (len(row) % 2)
            for at in range(0, len(row), 2):
                keys.append(row[at].to_bytes(8, "big", signed=True) + row[at + 1].to_bytes(8, "big", signed=True))
                occ.append((doc, sha, rows, at // 2))
        keys, occ = _grouped(keys, occ)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _occ_array(occ)], names=["key", "occ"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key within the partition. A key's name: the partition's number and the key's rank in it."""
    base, rank, last = TaskContext.get().partitionId() << 40, -1, None
    for batch in batches:
        names = []
        for key in batch.column("key").to_pylist():
            if key != last:
                rank, last = rank + 1, key
            names.append(base + rank)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("occ")], names=["name", "occ"])


def _name(keyed: DataFrame) -> DataFrame:
    """(key, occ) -> a row (id, sha, rows, at, name) for each occurrence."""
    n = partitions(keyed.sparkSession)
    named = keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_named, f"name bigint, occ {_OCCURRENCES}")
    # A hot block's lists are dealt out before they become rows.
    return named.repartition(n).select("name", F.explode("occ").alias("o")).select("o.*", "name")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns doc_id, text_sha256, copies, level, name: two rows have one (level, name) exactly if their texts are equal.

    docs: doc_id, text; further columns are ignored, null texts count as empty. Rows that agree in doc_id and text come
    out as one row with their number in copies. A null doc_id stays null.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    keyed = rows.mapInArrow(_blocks(block_bytes), f"key binary, occ {_OCCURRENCES}")
    level, done = 0, None
    while True:
        # A row for each text with its names by place. A repeated row adds each of its names again.
        texts = _name(keyed).groupBy("id", "sha").agg(F.collect_set(F.struct("at", "name")).alias("names"), F.sum("rows").alias("rows"))
        texts = materialize(texts.select("id", "sha", "names", F.expr("rows div size(names)").alias("copies")))
        named = texts.where(F.size("names") == 1)
        named = named.select("id", "sha", "copies", F.lit(level).alias("level"), F.col("names")[0]["name"].alias("name"))
        done = named if done is None else done.unionByName(named)
        rest = texts.where(F.size("names") > 1)
        if rest.isEmpty():
            return done.select(F.col("id").alias("doc_id"), F.lower(F.hex("sha")).alias("text_sha256"), "copies", "level", "name")
        keyed = rest.mapInArrow(_pairs, f"key binary, occ {_OCCURRENCES}")
        level += 1


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal after each run of `[\\x20\\x09-\\x0D]` became one space; a null text is an empty one. The smallest
    doc_id of a group stays, a null one only where no other is there; of repeated rows with that doc_id one is kept.
    An empty table gives no rows.
    """
    rows = identities(docs, block_bytes)
    # Written, so that the join has an exchange on either side and a hot group's rows can be split.
    groups = materialize(rows.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    row = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("row")
    return (
        rows.join(groups, ["level", "name"])
        .select("doc_id", "keep_id", "group_size", "text_sha256", row)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == 1))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def keep_one(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows and columns of docs without those that dedup drops: one row of each group of equal texts stays.

    Of rows that agree in the doc_id that stays and in the normalised text, the one whose columns have the least hash stays.
    """
    kept = dedup(docs, block_bytes).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    # The same normal form as in the blocks; with the doc_id it names a row.
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    hashed = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().count("map<")))
    rows = docs.withColumns({"__row_id": F.col("doc_id").cast("long"), "__row_sha": F.sha2(text, 256), "__row_hash": hashed})
    same = F.col("__row_id").eqNullSafe(F.col("__id")) & (F.col("__row_sha") == F.col("__sha"))
    first = F.row_number().over(Window.partitionBy("__row_id", "__row_sha").orderBy("__row_hash"))
    return rows.join(kept, same, "left_semi").withColumn("__row_no", first).where("__row_no = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
